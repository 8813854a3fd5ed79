"""Queries of the inventory operators over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.functions import positions
from lockgrain.functions.devgroup import is_dev_group
from lockgrain.functions.purl import has_purl, purl
from lockgrain.operators import graph, inventory, reach
from lockgrain.session import table
from lockgrain.sinks import cyclonedx

_PKG = """
SELECT 'repo/' || CAST(l_orderkey % 50 AS STRING) || '/gradle.lockfile' AS source_path,
  CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' WHEN 3 THEN 'Packagist' ELSE 'Debian' END AS ecosystem,
  CASE CAST(l_partkey % 5 AS INT)
    WHEN 0 THEN lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '-')
    WHEN 3 THEN lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-')
    ELSE replace(p_name, ' ', '-') END AS name,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '>=' ELSE '' END
    || CAST(p_size AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.0' AS version,
  l_returnflag = 'A' AS is_direct,
  CASE WHEN l_linestatus = 'F' THEN 'dev' ELSE 'prod' END AS dep_group,
  l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


def derived_packages(spark: SparkSession, d: str) -> DataFrame:
    """Package rows made from lineitem and part: they hold ranged versions and an ecosystem without a package URL."""
    return spark.sql(_PKG, lineitem=table(spark, d, "lineitem"), part=table(spark, d, "part")).withColumn("dep_groups", F.array("dep_group"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "package_rows")


def filter_ranged_versions(spark, d):
    return inventory.drop_ranged(derived_packages(spark, d)).select("source_path", "ecosystem", "name", "version", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def dropped_reasons(spark, d):
    dropped = inventory.sanitize(derived_packages(spark, d))[1]
    return dropped.groupBy("ecosystem", "reason").agg(F.count("*").alias("n"))


def purl_projection(spark, d):
    rows = _rows(spark, d)
    return rows.select("row_id", purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("made_purl"))


def purl_invalid(spark, d):
    rows = derived_packages(spark, d).where(~has_purl(F.col("ecosystem"), F.col("name")))
    return rows.groupBy("ecosystem", "name").agg(F.count("*").alias("n"))


def direct_purls(spark, d):
    return inventory.direct_purls(_rows(spark, d).where("purl <> ''"))


def dev_group_flag(spark, d):
    rows = _rows(spark, d)
    return rows.select("row_id", is_dev_group(F.col("ecosystem"), F.col("dep_groups")).alias("is_dev"))


def base_metadata(spark, d):
    rows = _rows(spark, d)
    meta = inventory.base_metadata(rows)
    return rows.select("row_id", meta["package-manager"].alias("manager"), meta["is-direct"].alias("direct"), meta["is-dev"].alias("dev"))


def group_by_source(spark, d):
    """What the nested form holds, counted per source."""
    good, _ = inventory.identify(_rows(spark, d))
    rows = good.select("source_path", F.concat_ws("@", "name", F.coalesce("version", F.lit(""))).alias("package"), "ecosystem", F.coalesce("is_direct", F.lit(False)).alias("direct"), is_dev_group(F.col("ecosystem"), F.col("dep_groups")).alias("dev"))
    nested = inventory.group_by_source(rows, "package", "ecosystem", "direct", "dev")
    n = lambda keep: F.size(F.filter("packages", keep)).cast("long")
    return nested.select(
        "source_path", F.size("packages").cast("long").alias("n_packages"), n(lambda p: p["ecosystem"] == "GIT").alias("n_git"), n(lambda p: p["direct"]).alias("n_direct"), n(lambda p: p["dev"]).alias("n_dev"), F.get("packages", F.lit(0))["package"].alias("first_package")
    )


def unidentified_rows(spark, d):
    return inventory.identify(_rows(spark, d))[1].select("row_id")


def group_by_purl(spark, d):
    rows = inventory.merge_by_purl(_rows(spark, d).where("purl <> ''"), F.col("row_id"))
    return rows.select("purl", "name", "version", "ecosystem", "n_rows", F.array_join("dep_groups", ",").alias("dep_groups"), "is_direct", "is_dev", "package_manager")


def merge_metadata_strict(spark, d):
    return inventory.merge_by_purl(_rows(spark, d).where("purl <> ''"), F.col("row_id"), strict=True).select("purl", "is_dev")


def last_wins_dedupe(spark, d):
    rows = _rows(spark, d).where("name is not null and version is not null").select("source_path", "name", "version", "is_direct", "row_id")
    return inventory.last_wins(rows, ["source_path", "name", "version"], F.col("row_id"))


def ecosystem_list(spark, d):
    return inventory.ecosystems(_rows(spark, d))


def render_lines(spark, d):
    return inventory.render_lines(_rows(spark, d)).groupBy("line").agg(F.count("*").alias("n"))


def id_order(spark, d):
    ids = table(spark, d, "package_vulns").select(F.explode("vulnerabilities").alias("v")).select(F.col("v.id").alias("id")).where("id is not null").distinct()
    return ids.select("id", inventory.id_rank(F.col("id")).alias("id_rank"))


def _npm_edges(spark, d) -> DataFrame:
    name = F.coalesce("name", F.nullif(F.regexp_extract("pkg_path", r"(?s).*node_modules/(.*)$", 1), F.lit("")))
    return table(spark, d, "npm_packages").select("source_path", name.alias("parent_key"), F.explode(F.map_keys("dependencies")).alias("child_key"))


def _dep_edges(spark, d) -> DataFrame:
    return table(spark, d, "dep_links").select("source_path", "parent_key", "child_key")


def transitive_closure(spark, d):
    return graph.closure(_npm_edges(spark, d)).select("source_path", "ancestor", "node")


def closure_with_cycle(spark, d):
    return graph.closure(_dep_edges(spark, d)).select("source_path", "ancestor", "node")


def artifact_edges(spark, d):
    """The edges of a document: artifacts on their parents, and files on the artifacts they name."""
    places = _rows(spark, d).select("name", "version", F.col("block.file_name").alias("file"))
    return cyclonedx.dependency_edges(places, table(spark, d, "artifacts")).groupBy("ref", "depends_on").agg(F.count("*").alias("n"))


def _advisories(spark, d) -> DataFrame:
    rows = table(spark, d, "package_vulns").where("package.purl is not null")
    ids = rows.select(F.col("package.purl").alias("purl"), "source_path", F.explode("vulnerabilities").alias("v")).where("v.id is not null")
    return ids.select("purl", F.col("v.id").alias("advisory_id"), F.lit("class").alias("symbol_type"), F.col("source_path").alias("symbol_value"), F.substring_index("purl", "/", -1).alias("symbol_name")).distinct()


def _detections(spark, d) -> DataFrame:
    """Call sites are the places of the records: a package without a place is called nowhere."""
    places = table(spark, d, "package_vulns").where("package.purl is not null").select(F.substring_index("package.purl", "/", -1).alias("symbol_text"), F.explode("locations").alias("l"))
    sites = places.where("l.block is not null").select("symbol_text", F.col("l.block.file_name").alias("path"), *(F.col(f"l.block.{c}") for c in ("line_start", "line_end", "column_start", "column_end")))
    return reach.detect(_advisories(spark, d), sites)


def reach_join(spark, d):
    out = reach.pivot(_advisories(spark, d), _detections(spark, d))
    return out.select("purl", F.array_join("advisories", ",").alias("advisories"), F.array_join("reachable", ",").alias("reachable"))


def advisory_affects(spark, d):
    out = reach.affected_purls(reach.pivot(_advisories(spark, d), _detections(spark, d)))
    return out.select("advisory_id", F.array_join("affects", ",").alias("affects"))


def vulnerability_projection(spark, d):
    """What a document tells of each vulnerability."""
    rows = cyclonedx.vulnerability_rows(table(spark, d, "package_vulns"))
    joined = lambda c: F.array_join(c, ",", "-")
    return rows.select("id", "updated", "published", "rejected", "description", joined("references").alias("references"), joined("affects").alias("affects"), joined(F.transform("ratings", lambda r: F.concat(F.coalesce(r["method"], F.lit("-")), F.lit(" "), F.coalesce(r["vector"], F.lit("-"))))).alias("ratings"))


def vulnerability_json(spark, d):
    return table(spark, d, "package_vulns").select("pv_id", cyclonedx.vulnerability_json(F.col("vulnerabilities")).alias("json"))


def line_positions(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lines = positions.split_lines(F.col("text"))
    hit = positions.string_in_block(lines, "package")
    return docs.select("doc_id", F.size(lines).alias("n_lines"), hit["line_no"].alias("line_no"), hit["column_start"].alias("column_start"), hit["column_end"].alias("column_end"))


def line_columns(spark, d):
    """Columns of every line, tabs and characters beyond ASCII included."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(positions.split_lines(F.col("text"))).alias("i", "line"))
    return docs.select("doc_id", "i", positions.first_column(F.col("line")).alias("first_column"), positions.last_column(F.col("line")).alias("last_column"))


def json_sections(spark, d):
    rows = table(spark, d, "lockfiles").where("content is not null")
    return rows.select("lock_id", positions.json_section_line(F.col("content"), "packages").alias("line_no"), positions.json_pair(F.col("content"), "version").alias("version_pair"))


def json_props_explode(spark, d):
    events = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("prop", "value"))
    return events


def location_clean(spark, d):
    rows = _rows(spark, d)
    clean = positions.clean_locations(F.col("block"), F.col("name_loc"), F.col("version_loc"))
    return rows.select("row_id", clean.isNotNull().alias("valid"), clean["name"].isNotNull().alias("has_name"), clean["version"].isNotNull().alias("has_version"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_ranged_versions, dropped_reasons, purl_projection, purl_invalid, direct_purls, dev_group_flag, base_metadata, group_by_source, unidentified_rows,
        group_by_purl, merge_metadata_strict, last_wins_dedupe, ecosystem_list, render_lines, id_order, transitive_closure, closure_with_cycle,
        artifact_edges, reach_join, advisory_affects, vulnerability_projection, vulnerability_json, line_positions, line_columns, json_sections, json_props_explode, location_clean,
    )
}

_WITH_PKG = "WITH pkg AS (" + _PKG.replace("{lineitem}", "lineitem").replace("{part}", "part") + ")"
_TYPE = "CASE ecosystem WHEN 'Maven' THEN 'maven' WHEN 'Go' THEN 'golang' WHEN 'Packagist' THEN 'composer' WHEN 'PyPI' THEN 'pypi' WHEN 'RubyGems' THEN 'gem' WHEN 'NuGet' THEN 'nuget' WHEN 'npm' THEN 'npm' WHEN 'ConanCenter' THEN 'conan' WHEN 'crates.io' THEN 'cargo' WHEN 'Pub' THEN 'pub' WHEN 'Hex' THEN 'hex' WHEN 'CRAN' THEN 'cran' END"
_ENC = "replace(replace(url_encode({0}), '%2F', '/'), '%3A', ':')"
_PATH = f"""CASE ecosystem
  WHEN 'Maven' THEN CASE WHEN len(string_split(name, ':')) = 2 THEN CASE WHEN split_part(name, ':', 1) = '' THEN '' ELSE {_ENC.format("split_part(name, ':', 1)")} || '/' END || {_ENC.format("split_part(name, ':', 2)")} END
  WHEN 'Packagist' THEN CASE WHEN len(string_split(name, '/')) = 2 THEN CASE WHEN split_part(name, '/', 1) = '' THEN '' ELSE {_ENC.format("split_part(name, '/', 1)")} || '/' END || {_ENC.format("split_part(name, '/', 2)")} END
  WHEN 'Go' THEN CASE WHEN coalesce(name, '') <> '' THEN {_ENC.format("name")} END
  ELSE {_ENC.format("coalesce(name, '')")} END"""
_PURL = f"'pkg:' || ({_TYPE}) || '/' || ({_PATH}) || CASE WHEN coalesce(version, '') = '' THEN '' ELSE '@' || {_ENC.format('version')} END"
_ALL = "(coalesce(len(dep_groups), 0) > 0 AND coalesce(list_bool_and([coalesce({0}, false) for g in dep_groups]), false))"
_DEV = f"""coalesce(CASE
  WHEN ecosystem = 'npm' THEN {_ALL.format("g IN ('dev', 'optional')")} AND list_contains(dep_groups, 'dev')
  WHEN ecosystem IN ('Packagist', 'PyPI', 'Pub', 'NuGet') THEN {_ALL.format("g = 'dev'")}
  WHEN ecosystem = 'ConanCenter' THEN {_ALL.format("g = 'build-requires'")}
  WHEN ecosystem = 'Maven' THEN {_ALL.format("starts_with(g, 'test')")}
  WHEN ecosystem = 'RubyGems' THEN {_ALL.format("g IN ('dev', 'development', 'test', 'ci', 'cucumber', 'linting', 'rubocop')")}
  ELSE false END, false)"""
_NAMED = "(coalesce(ecosystem, '') <> '' AND coalesce(name, '') <> '')"
_JOINED = "array_to_string(list_sort(list_distinct({0})), ',')"
_NPM_NAME = "coalesce(name, nullif(regexp_extract(pkg_path, '.*node_modules/(.*)$', 1), ''))"
_ADVISORIES = """adv AS (SELECT DISTINCT purl, v.id AS advisory_id, source_path AS symbol_value, split_part(purl, '/', -1) AS symbol_name
  FROM (SELECT package.purl AS purl, source_path, unnest(vulnerabilities) AS v FROM package_vulns WHERE package.purl IS NOT NULL) WHERE v.id IS NOT NULL),
sites AS (SELECT symbol_text FROM (SELECT split_part(package.purl, '/', -1) AS symbol_text, unnest(locations) AS l FROM package_vulns WHERE package.purl IS NOT NULL) WHERE l.block IS NOT NULL),
hits AS (SELECT DISTINCT purl, advisory_id FROM adv WHERE symbol_name IN (SELECT symbol_text FROM sites) OR symbol_value || '.' || symbol_name IN (SELECT symbol_text FROM sites))"""

SQL = {
    "filter_ranged_versions": _WITH_PKG + " SELECT source_path, ecosystem, name, version, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM pkg WHERE NOT regexp_matches(version, '[,><]')",
    "dropped_reasons": _WITH_PKG + " SELECT ecosystem, CASE WHEN regexp_matches(version, '[,><]') THEN 'ranged version' ELSE 'no package url' END AS reason, count(*) AS n FROM pkg WHERE regexp_matches(version, '[,><]') OR ecosystem = 'Debian' GROUP BY ALL",
    "purl_projection": f"SELECT row_id, {_PURL} AS made_purl FROM package_rows",
    "purl_invalid": _WITH_PKG + " SELECT ecosystem, name, count(*) AS n FROM pkg WHERE ecosystem = 'Debian' GROUP BY ALL",
    "direct_purls": "SELECT DISTINCT purl FROM package_rows WHERE is_direct AND purl <> ''",
    "dev_group_flag": f"SELECT row_id, {_DEV} AS is_dev FROM package_rows",
    "base_metadata": f"SELECT row_id, CASE WHEN package_manager NOT IN ('', 'Unknown') THEN package_manager END AS manager, CASE WHEN is_direct THEN 'true' END AS direct, CASE WHEN {_DEV} THEN 'true' END AS dev FROM package_rows",
    "group_by_source": f"""SELECT source_path, count(*) AS n_packages, CAST(sum(CASE WHEN {_NAMED} THEN 0 ELSE 1 END) AS BIGINT) AS n_git, CAST(sum(CASE WHEN is_direct THEN 1 ELSE 0 END) AS BIGINT) AS n_direct,
  CAST(sum(CASE WHEN {_NAMED} AND {_DEV} THEN 1 ELSE 0 END) AS BIGINT) AS n_dev, min(CASE WHEN {_NAMED} THEN name || '@' || coalesce(version, '') ELSE '@' || "commit" END) AS first_package
FROM package_rows WHERE {_NAMED} OR coalesce("commit", '') <> '' GROUP BY source_path""",
    "unidentified_rows": f"""SELECT row_id FROM package_rows WHERE NOT ({_NAMED} OR coalesce("commit", '') <> '')""",
    "group_by_purl": f"""SELECT purl, arg_min({{'name': name, 'version': version, 'ecosystem': ecosystem}}, row_id).name AS name, arg_min({{'name': name, 'version': version, 'ecosystem': ecosystem}}, row_id).version AS version,
  arg_min({{'name': name, 'version': version, 'ecosystem': ecosystem}}, row_id).ecosystem AS ecosystem, count(*) AS n_rows, {_JOINED.format("flatten(list(coalesce(dep_groups, [])))")} AS dep_groups,
  bool_or(coalesce(is_direct, false)) AS is_direct, bool_and({_DEV}) AS is_dev, arg_min(package_manager, row_id) FILTER (WHERE package_manager IS NOT NULL) AS package_manager
FROM package_rows WHERE purl <> '' GROUP BY purl""",
    "merge_metadata_strict": f"""WITH r AS (SELECT purl, row_number() OVER (PARTITION BY purl ORDER BY row_id) AS k, {_DEV} AS dev, coalesce(is_direct, false) AS direct FROM package_rows WHERE purl <> '')
SELECT purl, bool_and(CASE WHEN k = 1 THEN dev ELSE direct END) AS is_dev FROM r GROUP BY purl""",
    "last_wins_dedupe": "SELECT source_path, name, version, is_direct, row_id FROM package_rows WHERE name IS NOT NULL AND version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path, name, version ORDER BY row_id DESC) = 1",
    "ecosystem_list": "SELECT DISTINCT ecosystem FROM package_rows WHERE ecosystem IS NOT NULL",
    "render_lines": """SELECT coalesce(ecosystem, '') || ': ' || coalesce(name, '') || '@' || coalesce(version, '') || CASE WHEN coalesce("commit", '') <> '' THEN ' (' || "commit" || ')' ELSE '' END AS line, count(*) AS n FROM package_rows GROUP BY 1""",
    "id_order": "SELECT DISTINCT v.id AS id, CASE split_part(v.id, '-', 1) WHEN 'CVE' THEN 0 WHEN 'GHSA' THEN 2 ELSE 1 END AS id_rank FROM (SELECT unnest(vulnerabilities) AS v FROM package_vulns) WHERE v.id IS NOT NULL",
    "transitive_closure": f"""WITH RECURSIVE e AS (SELECT DISTINCT source_path, {_NPM_NAME} AS a, unnest(map_keys(dependencies)) AS d FROM npm_packages),
r AS (SELECT * FROM e WHERE a IS NOT NULL UNION SELECT r.source_path, r.a, e.d FROM r JOIN e ON r.source_path = e.source_path AND r.d = e.a)
SELECT source_path, a AS ancestor, d AS node FROM r""",
    "closure_with_cycle": """WITH RECURSIVE e AS (SELECT DISTINCT source_path, parent_key AS a, child_key AS d FROM dep_links WHERE parent_key IS NOT NULL AND child_key IS NOT NULL),
r AS (SELECT * FROM e UNION SELECT r.source_path, r.a, e.d FROM r JOIN e ON r.source_path = e.source_path AND r.d = e.a)
SELECT source_path, a AS ancestor, d AS node FROM r""",
    "artifact_edges": f"""WITH f AS (SELECT name, version, min(filename) AS file FROM artifacts GROUP BY ALL)
SELECT ref, depends_on, count(*) AS n FROM (
  SELECT block.file_name AS ref, f.file AS depends_on FROM package_rows p JOIN f ON p.name = f.name AND p.version = f.version WHERE block.file_name IS NOT NULL
  UNION ALL SELECT filename, depends_on.filename FROM artifacts WHERE ({_PURL}) IS NOT NULL AND depends_on IS NOT NULL) GROUP BY ALL""",
    "reach_join": f"""WITH {_ADVISORIES}
SELECT a.purl, {_JOINED.format("list(a.advisory_id)")} AS advisories, coalesce({_JOINED.format("list(h.advisory_id) FILTER (WHERE h.advisory_id IS NOT NULL)")}, '') AS reachable
FROM adv a LEFT JOIN hits h ON a.purl = h.purl AND a.advisory_id = h.advisory_id GROUP BY a.purl""",
    "advisory_affects": f"""WITH {_ADVISORIES}
SELECT a.advisory_id, coalesce({_JOINED.format("list(h.purl) FILTER (WHERE h.purl IS NOT NULL)")}, '') AS affects
FROM adv a LEFT JOIN hits h ON a.purl = h.purl AND a.advisory_id = h.advisory_id GROUP BY a.advisory_id""",
    "vulnerability_projection": """WITH v AS (SELECT source_path, package.purl AS purl, unnest(vulnerabilities) AS v FROM package_vulns),
f AS (SELECT v FROM v WHERE v.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY source_path NULLS FIRST, purl NULLS FIRST) = 1)
SELECT v.id AS id, strftime(v.modified, '%Y-%m-%dT%H:%M:%SZ') AS updated, strftime(v.published, '%Y-%m-%dT%H:%M:%SZ') AS published, strftime(v.withdrawn, '%Y-%m-%dT%H:%M:%SZ') AS rejected, v.summary AS description,
  coalesce(array_to_string([coalesce(x, '-') FOR x IN v.aliases], ','), '') AS references, coalesce(array_to_string([coalesce(x.package.purl, '-') FOR x IN v.affected IF x.package IS NOT NULL], ','), '') AS affects,
  coalesce(array_to_string([CASE x.type WHEN 'CVSS_V2' THEN 'CVSSv2' WHEN 'CVSS_V3' THEN 'CVSSv3' WHEN 'CVSS_V4' THEN 'CVSSv4' ELSE '-' END || ' ' || coalesce(x.score, '-') FOR x IN v.severity IF x IS NOT NULL], ','), '') AS ratings FROM f""",
    "line_positions": """WITH t AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(lines) AS n_lines, list_position([contains(x, 'package') for x in lines], true) AS k, lines FROM t)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(nullif(coalesce(k, 0), 0) AS INTEGER) AS line_no, CAST(CASE WHEN k > 0 THEN instr(lines[k], 'package') END AS INTEGER) AS column_start, CAST(CASE WHEN k > 0 THEN instr(lines[k], 'package') + 7 END AS INTEGER) AS column_end FROM h""",
    "line_columns": r"""WITH t AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM t),
b AS (SELECT doc_id, i, line, regexp_replace(line, '^[ \t\n\v\f\r]+', '') AS behind, regexp_replace(line, '[ \t\n\v\f\r]+$', '') AS before FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN behind = '' THEN -1 ELSE length(line) - length(behind) + 1 END AS INTEGER) AS first_column, CAST(CASE WHEN behind = '' THEN -1 ELSE length(before) + 1 END AS INTEGER) AS last_column FROM b""",
    "json_sections": """SELECT lock_id, CAST(CASE WHEN regexp_matches(content, '"packages"\\s*:\\s*\\{') THEN len(string_split(regexp_replace(content, '(?s)"packages"\\s*:\\s*\\{.*', ''), chr(10))) ELSE -1 END AS INTEGER) AS line_no,
  regexp_extract(content, '"version"\\s*:\\s*"[^"]*"') AS version_pair FROM lockfiles WHERE content IS NOT NULL""",
    "json_props_explode": "SELECT event_id, k AS prop, CAST(json_extract(props, '$.' || k) AS INTEGER) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "location_clean": """WITH v AS (SELECT row_id, coalesce(block.file_name <> '' AND block.line_start > 0 AND block.line_end > 0, false) AS ok,
  coalesce(name_loc.file_name <> '' AND name_loc.line_start > 0 AND name_loc.line_end > 0 AND name_loc.column_start > 0 AND name_loc.column_end > 0, false) AS n,
  coalesce(version_loc.file_name <> '' AND version_loc.line_start > 0 AND version_loc.line_end > 0 AND version_loc.column_start > 0 AND version_loc.column_end > 0, false) AS w FROM package_rows)
SELECT row_id, ok AS valid, ok AND n AS has_name, ok AND w AS has_version FROM v""",
}
