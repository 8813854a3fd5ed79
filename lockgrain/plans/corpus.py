"""Queries of the general data problems, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.operators.drift import migrate, migration_report, schema_changes, schema_registry
from lockgrain.operators.eager import eager_join_aggregate, key_states
from lockgrain.operators.flatten import child_tables, flatten_locks, flatten_package_vulns
from lockgrain.operators.hierarchy import descendants, hierarchies
from lockgrain.session import table


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, source_path, child, parent) of the three tables that hold parent-child links."""
    art = table(spark, d, "artifacts")
    named = art.select(F.lit("artifacts").alias("tbl"), F.lit("").alias("source_path"), F.col("filename").alias("child"), F.col("depends_on.filename").alias("parent"))
    npm = table(spark, d, "npm_packages").select(
        "source_path", F.coalesce("name", F.nullif(F.regexp_extract("pkg_path", r"(?s).*node_modules/(.*)$", 1), F.lit(""))).alias("name"), "dependencies"
    )
    npm_links = npm.select("source_path", F.col("name").alias("parent"), F.explode_outer(F.map_keys("dependencies")).alias("child"))
    npm_rows = npm.select("source_path", F.col("name").alias("child"), F.lit(None).cast("string").alias("parent")).union(npm_links.select("source_path", "child", "parent"))
    dep = table(spark, d, "dep_links").select("source_path", F.col("child_key").alias("child"), F.col("parent_key").alias("parent"))
    return named.unionByName(npm_rows.select(F.lit("npm_packages").alias("tbl"), "source_path", "child", "parent")).unionByName(
        dep.select(F.lit("dep_links").alias("tbl"), "source_path", "child", "parent")
    )


def _spaced(links: DataFrame) -> DataFrame:
    return links.select(F.concat_ws("\u0001", "tbl", "source_path").alias("space"), "child", "parent")


def _unspaced(df: DataFrame) -> list:
    return [F.substring_index("space", "\u0001", 1).alias("tbl"), F.expr("substr(space, instr(space, '\u0001') + 1)").alias("source_path")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchies(_spaced(parent_links(spark, d)), with_paths=False)
    return nodes.select(*_unspaced(nodes), F.col("key").alias("node_key"), "root_key", "depth", "n_descendants")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchies(_spaced(parent_links(spark, d)))
    return nodes.select(*_unspaced(nodes), F.col("key").alias("node_key"), F.array_join("path", " > ").alias("path"), F.array_join("back_edges", " ").alias("closed_by"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = descendants(_spaced(parent_links(spark, d)))
    return pairs.select(*_unspaced(pairs), F.col("key").alias("node_key"), "descendant", "distance")


def _items(rows: DataFrame) -> DataFrame:
    """(field, item, source_path): one row per non-blank name and per non-blank purl."""
    kinds = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in ("name", "purl")))
    return rows.select("source_path", F.inline(kinds)).where("item is not null and item <> ''").select("field", "item", "source_path")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The operator's first half, since there is one input: states per (key, source), rolled up to the key."""
    states = key_states(_items(table(spark, d, "package_rows")), ["field", "item"], distinct={"n_sources": "source_path"})
    return states.select("field", "item", F.col("n").alias("n_rows"), "n_sources")


def p3_exposure(spark: SparkSession, d: str) -> DataFrame:
    """package_rows joined with the records of package_vulns of the same file: per file the joined rows and sums over them."""
    rows = table(spark, d, "package_rows").select("source_path", F.coalesce("is_direct", F.lit(False)).cast("long").alias("direct"))
    vulns = table(spark, d, "package_vulns").select("source_path", F.greatest(F.coalesce(F.size("vulnerabilities"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    joined = eager_join_aggregate(rows, vulns, ["source_path"], {"direct_pairs": F.col("direct")}, {"vulnerabilities": F.col("n")})
    return joined.select("source_path", "n_left", "n_right", "n_pairs", "direct_pairs", "vulnerabilities")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """package_rows joined with documents on the package name, per name: joined rows and sums over them."""
    rows = table(spark, d, "package_rows").where("name <> ''").select("name", F.col("is_direct").cast("long").alias("direct"))
    docs = table(spark, d, "documents").select(F.col("package_name").alias("name"), "n_chars")
    return eager_join_aggregate(rows, docs, ["name"], {"direct_pairs": F.col("direct")}, {"chars": F.col("n_chars")}).select("name", "n_pairs", "direct_pairs", "chars")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "lockfiles"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return migrate(table(spark, d, "lockfiles")).drop("steps").withColumn("extra", F.to_json("extra"))


def p4_steps(spark: SparkSession, d: str) -> DataFrame:
    return migration_report(table(spark, d, "lockfiles"))


def p4_schemas(spark: SparkSession, d: str) -> DataFrame:
    return schema_registry(table(spark, d, "lockfiles")).withColumn("steps", F.array_join("steps", "; "))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    locks = table(spark, d, "lockfiles").where("parsed_as = 'package-lock'").select("lock_id", "content")
    vulns = table(spark, d, "package_vulns").select("pv_id", "locations", "vulnerabilities")
    return flatten_locks(locks).unionByName(flatten_package_vulns(vulns))


def _child(path: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return child_tables(table(spark, d, "package_vulns"), "pv_id", "locations", "vulnerabilities")[path]

    return query


#: The related tables of package_vulns by query.
_CHILDREN = {
    "p6_locations": "locations", "p6_vulnerabilities": "vulnerabilities", "p6_aliases": "vulnerabilities.aliases", "p6_affected": "vulnerabilities.affected", "p6_affected_versions": "vulnerabilities.affected.versions",
    "p6_ranges": "vulnerabilities.affected.ranges", "p6_events": "vulnerabilities.affected.ranges.events", "p6_severity": "vulnerabilities.severity",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_documents, p3_exposure, p4_found, p4_table, p4_steps, p4_schemas, p6_found)} | {name: _child(path) for name, path in _CHILDREN.items()}

_VULNS = "v AS (SELECT pv_id, i - 1 AS at_1, v FROM (SELECT pv_id, unnest(vulnerabilities) AS v, unnest(range(1, len(vulnerabilities) + 1)) AS i FROM package_vulns) WHERE v IS NOT NULL)"
_AFFECTED = _VULNS + ", a AS (SELECT pv_id, at_1, i - 1 AS at_2, a FROM (SELECT pv_id, at_1, unnest(v.affected) AS a, unnest(range(1, len(v.affected) + 1)) AS i FROM v) WHERE a IS NOT NULL)"
_RANGES = _AFFECTED + ", r AS (SELECT pv_id, at_1, at_2, i - 1 AS at_3, r FROM (SELECT pv_id, at_1, at_2, unnest(a.ranges) AS r, unnest(range(1, len(a.ranges) + 1)) AS i FROM a) WHERE r IS NOT NULL)"


def _values(cte: str, of: str, keys: str, last: str, columns: str) -> str:
    """SQL of the table of an inner list: its parents' keys, the position and the wanted columns of element x."""
    return f"WITH {cte} SELECT {keys}, i - 1 AS {last}, {columns} FROM (SELECT {keys}, unnest({of}) AS x, unnest(range(1, len({of}) + 1)) AS i FROM {of.split('.')[0]}) WHERE x IS NOT NULL"


_SPOT = ", ".join(f"x.{p}.{c} AS {p}_{c}" for p in ("block", "namespace", "name", "version") for c in ("file_name", "line_start", "line_end", "column_start", "column_end"))
_CHILD_SQL = {
    "p6_locations": f"SELECT pv_id, i - 1 AS at_1, {_SPOT} FROM (SELECT pv_id, unnest(locations) AS x, unnest(range(1, len(locations) + 1)) AS i FROM package_vulns) WHERE x IS NOT NULL",
    "p6_vulnerabilities": f"WITH {_VULNS} SELECT pv_id, at_1, v.id, v.modified, v.published, v.withdrawn, v.summary FROM v",
    "p6_aliases": _values(_VULNS, "v.v.aliases", "pv_id, at_1", "at_2", "x AS value"),
    "p6_affected": f"WITH {_AFFECTED} SELECT pv_id, at_1, at_2, a.package.ecosystem AS package_ecosystem, a.package.name AS package_name, a.package.purl AS package_purl FROM a",
    "p6_affected_versions": _values(_AFFECTED, "a.a.versions", "pv_id, at_1, at_2", "at_3", "x AS value"),
    "p6_ranges": f"WITH {_RANGES} SELECT pv_id, at_1, at_2, at_3, r.type FROM r",
    "p6_events": _values(_RANGES, "r.r.events", "pv_id, at_1, at_2, at_3", "at_4", "x.introduced, x.fixed, x.last_affected"),
    "p6_severity": _values(_VULNS, "v.v.severity", "pv_id, at_1", "at_2", "x.type, x.score"),
}

_LINKS = """
links AS (
  SELECT 'artifacts' AS tbl, '' AS source_path, filename AS child, depends_on.filename AS parent FROM artifacts
  UNION ALL
  SELECT 'npm_packages', source_path, c, NULL FROM (SELECT source_path, coalesce(name, nullif(regexp_extract(pkg_path, '.*node_modules/(.*)$', 1), '')) AS c FROM npm_packages)
  UNION ALL
  SELECT 'npm_packages', source_path, unnest(map_keys(dependencies)), coalesce(name, nullif(regexp_extract(pkg_path, '.*node_modules/(.*)$', 1), '')) FROM npm_packages
  UNION ALL
  SELECT 'dep_links', source_path, child_key, parent_key FROM dep_links),
nodes AS (SELECT tbl, source_path, child AS k FROM links WHERE child IS NOT NULL UNION SELECT tbl, source_path, parent FROM links WHERE parent IS NOT NULL),
edges AS (SELECT DISTINCT tbl, source_path, parent AS a, child AS d FROM links WHERE child IS NOT NULL AND parent IS NOT NULL),
reach AS (SELECT tbl, source_path, a, d FROM edges UNION SELECT r.tbl, r.source_path, r.a, e.d FROM reach r JOIN edges e ON r.tbl = e.tbl AND r.source_path = e.source_path AND r.d = e.a)
"""

#: Readable contents: a JSON object behind a byte order mark.
_READABLE = """SELECT *, CAST(j AS JSON) AS doc FROM (SELECT *, ltrim(content, chr(65279)) AS j FROM lockfiles WHERE content IS NOT NULL) WHERE json_valid(j) AND json_type(TRY_CAST(j AS JSON)) = 'OBJECT'"""
#: Top-level fields with their kinds, and their values as sorted leaves, so that layout and order of keys don't matter.
_FIELDS = f"""
once AS (SELECT source_path, rev, arg_min(doc, lock_id) AS doc FROM ({_READABLE}) WHERE source_path IS NOT NULL AND rev IS NOT NULL GROUP BY source_path, rev),
each_field AS (SELECT source_path, rev, e.key AS name, e.type AS type, e.value AS value FROM once, json_each(doc) e WHERE e.type <> 'NULL'),
leaves AS (SELECT source_path, rev, f.name, list_sort(list(t.fullkey || '=' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) WHEN t.type IN ('OBJECT', 'ARRAY') THEN t.type ELSE t.type || ':' || coalesce(CAST(t.atom AS VARCHAR), '') END)) AS value FROM each_field f, json_tree(f.value) t GROUP BY ALL),
inner_kinds AS (SELECT source_path, rev, f.name, string_agg(DISTINCT CASE WHEN x.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE x.type END, '|' ORDER BY CASE WHEN x.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE x.type END) AS of FROM each_field f, json_each(f.value) x WHERE f.type = 'ARRAY' GROUP BY ALL),
fields AS (SELECT f.source_path, f.rev, f.name, CASE WHEN f.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN f.type = 'ARRAY' THEN 'array of ' || coalesce(k.of, '') ELSE f.type END AS kind, l.value
  FROM each_field f JOIN leaves l USING (source_path, rev, name) LEFT JOIN inner_kinds k USING (source_path, rev, name)),
pairs AS (SELECT source_path, rev, lag(rev) OVER (PARTITION BY source_path ORDER BY rev) AS before FROM once),
old AS (SELECT p.source_path, p.rev, f.name, f.kind, f.value FROM pairs p JOIN fields f ON p.source_path = f.source_path AND p.before = f.rev),
new AS (SELECT p.source_path, p.rev, f.name, f.kind, f.value FROM pairs p JOIN fields f ON p.source_path = f.source_path AND p.rev = f.rev WHERE p.before IS NOT NULL),
gone AS (SELECT *, row_number() OVER (PARTITION BY source_path, rev, value ORDER BY name) AS nth FROM old ANTI JOIN new USING (source_path, rev, name)),
come AS (SELECT *, row_number() OVER (PARTITION BY source_path, rev, value ORDER BY name) AS nth FROM new ANTI JOIN old USING (source_path, rev, name))
"""

SQL = {
    **_CHILD_SQL,
    "p4_found": f"""WITH {_FIELDS}
SELECT source_path, rev, CASE WHEN g.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'removed' ELSE 'renamed' END AS drift, coalesce(g.name, '') AS old_field, coalesce(c.name, '') AS new_field FROM gone g FULL JOIN come c USING (source_path, rev, value, nth)
UNION ALL SELECT source_path, rev, 'retyped', o.name, o.name FROM old o JOIN new n USING (source_path, rev, name) WHERE o.kind <> n.kind""",
    "p6_found": f"""WITH RECURSIVE docs AS (SELECT lock_id, doc FROM ({_READABLE}) WHERE parsed_as = 'package-lock'),
entries AS (SELECT lock_id, '' AS parent, e.key AS item, e.key AS here, e.value AS value FROM docs, json_each(doc -> 'dependencies') e WHERE json_type(doc -> 'dependencies') = 'OBJECT'
  UNION ALL SELECT lock_id, p.here, e.key, p.here || ' > ' || e.key, e.value FROM entries p, json_each(p.value -> 'dependencies') e WHERE json_type(p.value) = 'OBJECT' AND json_type(p.value -> 'dependencies') = 'OBJECT'),
vulns AS (SELECT pv_id, v.id AS id, v.affected AS affected FROM (SELECT pv_id, unnest(vulnerabilities) AS v FROM package_vulns) WHERE v IS NOT NULL),
affected AS (SELECT pv_id, id, i - 1 AS i, a FROM (SELECT pv_id, id, unnest(affected) AS a, unnest(range(1, len(affected) + 1)) AS i FROM vulns) WHERE a IS NOT NULL),
ranges AS (SELECT pv_id, id, i, j - 1 AS j, r FROM (SELECT pv_id, id, i, unnest(a.ranges) AS r, unnest(range(1, len(a.ranges) + 1)) AS j FROM affected) WHERE r IS NOT NULL)
SELECT 'dependency' AS kind, lock_id AS record_id, parent AS parent_path, item FROM entries
UNION ALL SELECT 'require', lock_id, here, e.key FROM entries p, json_each(p.value -> 'requires') e WHERE json_type(p.value) = 'OBJECT' AND json_type(p.value -> 'requires') = 'OBJECT'
UNION ALL SELECT 'location', pv_id, '', CAST(i - 1 AS VARCHAR) FROM (SELECT pv_id, unnest(locations) AS l, unnest(range(1, len(locations) + 1)) AS i FROM package_vulns) WHERE l IS NOT NULL
UNION ALL SELECT 'vulnerability', pv_id, '', id FROM vulns
UNION ALL SELECT 'affected', pv_id, id, CAST(i AS VARCHAR) FROM affected
UNION ALL SELECT 'event', pv_id, id || '/' || i || '/' || j, CAST(k - 1 AS VARCHAR) FROM (SELECT pv_id, id, i, j, unnest(r.events) AS e, unnest(range(1, len(r.events) + 1)) AS k FROM ranges) WHERE e IS NOT NULL""",
    "p2_paths": f"""WITH RECURSIVE {_LINKS},
ring AS (SELECT x.tbl, x.source_path, x.a AS k, min(x.d) AS least FROM reach x JOIN reach y ON x.tbl = y.tbl AND x.source_path = y.source_path AND x.a = y.d AND x.d = y.a GROUP BY ALL),
under AS (SELECT DISTINCT r.tbl, r.source_path, r.d AS k FROM reach r JOIN ring g ON r.tbl = g.tbl AND r.source_path = g.source_path AND r.a = g.k),
roots AS (SELECT n.* FROM nodes n ANTI JOIN edges e ON e.tbl = n.tbl AND e.source_path = n.source_path AND e.d = n.k),
tree AS (SELECT tbl, source_path, k, k AS root, 0 AS depth, k AS path FROM roots
  UNION ALL SELECT * FROM (SELECT t.tbl, t.source_path, e.d, t.root, t.depth + 1, t.path || ' > ' || e.d FROM tree t JOIN edges e ON t.tbl = e.tbl AND t.source_path = e.source_path AND t.k = e.a
    WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.tbl = e.tbl AND u.source_path = e.source_path AND u.k = e.d) AND NOT EXISTS (SELECT 1 FROM ring g WHERE g.tbl = e.tbl AND g.source_path = e.source_path AND g.k = e.d))),
best AS (SELECT tbl, source_path, k, min({{'depth': depth, 'root': root, 'path': path}}).path AS path FROM tree GROUP BY ALL),
walk AS (SELECT DISTINCT tbl, source_path, least, least AS k, 0 AS far FROM ring
  UNION SELECT w.tbl, w.source_path, w.least, e.d, w.far + 1 FROM walk w JOIN edges e ON w.tbl = e.tbl AND w.source_path = e.source_path AND w.k = e.a JOIN ring g ON g.tbl = e.tbl AND g.source_path = e.source_path AND g.k = e.d AND g.least = w.least
    WHERE w.far < (SELECT max(c) FROM (SELECT count(*) AS c FROM ring GROUP BY tbl, source_path, least))),
spot AS (SELECT tbl, source_path, least, k, min(far) AS far FROM walk GROUP BY ALL),
back AS (SELECT e.tbl, e.source_path, e.d AS k, string_agg(e.a, ' ' ORDER BY e.a) AS closed_by FROM edges e JOIN spot x ON x.tbl = e.tbl AND x.source_path = e.source_path AND x.k = e.a JOIN spot y ON y.tbl = e.tbl AND y.source_path = e.source_path AND y.k = e.d AND y.least = x.least
  WHERE y.far < x.far OR (y.far = x.far AND y.k <= x.k) GROUP BY ALL)
SELECT n.tbl, n.source_path, n.k AS node_key, b.path, c.closed_by FROM nodes n LEFT JOIN best b ON n.tbl = b.tbl AND n.source_path = b.source_path AND n.k = b.k LEFT JOIN back c ON n.tbl = c.tbl AND n.source_path = c.source_path AND n.k = c.k""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS},
far AS (SELECT tbl, source_path, a, d, 1 AS n FROM edges UNION SELECT f.tbl, f.source_path, f.a, e.d, f.n + 1 FROM far f JOIN edges e ON f.tbl = e.tbl AND f.source_path = e.source_path AND f.d = e.a WHERE f.n < 200)
SELECT r.tbl, r.source_path, r.a AS node_key, r.d AS descendant, CAST(min(f.n) AS INTEGER) AS distance FROM reach r JOIN far f ON r.tbl = f.tbl AND r.source_path = f.source_path AND r.a = f.a AND r.d = f.d WHERE r.a <> r.d GROUP BY ALL""",
    "p2_found": f"""WITH RECURSIVE {_LINKS},
ring AS (SELECT x.tbl, x.source_path, x.a AS k, min(x.d) AS least FROM reach x JOIN reach y ON x.tbl = y.tbl AND x.source_path = y.source_path AND x.a = y.d AND x.d = y.a GROUP BY ALL),
under AS (SELECT r.tbl, r.source_path, r.d AS k, min(g.least) AS least FROM reach r JOIN ring g ON r.tbl = g.tbl AND r.source_path = g.source_path AND r.a = g.k GROUP BY ALL),
ups AS (SELECT tbl, source_path, d AS k, count(*) AS n FROM reach GROUP BY ALL),
tops AS (SELECT r.tbl, r.source_path, r.d AS k, min(r.a) AS top FROM reach r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.tbl = r.tbl AND e.source_path = r.source_path AND e.d = r.a) GROUP BY ALL),
downs AS (SELECT tbl, source_path, a AS k, count(*) AS n FROM reach WHERE a <> d GROUP BY ALL)
SELECT n.tbl, n.source_path, n.k AS node_key, coalesce(g.least, u.least, t.top, n.k) AS root_key,
  CAST(CASE WHEN g.k IS NOT NULL THEN -1 WHEN u.k IS NOT NULL THEN -2 ELSE coalesce(p.n, 0) END AS INTEGER) AS depth,
  CAST(coalesce(w.n, 0) AS BIGINT) AS n_descendants
FROM nodes n
LEFT JOIN ring g ON n.tbl = g.tbl AND n.source_path = g.source_path AND n.k = g.k
LEFT JOIN under u ON n.tbl = u.tbl AND n.source_path = u.source_path AND n.k = u.k
LEFT JOIN ups p ON n.tbl = p.tbl AND n.source_path = p.source_path AND n.k = p.k
LEFT JOIN tops t ON n.tbl = t.tbl AND n.source_path = t.source_path AND n.k = t.k
LEFT JOIN downs w ON n.tbl = w.tbl AND n.source_path = w.source_path AND n.k = w.k""",
    "p3_found": """SELECT field, item, count(*) AS n_rows, count(DISTINCT source_path) AS n_sources FROM (
  SELECT 'name' AS field, name AS item, source_path FROM package_rows UNION ALL SELECT 'purl', purl, source_path FROM package_rows)
WHERE item IS NOT NULL AND item <> '' GROUP BY field, item""",
    "p3_exposure": """SELECT r.source_path, count(DISTINCT r.row_id) AS n_left, count(DISTINCT v.pv_id) AS n_right, count(*) AS n_pairs, CAST(sum(CAST(coalesce(is_direct, false) AS BIGINT)) AS BIGINT) AS direct_pairs,
  CAST(sum(coalesce(len(vulnerabilities), 0)) AS BIGINT) AS vulnerabilities FROM package_rows r JOIN package_vulns v ON r.source_path = v.source_path GROUP BY r.source_path""",
    "p3_documents": """SELECT r.name AS name, count(*) AS n_pairs, CAST(sum(CAST(is_direct AS BIGINT)) AS BIGINT) AS direct_pairs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM package_rows r JOIN documents d ON r.name = d.package_name WHERE r.name <> '' GROUP BY r.name""",
}
