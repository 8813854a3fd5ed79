"""Queries of the lockfile parsers and their manifests, by a round trip: rows become files, a scan's code reads them again.

The rows of package_rows are written as files of each package manager (a folder for 1024 row numbers, of a folder's rows
with one name the last), with the manifests that go beside them, and read by ``parse_lockfiles``. The SQL says what must
come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.session import table
from lockgrain.sources.lockfiles import packages_of, parse_as, parse_lockfiles
from lockgrain.sources.poms import decode_poms, pom_chains, pom_packages

FOLDER = 10  # rows of a folder: 2**FOLDER row numbers


def _rows(spark, d, manager: str) -> DataFrame:
    """(dir, name, row_id, version, direct, grp): the last row of each name in a folder."""
    rows = table(spark, d, "package_rows").where((F.col("package_manager") == manager) & F.col("name").isNotNull() & F.col("version").isNotNull())
    rows = rows.select(F.concat(F.lit("/p/"), F.shiftright("row_id", FOLDER).cast("string")).alias("dir"), "name", "row_id", "version", F.coalesce("is_direct", F.lit(False)).alias("direct"), F.coalesce(F.get("dep_groups", F.lit(0)), F.lit("")).alias("grp"))
    return rows.groupBy("dir", "name").agg(F.max_by(F.struct("row_id", "version", "direct", "grp"), "row_id").alias("r")).select("dir", "name", "r.*")


def _q(c: str | Column) -> Column:
    """A text in double quotes, as JSON, TOML and YAML read it."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def _t(*parts: str | Column) -> Column:
    """Columns and literal texts, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _file(rows: DataFrame, name: str, *parts: str | tuple) -> DataFrame:
    """(path, text): of each folder one file, made of texts and of (line, condition, separator) for its rows in order."""
    lines = [p for p in parts if not isinstance(p, str)]
    lists = [F.sort_array(F.collect_list(F.when(F.lit(True) if c is None else c, F.struct("row_id", line.alias("x"))))).alias(f"l{i}") for i, (line, c, _) in enumerate(lines)]
    made = rows.groupBy("dir").agg(*lists)
    at = iter(range(len(lines)))
    joined = lambda i, sep: F.array_join(F.transform(f"l{i}", lambda s: s["x"]), sep)
    text = _t(*(p if isinstance(p, str) else joined(next(at), p[2]) for p in parts))
    return made.select(F.concat("dir", F.lit("/" + name)).alias("path"), text.alias("text"))


def _package_json(rows: DataFrame) -> DataFrame:
    """Direct packages by section, one on each line."""
    pair = _t("    ", _q("name"), ": ", _q(_t("^", F.col("version"))))
    return _file(rows, "package.json", '{\n  "devDependencies": {\n', (pair, F.col("direct") & (F.col("grp") == "dev"), ",\n"), '\n  },\n  "dependencies": {\n', (pair, F.col("direct") & (F.col("grp") != "dev"), ",\n"), "\n  }\n}\n")


def _cargo(r):
    return _file(r, "Cargo.lock", (_t("[[package]]\nname = ", _q("name"), "\nversion = ", _q("version")), None, "\n\n"))


def _composer(r):
    entry = _t('{"name": ', _q("name"), ', "version": ', _q("version"), ', "dist": {"reference": "c', F.col("row_id").cast("string"), '"}}')
    lock = _file(r, "composer.lock", '{"packages": [', (entry, F.col("grp") != "dev", ", "), '], "packages-dev": [', (entry, F.col("grp") == "dev", ", "), "]}")
    pair = _t("  ", _q("name"), ": ", _q(_t("^", F.col("version"))))
    return lock.union(_file(r, "composer.json", '{"require": {\n', (pair, F.col("direct") & (F.col("grp") != "dev"), ",\n"), '},\n"require-dev": {\n', (pair, F.col("direct") & (F.col("grp") == "dev"), ",\n"), "}}"))


def _conan(r):
    reference = _q(_t(F.col("name"), "/", F.col("version"), "#rev%1.5"))
    return _file(r, "conan.lock", '{"version": "0.5", "requires": [', (reference, F.col("grp") != "dev", ", "), '], "build_requires": [', (reference, F.col("grp") == "dev", ", "), "]}")


def _bundler(r):
    lock = _file(r, "Gemfile.lock", "GEM\n  remote: https://gems.example/\n  specs:\n", (_t("    ", F.col("name"), " (", F.col("version"), ")\n      below (>= 1)"), None, "\n"), "\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n", (_t("  ", F.col("name")), F.col("direct"), "\n"), "\n")
    gem = _file(r, "Gemfile", "source 'https://gems.example'\n", (_t("gem '", F.col("name"), "', '~> ", F.col("version"), "', group: :", F.when(F.col("grp") == "", "web").otherwise(F.col("grp"))), F.col("direct") & (F.col("grp") != "dev"), "\n"), "\n")
    spec = _file(r, "x.gemspec", "Gem::Specification.new do |s|\n", (_t("  s.add_development_dependency '", F.col("name"), "', '>= 1'"), F.col("direct") & (F.col("grp") == "dev"), "\n"), "\nend\n")
    return lock.union(gem).union(spec)


def _go(r):
    return _file(r, "go.mod", "module m\n\ngo 1.21\n\nrequire (\n", (_t("\t", F.col("name"), " v", F.col("version"), F.when(F.col("direct"), "").otherwise(" // indirect")), None, "\n"), "\n)\n")


def _gradle(r):
    lock = _file(r, "gradle.lockfile", "# made\n", (_t(F.col("name"), ":", F.col("version"), "=", F.when(F.col("grp") == "", "main").otherwise(F.col("grp"))), None, "\n"), "\nempty=\n")
    line = _t(F.when(F.col("grp") == "test", "runtimeOnly").otherwise("implementation"), ' "', F.col("name"), ":", F.col("version"), '"')
    return lock.union(_file(r, "build.gradle", (line, F.col("direct"), "\n")))


def _verification(r):
    component = _t('<component group="', F.substring_index("name", ":", 1), '" name="', F.substring_index("name", ":", -1), '" version="', F.col("version"), '"/>')
    return _file(r, "gradle/verification-metadata.xml", '<?xml version="1.0" encoding="UTF-8"?>\n<verification-metadata xmlns="urn:x"><components>', (component, None, "\n"), "</components></verification-metadata>")


def _mix(r):
    return _file(r, "mix.lock", "%{\n", (_t('  "', F.col("name"), '": {:hex, :', F.col("name"), ', "', F.col("version"), '", "h', F.col("row_id").cast("string"), '", [:mix], []},'), None, "\n"), "\n}\n")


def _npm(r):
    pair = _t(_q("name"), ": ", _q(_t("^", F.col("version"))))
    entry = _t(_q(_t("node_modules/", F.col("name"))), ': {"version": ', _q("version"), ', "dev": ', F.when(F.col("grp") == "dev", "true").otherwise("false"), "}")
    return _file(r, "package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"dependencies": {', (pair, F.col("direct"), ", "), '}}, "nothing": {"link": true}', (_t(", ", entry), None, ""), "}}").union(_package_json(r))


def _yarn(r):
    stanza = _t('"', F.col("name"), "@^", F.col("version"), '":\n  version "', F.col("version"), '"\n  resolved "https://github.com/o/r.git#c', F.col("row_id").cast("string"), '"')
    return _file(r, "yarn.lock", "# yarn lockfile v1\n\n", (stanza, None, "\n\n"), "\n").union(_package_json(r))


def _pnpm(r):
    declared = _t("  ", _q("name"), ": {specifier: ", _q(_t("^", F.col("version"))), ", version: ", _q("version"), "}")
    entry = _t("  ", _q(_t("/", F.col("name"), "@", F.col("version"))), ": {name: ", _q("name"), ", version: ", _q("version"), ", dev: ", F.when(F.col("grp") == "dev", "true").otherwise("false"), "}")
    return _file(r, "pnpm-lock.yaml", "lockfileVersion: '6.0'\ndependencies:\n", (declared, F.col("direct"), "\n"), "\npackages:\n", (entry, None, "\n"), "\n").union(_package_json(r))


def _nuget(r):
    entry = _t(_q("name"), ': {"type": ', F.when(F.col("direct"), '"Direct"').otherwise('"Transitive"'), ', "resolved": ', _q("version"), "}")
    project = _t('    <PackageReference Include="', F.col("name"), '" Version="', F.col("version"), '"', F.when(F.col("grp") == "dev", ' PrivateAssets="all"').otherwise(""), " />")
    return _file(r, "packages.lock.json", '{"version": 1, "dependencies": {"net8.0": {', (entry, None, ", "), "}}}").union(_file(r, "x.csproj", "<Project>\n  <ItemGroup>\n", (project, F.col("direct"), "\n"), "\n  </ItemGroup>\n</Project>\n"))


def _pdm(r):
    groups = F.when(F.col("grp") == "", '["default"]').otherwise(_t("[", _q("grp"), "]"))
    return _file(r, "pdm.lock", (_t("[[package]]\nname = ", _q("name"), "\nversion = ", _q("version"), "\ngroups = ", groups), None, "\n\n"))


def _pipenv(r):
    entry = _t(_q("name"), ': {"version": ', _q(_t("==", F.col("version"))), "}")
    lock = _file(r, "Pipfile.lock", '{"default": {', (entry, F.col("grp") != "dev", ", "), '}, "develop": {', (entry, F.col("grp") == "dev", ", "), "}}")
    return lock.union(_file(r, "Pipfile", "[packages]\n", (_t(F.col("name"), ' = "*"'), F.col("direct"), "\n"), "\n"))


def _poetry(r):
    lock = _file(r, "poetry.lock", (_t("[[package]]\nname = ", _q("name"), "\nversion = ", _q("version"), "\noptional = ", F.when(F.col("grp") == "optional", "true").otherwise("false")), None, "\n\n"))
    line = _t(F.col("name"), ' = "^', F.col("version"), '"')
    return lock.union(_file(r, "pyproject.toml", "[tool.poetry.dependencies]\n", (line, F.col("direct") & (F.col("grp") != "dev"), "\n"), "\n\n[tool.poetry.dev-dependencies]\n", (line, F.col("direct") & (F.col("grp") == "dev"), "\n"), "\n"))


def _pub(r):
    kind = F.when(F.col("direct") & (F.col("grp") == "dev"), "direct dev").when(F.col("direct"), "direct main").otherwise("transitive")
    return _file(r, "pubspec.lock", "packages:\n", (_t("  ", _q("name"), ":\n    dependency: ", _q(kind), "\n    version: ", _q("version")), None, "\n"), "\n")


def _renv(r):
    return _file(r, "renv.lock", '{"Packages": {', (_t(_q("name"), ': {"Package": ', _q("name"), ', "Version": ', _q("version"), ', "Repository": "CRAN"}'), None, ", "), "}}")


def _requirements(r):
    return _file(r, "requirements.txt", "# by hand\n", (_t(F.col("name"), "==", F.col("version"), F.when(F.col("direct"), "").otherwise(" ; python_version > '3'")), None, "\n"), "\n")


def _parsed(manager: str, made):
    def query(spark, d):
        found = packages_of(parse_lockfiles(made(_rows(spark, d, manager))))
        return found.select(F.regexp_extract("source_path", "^(/p/[0-9]+)/", 1).alias("dir"), "name", "version", "is_direct", F.array_join("dep_groups", ",").alias("dep_groups"), F.coalesce("block.line_start", F.lit(-1)).alias("line"))

    return query


# --- poms -----------------------------------------------------------------------------------------------------------


def _dependency(*fields: tuple[str, Column]) -> Column:
    return _t("<dependency>", *(x for tag, c in fields for x in (f"<{tag}>", c, f"</{tag}>")), "</dependency>")


def parse_pom(spark, d):
    """Poms with dependencies whose versions come from a property or, in every third row, from the managed ones."""
    rows = _rows(spark, d, "Maven")
    group, artifact = F.substring_index("name", ":", 1), F.substring_index("name", ":", -1)
    managed = F.col("row_id") % 3 == 0
    plain = _dependency(("groupId", group), ("artifactId", artifact), ("version", _t("${v", F.col("row_id").cast("string"), "}")), ("scope", F.when(F.col("grp") == "", "compile").otherwise(F.col("grp"))))
    bare, full = _dependency(("groupId", group), ("artifactId", artifact)), _dependency(("groupId", group), ("artifactId", artifact), ("version", _t("[", F.col("version"), ",)")))
    number = F.col("row_id").cast("string")
    text = _file(
        rows, "pom.xml", "<project>\n<groupId>g</groupId><artifactId>a</artifactId><version>1</version>\n<properties>", (_t("<v", number, ">", F.col("version"), "</v", number, ">"), ~managed, ""), "</properties>\n<dependencyManagement><dependencies>",
        (full, managed, ""), "</dependencies></dependencyManagement>\n<dependencies>\n", (F.when(managed, bare).otherwise(plain), None, "\n"), "\n</dependencies>\n</project>\n",
    )
    found = pom_packages(pom_chains(decode_poms(text)))
    return found.select(F.regexp_extract("source_path", "^(/p/[0-9]+)/", 1).alias("dir"), "name", "version", "is_direct", F.array_join("dep_groups", ",").alias("dep_groups"), F.col("block.line_start").alias("line"))


def pom_inheritance(spark, d):
    """The artifacts as poms, each with its first parent: a dependency's version is the property nearest up the chain."""
    art = table(spark, d, "artifacts").where("filename is not null")
    one = art.groupBy("filename").agg(F.min("version").alias("version"), F.min("depends_on.filename").alias("up"))
    parent = F.when(F.col("up").isNull(), "").otherwise(_t("<parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version><relativePath>/p/", F.sha2("up", 256), "/pom.xml</relativePath></parent>"))
    own = F.when(F.col("version").isNull(), "").otherwise(_t("<properties><own>", F.col("version"), "</own></properties>"))
    text = _t("<project>", parent, "<artifactId>a</artifactId>", own, "<dependencies><dependency><groupId>g</groupId><artifactId>x</artifactId><version>${own}</version></dependency></dependencies></project>")
    poms = one.select(_t("/p/", F.sha2("filename", 256), "/pom.xml").alias("path"), text.alias("text"))
    return pom_packages(pom_chains(decode_poms(poms))).select(F.regexp_extract("source_path", "^/p/([0-9a-f]+)/", 1).alias("pom"), "version")


# --- links ----------------------------------------------------------------------------------------------------------


def _npm_nodes(spark, d) -> DataFrame:
    """(dir, name, below, dev): one row per name of a source, with the names it depends on."""
    name = F.coalesce("name", F.nullif(F.regexp_extract("pkg_path", r"(?s).*node_modules/(.*)$", 1), F.lit("")))
    rows = table(spark, d, "npm_packages").select(F.md5("source_path").alias("key"), name.alias("name"), F.map_keys("dependencies").alias("below"), "dev").where("name is not null")
    nodes = rows.groupBy(F.concat(F.lit("/p/"), "key").alias("dir"), "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("below")))).alias("below"), F.bool_and(F.coalesce("dev", F.lit(False))).alias("dev"))
    return nodes.withColumn("row_id", F.col("name"))


def propagate_groups(spark, d):
    """Groups that package.json gives to some packages go down the links of a yarn.lock to all below."""
    nodes = _npm_nodes(spark, d)
    wants = F.array_join(F.transform("below", lambda c: _t("\n    ", _q(c), ' "*"')), "")
    stanza = _t(_q(_t(F.col("name"), "@*")), ':\n  version "1"', F.when(F.size("below") > 0, _t("\n  dependencies:", wants)).otherwise(""))
    pair = _t(_q("name"), ': "*"')
    files = _file(nodes, "yarn.lock", "# yarn lockfile v1\n\n", (stanza, None, "\n\n"), "\n").union(_file(nodes, "package.json", '{"dependencies": {', (pair, ~F.col("dev"), ", "), '}, "devDependencies": {', (pair, F.col("dev"), ", "), "}}"))
    found = packages_of(parse_lockfiles(files))
    return found.select(F.substring_index("source_path", "/", 3).alias("dir"), F.col("name").alias("node"), F.explode("dep_groups").alias("grp"))


def pnpm_closure(spark, d):
    """What hangs below the packages that aren't for development, by the links of a pnpm-lock.yaml."""
    nodes = _npm_nodes(spark, d)
    root = _t("      ", _q("name"), ': {specifier: "*", version: "1"}')
    below = F.array_join(F.transform("below", lambda c: _t(_q(c), ': "1"')), ", ")
    snapshot = _t("  ", _q(_t(F.col("name"), "@1")), ": {dependencies: {", below, "}}")
    files = _file(nodes, "pnpm-lock.yaml", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n", (root, ~F.col("dev"), "\n"), "\npackages: {}\nsnapshots:\n", (snapshot, None, "\n"), "\n")
    found = packages_of(parse_lockfiles(files))
    return found.select(F.substring_index("source_path", "/", 3).alias("dir"), F.col("name").alias("node"), "is_direct", F.array_join("dep_groups", ",").alias("dep_groups"))


def npm_group_merge(spark, d):
    """A package that stands at several places of a package-lock.json has the groups of all of them."""
    rows = table(spark, d, "package_rows").where("package_manager = 'NPM' and name is not null and version is not null")
    has = lambda g: F.coalesce(F.array_contains("dep_groups", g), F.lit(False))
    rows = rows.select(F.concat(F.lit("/p/"), F.shiftright("row_id", FOLDER).cast("string")).alias("dir"), "row_id", "name", "version", has("dev").alias("dev"), has("optional").alias("optional"))
    entry = _t(_q(_t("node_modules/x", F.col("row_id").cast("string"), "/node_modules/", F.col("name"))), ': {"version": ', _q("version"), ', "dev": ', F.col("dev").cast("string"), ', "optional": ', F.col("optional").cast("string"), "}")
    found = packages_of(parse_lockfiles(_file(rows, "package-lock.json", '{"packages": {', (entry, None, ", "), "}}")))
    return found.select(F.substring_index("source_path", "/", 3).alias("dir"), "name", "version", F.array_join("dep_groups", ",").alias("dep_groups"))


def url_commit_extract(spark, d):
    """Commits of the addresses that a yarn.lock resolves to, in several forms."""
    rows = table(spark, d, "npm_packages").where("resolved is not null")
    number = F.col("npm_id").cast("string")
    forms = F.array(
        F.col("resolved"), _t("git+ssh://git@github.com/o/", F.coalesce("name", F.lit("")), ".git#c", number), _t("https://codeload.github.com/o/r/tar.gz/a", number), _t("https://github.com/o/r?ref=b", number), F.lit("https://gitlab.com/o/r#main"),
    )
    each = rows.select(F.concat(F.lit("/p/"), F.shiftright("npm_id", FOLDER).cast("string")).alias("dir"), F.col("npm_id").alias("row_id"), F.posexplode(forms).alias("form", "url"))
    stanza = _t('"n', F.col("row_id").cast("string"), "-", F.col("form").cast("string"), '@1":\n  version "1"\n  resolved "', F.col("url"), '"')
    found = packages_of(parse_lockfiles(_file(each, "yarn.lock", (stanza, None, "\n\n"), "\n")))
    part = lambda i: F.regexp_extract("name", "^n([0-9]+)-([0-9])$", i)
    return found.select(part(1).cast("long").alias("npm_id"), part(2).cast("int").alias("form"), F.col("commit").alias("commit_id"))


def _places(c: str) -> list[Column]:
    return [F.col(f"{c}.{n}").alias(f"{c}_{n}") for n in ("line_start", "column_start", "column_end")]


def go_mod_places(spark, d):
    """Where go.mod names each package: the whole requirement, its name and its version."""
    found = packages_of(parse_lockfiles(_go(_rows(spark, d, "Golang")))).where("name <> 'stdlib'")
    return found.select(F.substring_index("source_path", "/", 3).alias("dir"), "name", *_places("block"), *_places("name_loc"))


def poetry_places(spark, d):
    """Where pyproject.toml declares each package: the last line that holds its name, the name and the wanted version."""
    found = packages_of(parse_lockfiles(_poetry(_rows(spark, d, "Poetry")))).where("block is not null")
    return found.select(F.substring_index("source_path", "/", 3).alias("dir"), "name", *_places("block"), *_places("name_loc"), *_places("version_loc"))


# --- formats that only a named parser reads -------------------------------------------------------------------------


def _all_named(spark, d) -> DataFrame:
    return table(spark, d, "package_rows").where("name <> '' and version <> ''").select(
        F.concat(F.lit("/p/"), F.shiftright("row_id", FOLDER).cast("string")).alias("dir"), "row_id", "name", "version", F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), F.coalesce("commit", F.lit("")).alias("commit")
    )


def _read_as(parser: str, name: str, parts):
    def query(spark, d):
        found = parse_as(_file(_all_named(spark, d), name, *parts()), parser)
        keys = [F.regexp_extract("source_path", "^(/p/[0-9]+)/", 1).alias("dir"), "name", "version", "ecosystem", F.col("commit").alias("commit_id")]
        return found.groupBy(*keys).agg(F.count("*").alias("n"))

    return query


_FIELD = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
_FORMATS = {
    "cargo": ("Crates", _cargo), "composer": ("Composer", _composer), "conan": ("Conan", _conan), "bundler": ("Bundler", _bundler), "go_mod": ("Golang", _go), "gradle": ("Gradle", _gradle),
    "gradle_verification": ("Gradle", _verification), "mix": ("Hex", _mix), "npm": ("NPM", _npm), "yarn": ("Yarn", _yarn), "pnpm": ("Pnpm", _pnpm), "nuget": ("NuGet", _nuget), "pdm": ("Pdm", _pdm),
    "pipenv": ("Pipfile", _pipenv), "poetry": ("Poetry", _poetry), "pub": ("Pub", _pub), "renv": ("Renv", _renv), "requirements": ("Requirements", _requirements),
}
QUERIES = {
    **{f"parse_{k}": _parsed(*v) for k, v in _FORMATS.items()},
    "parse_pom": parse_pom,
    "pom_inheritance": pom_inheritance,
    "propagate_groups": propagate_groups,
    "pnpm_closure": pnpm_closure,
    "npm_group_merge": npm_group_merge,
    "url_commit_extract": url_commit_extract,
    "go_mod_places": go_mod_places,
    "poetry_places": poetry_places,
    "parse_csv": _read_as("csv", "x.csv", lambda: ((_t(_q("ecosystem"), ",,", _q("name"), ",", _q("version")), F.col("ecosystem") != "", "\n"), "\n")),
    "parse_results": _read_as("results", "x.json", lambda: ('{"results": [{"packages": [', (_t('{"package": {"name": ', _q("name"), ', "version": ', _q("version"), ', "ecosystem": ', _q("ecosystem"), ', "commit": ', _q("commit"), "}}"), None, ", "), "]}]}")),
    "parse_apk": _read_as("apk-installed", "installed", lambda: ((_t("C:Q1\nP:", _FIELD("name"), "\nV:", _FIELD("version"), "\nc:", _FIELD("commit")), None, "\n\n"), "\n")),
    "parse_dpkg": _read_as("dpkg-status", "status", lambda: ((_t("Package: ", _FIELD("name"), "\nStatus: ", F.when(F.col("commit") == "", "install ok installed").otherwise("deinstall ok config-files"), "\nVersion: 0\nSource: ", _FIELD("name"), " (", _FIELD("version"), ")"), None, "\n\n"), "\n")),
}
for _name, _query in QUERIES.items():
    _query.__name__ = _name

_P = """p AS (SELECT '/p/' || (row_id >> 10) AS dir, name, max(row_id) AS row_id, arg_max(version, row_id) AS version, arg_max(coalesce(is_direct, false), row_id) AS direct, arg_max(coalesce(dep_groups[1], ''), row_id) AS grp
FROM package_rows WHERE package_manager = '{}' AND name IS NOT NULL AND version IS NOT NULL GROUP BY ALL)"""
_DIRECT_LINES = "d AS (SELECT dir, name, {head} + CAST(row_number() OVER (PARTITION BY dir{part} ORDER BY row_id) AS INTEGER) AS line FROM p WHERE direct{where})"
#: Lines of _package_json: the development section first, then four lines and the others. A blank section has one line.
_JSON_LINES = """n AS (SELECT dir, greatest(1, count(*) FILTER (WHERE direct AND grp = 'dev')) AS devs FROM p GROUP BY dir),
d AS (SELECT p.dir, name, grp = 'dev' AS dev, CAST(CASE WHEN grp = 'dev' THEN 2 ELSE 4 + devs END + row_number() OVER (PARTITION BY p.dir, grp = 'dev' ORDER BY row_id) AS INTEGER) AS line FROM p JOIN n ON p.dir = n.dir WHERE direct)"""


def _sql(manager: str, direct: str = "false", groups: str = "''", line: str = "-1", version: str = "version", extra: str = "", tail: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {_P.format(manager)}{more}\nSELECT DISTINCT p.dir, p.name, {version} AS version, {direct} AS is_direct, {groups} AS dep_groups, CAST({line} AS INTEGER) AS line FROM p {tail}"


_WITH_LINES = "LEFT JOIN d ON p.dir = d.dir AND p.name = d.name"
_GO = r"""CASE WHEN regexp_full_match(p.version, '[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?') THEN regexp_replace(p.version, '\+.*', '')
WHEN regexp_full_match(p.version, '[0-9]+\.[0-9]+(\+[0-9A-Za-z.-]+)?') THEN regexp_replace(p.version, '\+.*', '') || '.0' ELSE regexp_extract(p.name, '(?:/v|\.v)([0-9]+)$', 1) END"""
_TEXT_LINES = """d AS (SELECT dir, grp = 'dev' AS dev, lower(name || ' = "{0}"') AS text, CAST({1} AS INTEGER) AS line FROM p WHERE direct),
m AS (SELECT p.dir, p.name, max(line) AS line, count(*) FILTER (WHERE dev) AS devs FROM p JOIN d ON p.dir = d.dir AND contains(d.text, lower(p.name)) GROUP BY ALL)"""
_REPEAT = "array_to_string(list_concat({0}, ['{1}' FOR z IN range(coalesce({2}, 0))]), ',')"

_NPM_NODES = """e AS (SELECT '/p/' || md5(source_path) AS dir, coalesce(name, nullif(regexp_extract(pkg_path, '.*node_modules/(.*)$', 1), '')) AS name, map_keys(dependencies) AS below, coalesce(dev, false) AS dev FROM npm_packages),
nodes AS (SELECT dir, name, bool_and(dev) AS dev FROM e WHERE name IS NOT NULL GROUP BY ALL),
links AS (SELECT DISTINCT dir, name AS a, unnest(below) AS d FROM e WHERE name IS NOT NULL)"""
_NAMED = "SELECT '/p/' || (row_id >> 10) AS dir, name, version, coalesce(ecosystem, '') AS ecosystem, coalesce(\"commit\", '') AS commit_id FROM package_rows WHERE name <> '' AND version <> ''"

SQL = {
    "parse_cargo": _sql("Crates"),
    "parse_composer": _sql("Composer", "d.name IS NOT NULL", "CASE WHEN grp = 'dev' THEN 'dev' ELSE '' END", "coalesce(d.line, -1)", extra="""n AS (SELECT dir, greatest(1, count(*) FILTER (WHERE direct AND grp <> 'dev')) AS firsts FROM p GROUP BY dir),
d AS (SELECT p.dir, name, CASE WHEN grp = 'dev' THEN 2 + firsts ELSE 1 END + row_number() OVER (PARTITION BY p.dir, grp = 'dev' ORDER BY row_id) AS line FROM p JOIN n ON p.dir = n.dir WHERE direct)""", tail=_WITH_LINES),
    "parse_conan": _sql("Conan", groups="CASE WHEN grp = 'dev' THEN 'build-requires' ELSE 'requires' END"),
    "parse_bundler": _sql("Bundler", "direct", "CASE WHEN NOT direct THEN '' WHEN grp = '' THEN 'web' ELSE grp END", "coalesce(d.line, -1)", version="split_part(version, '-', 1)", extra=_DIRECT_LINES.format(head=1, part=", grp = 'dev'", where=""), tail=_WITH_LINES),
    "parse_go_mod": _sql("Golang", "direct", line="d.line", version=_GO, extra="d AS (SELECT dir, name, 5 + CAST(row_number() OVER (PARTITION BY dir ORDER BY row_id) AS INTEGER) AS line FROM p)", tail=_WITH_LINES + " UNION ALL SELECT DISTINCT dir, 'stdlib', '1.21', true, '', 0 FROM p"),
    "parse_gradle": _sql("Gradle", "false", _REPEAT.format("[CASE WHEN grp = '' THEN 'main' ELSE grp END]", "runtimeClasspath", "m.runs"), "coalesce(m.line, -1)", extra="""d AS (SELECT dir, CASE WHEN grp = 'test' THEN 'runtimeOnly' ELSE 'implementation' END || ' "' || name || ':' || version || '"' AS text, grp = 'test' AS run, row_number() OVER (PARTITION BY dir ORDER BY row_id) AS line FROM p WHERE direct),
m AS (SELECT p.dir, p.name, max(line) FILTER (WHERE contains(text, p.version)) AS line, count(*) FILTER (WHERE run) AS runs FROM p JOIN d ON p.dir = d.dir AND contains(text, split_part(p.name, ':', 1)) AND contains(text, substr(p.name, instr(p.name, ':') + 1)) GROUP BY ALL)""", tail="LEFT JOIN m ON p.dir = m.dir AND p.name = m.name"),
    "parse_gradle_verification": _sql("Gradle"),
    "parse_mix": _sql("Hex", tail="WHERE regexp_full_match(p.name, '[0-9A-Za-z_]+')"),
    "parse_npm": _sql("NPM", "direct", "CASE WHEN grp = 'dev' THEN 'dev' ELSE 'prod' END", "coalesce(d.line, -1)", extra=_JSON_LINES, tail=_WITH_LINES),
    "parse_yarn": _sql("Yarn", "direct", "CASE WHEN NOT direct THEN '' WHEN grp = 'dev' THEN 'dev' ELSE 'prod' END", "coalesce(d.line, -1)", extra=_JSON_LINES, tail=_WITH_LINES),
    "parse_pnpm": _sql("Pnpm", "direct", "CASE WHEN grp = 'dev' THEN 'dev' WHEN direct THEN 'prod' ELSE '' END", "coalesce(d.line, -1)", extra=_JSON_LINES, tail=_WITH_LINES),
    "parse_nuget": _sql("NuGet", "direct", "CASE WHEN NOT direct THEN '' WHEN grp = 'dev' THEN 'dev' ELSE 'prod' END", "coalesce(d.line, -1)", extra=_DIRECT_LINES.format(head=2, part="", where=""), tail=_WITH_LINES),
    "parse_pdm": _sql("Pdm", groups="CASE WHEN grp = '' THEN '' WHEN grp = 'dev' THEN 'dev' ELSE 'optional' END"),
    "parse_pipenv": _sql("Pipfile", "m.name IS NOT NULL", "CASE WHEN grp = 'dev' THEN 'dev' ELSE '' END", "coalesce(m.line, -1)", extra=_TEXT_LINES.format("*", "1 + row_number() OVER (PARTITION BY dir ORDER BY row_id)"), tail="LEFT JOIN m ON p.dir = m.dir AND p.name = m.name"),
    "parse_poetry": _sql("Poetry", "m.name IS NOT NULL", _REPEAT.format("CASE WHEN grp = 'optional' THEN ['optional'] ELSE [] END", "dev", "m.devs"), "coalesce(m.line, -1)", extra="""n AS (SELECT dir, greatest(1, count(*) FILTER (WHERE direct AND grp <> 'dev')) AS firsts FROM p GROUP BY dir),
d AS (SELECT p.dir, grp = 'dev' AS dev, lower(name || ' = "^' || version || '"') AS text, CASE WHEN grp = 'dev' THEN 3 + firsts ELSE 1 END + row_number() OVER (PARTITION BY p.dir, grp = 'dev' ORDER BY row_id) AS line FROM p JOIN n ON p.dir = n.dir WHERE direct),
m AS (SELECT p.dir, p.name, max(line) AS line, count(*) FILTER (WHERE dev) AS devs FROM p JOIN d ON p.dir = d.dir AND contains(d.text, lower(p.name)) GROUP BY ALL)""", tail="LEFT JOIN m ON p.dir = m.dir AND p.name = m.name"),
    "parse_pub": _sql("Pub", groups="CASE WHEN direct AND grp = 'dev' THEN 'dev' ELSE '' END"),
    "parse_renv": _sql("Renv"),
    "parse_requirements": f"""WITH {_P.format("Requirements")}, n AS (SELECT dir, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS name, version, 1 + row_number() OVER (PARTITION BY dir ORDER BY row_id) AS line FROM p)
SELECT dir, name, version, true AS is_direct, 'requirements' AS dep_groups, CAST(min(line) AS INTEGER) AS line FROM n GROUP BY dir, name, version""",
    "parse_pom": f"""WITH {_P.format("Maven")} SELECT dir, name, version, true AS is_direct, CASE WHEN row_id % 3 = 0 THEN '' ELSE grp END AS dep_groups, CAST(5 + row_number() OVER (PARTITION BY dir ORDER BY row_id) AS INTEGER) AS line FROM p""",
    "pom_inheritance": """WITH RECURSIVE one AS (SELECT filename AS f, min(version) AS version, min(depends_on.filename) AS up FROM artifacts WHERE filename IS NOT NULL GROUP BY filename),
chain AS (SELECT f, f AS at, version, up, [f] AS seen FROM one UNION ALL SELECT c.f, o.f, o.version, o.up, list_append(c.seen, o.f) FROM chain c JOIN one o ON c.up = o.f WHERE c.version IS NULL AND NOT list_contains(c.seen, o.f))
SELECT sha256(f) AS pom, coalesce(max(version), '') AS version FROM chain GROUP BY f""",
    "propagate_groups": f"""WITH RECURSIVE {_NPM_NODES},
r AS (SELECT dir, name AS node, CASE WHEN dev THEN 'dev' ELSE 'prod' END AS grp FROM nodes UNION SELECT r.dir, l.d, r.grp FROM r JOIN links l ON r.dir = l.dir AND r.node = l.a JOIN nodes n ON l.dir = n.dir AND l.d = n.name)
SELECT dir, node, grp FROM r""",
    "pnpm_closure": f"""WITH RECURSIVE {_NPM_NODES},
r AS (SELECT dir, name AS node FROM nodes WHERE NOT dev UNION SELECT r.dir, l.d FROM r JOIN links l ON r.dir = l.dir AND r.node = l.a)
SELECT r.dir, node, n.name IS NOT NULL AS is_direct, 'prod' AS dep_groups FROM r LEFT JOIN nodes n ON r.dir = n.dir AND r.node = n.name AND NOT n.dev""",
    "npm_group_merge": """WITH g AS (SELECT '/p/' || (row_id >> 10) AS dir, name, version, list_concat(CASE WHEN coalesce(list_contains(dep_groups, 'dev'), false) THEN ['dev'] ELSE ['prod'] END, CASE WHEN coalesce(list_contains(dep_groups, 'optional'), false) THEN ['optional'] ELSE [] END) AS groups
FROM package_rows WHERE package_manager = 'NPM' AND name IS NOT NULL AND version IS NOT NULL)
SELECT dir, name, version, array_to_string(list_sort(list_distinct(flatten(list(groups)))), ',') AS dep_groups FROM g GROUP BY ALL""",
    "url_commit_extract": """SELECT npm_id, CAST(form AS INTEGER) AS form, CASE form WHEN 1 THEN 'c' || npm_id WHEN 2 THEN 'a' || npm_id WHEN 3 THEN 'b' || npm_id WHEN 4 THEN 'main' ELSE '' END AS commit_id
FROM npm_packages, (SELECT unnest([0, 1, 2, 3, 4]) AS form) WHERE resolved IS NOT NULL""",
    "go_mod_places": f"""WITH {_P.format("Golang")}, l AS (SELECT dir, name, version, CAST(5 + row_number() OVER (PARTITION BY dir ORDER BY row_id) AS INTEGER) AS line, CAST(length(name) AS INTEGER) AS n FROM p)
SELECT dir, name, line AS block_line_start, 2 AS block_column_start, CAST(n + length(version) + 4 AS INTEGER) AS block_column_end, line AS name_loc_line_start, 2 AS name_loc_column_start, n + 2 AS name_loc_column_end FROM l""",
    "poetry_places": f"""WITH {_P.format("Poetry")}, n AS (SELECT dir, greatest(1, count(*) FILTER (WHERE direct AND grp <> 'dev')) AS firsts FROM p GROUP BY dir),
d AS (SELECT p.dir, name || ' = "^' || version || '"' AS text, name AS own, version AS wants, CAST(CASE WHEN grp = 'dev' THEN 3 + firsts ELSE 1 END + row_number() OVER (PARTITION BY p.dir, grp = 'dev' ORDER BY row_id) AS INTEGER) AS line FROM p JOIN n ON p.dir = n.dir WHERE direct),
m AS (SELECT p.dir, p.name, arg_max({{'line': line, 'text': text, 'own': own, 'wants': wants}}, line) AS x FROM p JOIN d ON p.dir = d.dir AND contains(lower(d.text), lower(p.name)) GROUP BY ALL)
SELECT dir, name, x.line AS block_line_start, 1 AS block_column_start, CAST(length(x.text) + 1 AS INTEGER) AS block_column_end, x.line AS name_loc_line_start, CAST(instr(lower(x.text), lower(name)) AS INTEGER) AS name_loc_column_start,
  CAST(instr(lower(x.text), lower(name)) + length(name) AS INTEGER) AS name_loc_column_end, x.line AS version_loc_line_start, CAST(length(x.own) + 5 AS INTEGER) AS version_loc_column_start, CAST(length(x.text) AS INTEGER) AS version_loc_column_end FROM m""",
    "parse_csv": f"SELECT dir, name, version, ecosystem, '' AS commit_id, count(*) AS n FROM ({_NAMED}) WHERE ecosystem <> '' GROUP BY ALL",
    "parse_results": f"SELECT dir, name, CASE WHEN commit_id = '' THEN version ELSE '' END AS version, CASE WHEN commit_id = '' THEN ecosystem ELSE '' END AS ecosystem, commit_id, count(*) AS n FROM ({_NAMED}) GROUP BY ALL",
    "parse_apk": f"SELECT dir, name, version, 'Alpine' AS ecosystem, commit_id, count(*) AS n FROM ({_NAMED}) GROUP BY ALL",
    "parse_dpkg": f"SELECT dir, name, version, 'Debian' AS ecosystem, '' AS commit_id, count(*) AS n FROM ({_NAMED}) WHERE commit_id = '' GROUP BY ALL",
}
