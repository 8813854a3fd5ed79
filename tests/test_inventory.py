from __future__ import annotations

from pyspark.sql import functions as F

from lockgrain.functions import positions
from lockgrain.functions.devgroup import is_dev_group
from lockgrain.functions.purl import purl
from lockgrain.operators import graph, inventory, reach

PACKAGE = "source_path string, name string, version string, ecosystem string, `commit` string, package_manager string, dep_groups array<string>, is_direct boolean, block struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int>, name_loc struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int>, version_loc struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int>, extra string"


def package(source, name, version, ecosystem, groups=None, direct=None, commit=None, manager="NPM", block=None):
    return (source, name, version, ecosystem, commit, manager, groups, direct, block, None, None, "x")


def test_purls(spark):
    cases = [
        ("Maven", "g:a", "1", "pkg:maven/g/a@1"), ("Maven", "a", "1", None), ("Maven", "g:a:b", "1", None), ("Packagist", "v/p", "1", "pkg:composer/v/p@1"), ("Packagist", "p", "1", None),
        ("Go", "x.org/a/b", "1", "pkg:golang/x.org/a/b@1"), ("Go", "std", None, "pkg:golang/std"), ("Go", "", "1", None), ("npm", "@s/b c", "1+2~3", "pkg:npm/%40s/b%20c@1%2B2~3"), ("Debian", "a", "1", None),
        (None, "a", "1", None), ("PyPI", None, "1", "pkg:pypi/@1"), ("Hex", "é:*", "", "pkg:hex/%C3%A9:%2A"), ("CRAN", "a", "1", "pkg:cran/a@1"),
    ]
    df = spark.createDataFrame(cases, "e string, n string, v string, want string")
    for r in df.withColumn("got", purl(F.col("e"), F.col("n"), F.col("v"))).collect():
        assert r.got == r.want, r


def test_dev_groups(spark):
    cases = [
        ("npm", ["dev", "optional"], True), ("npm", ["optional"], False), ("npm", ["dev", "prod"], False), ("npm", [], False), ("npm", None, False), ("PyPI", ["dev"], True), ("PyPI", ["dev", None], False),
        ("Maven", ["test", "testRuntime"], True), ("Maven", ["test", "compile"], False), ("ConanCenter", ["build-requires"], True), ("RubyGems", ["ci", "rubocop"], True), ("RubyGems", ["web"], False), ("Go", ["dev"], False), (None, ["dev"], False),
    ]
    df = spark.createDataFrame(cases, "e string, g array<string>, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", is_dev_group(F.col("e"), F.col("g"))).collect())


def test_sanitize_identify_merge(spark):
    rows = [
        package("s1", "a", "1", "npm", ["dev"], True), package("s2", "a", "1", "npm", ["dev"], False, manager=None), package("s1", "b", ">=1", "npm"), package("s1", "c", "1", "Debian"),
        package("s1", None, "1", "npm", commit="abc"), package("s1", "d", None, "npm", None, None), package("s3", "a", "1", "npm", ["prod"], True, manager="Unknown"),
    ]
    df = spark.createDataFrame(rows, PACKAGE)
    good, dropped = inventory.sanitize(df)
    assert {(r["name"], r.reason) for r in dropped.collect()} == {("b", "ranged version"), ("c", "no package url")}
    kept, lost = inventory.identify(good)
    assert {(r["name"], r.ecosystem, r.version) for r in kept.collect()} == {("a", "npm", "1"), ("", "GIT", "abc"), ("d", "npm", None)} and lost.count() == 0
    merged = {r.purl: r for r in inventory.merge_by_purl(kept.where("name <> ''"), locations=True).collect()}
    assert merged["pkg:npm/a@1"].dep_groups == ["dev", "prod"] and merged["pkg:npm/a@1"].is_direct and not merged["pkg:npm/a@1"].is_dev and merged["pkg:npm/a@1"].n_rows == 3
    two = inventory.merge_by_purl(good.where("source_path <> 's3' and name = 'a'")).first()
    assert two.is_dev and not inventory.merge_by_purl(good.where("source_path <> 's3' and name = 'a'"), strict=True).first().is_dev
    meta = {r.source_path: r.m for r in good.where("name = 'a'").select("source_path", inventory.base_metadata(good).alias("m")).collect()}
    assert meta == {"s1": {"package-manager": "NPM", "is-direct": "true", "is-dev": "true"}, "s2": {"is-dev": "true"}, "s3": {"is-direct": "true"}}
    assert {r.purl for r in inventory.direct_purls(good).collect()} == {"pkg:npm/a@1"}
    nested = inventory.group_by_source(good.select("source_path", "name", "version"), "name", "version").where("source_path = 's2'").first()
    assert [tuple(p) for p in nested.packages] == [("a", "1")]
    assert inventory.merge_by_purl(good.limit(0)).collect() == []


def test_order(spark):
    ids = spark.createDataFrame([("GHSA-1",), ("OSV-1",), ("CVE-2",), ("CVE-1",)], "id string")
    from lockgrain.sinks.cyclonedx import ordered_ids

    assert [r.id for r in ordered_ids(ids).collect()] == ["CVE-1", "CVE-2", "OSV-1", "GHSA-1"]
    assert [r[0] for r in spark.range(3).select(inventory.pluralize(F.col("id"), "file", "files")).collect()] == ["files", "file", "files"]


def test_graph(spark):
    edges = spark.createDataFrame([("s", "r", "a"), ("s", "a", "b"), ("s", "b", "a"), ("s", "a", None), (None, "x", "y"), ("s", "r", "a")], "source_path string, parent_key string, child_key string")
    pairs = {(r.ancestor, r.node, r.distance) for r in graph.closure(edges).where("source_path = 's'").collect()}
    assert pairs == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1), ("a", "a", 2), ("b", "a", 1), ("b", "b", 2)}
    assert graph.closure(edges.limit(0)).collect() == []


def test_reach(spark):
    java = 'class A {\n  // new Hidden()\n  String s = "new Text()";\n  void f() { new org.x.Box<String>(1,\n    new Inner()); Foo.bar(); }\n}\n'
    sites = reach.java_call_sites(spark.createDataFrame([("A.java", java), ("B.txt", java), ("C.java", None)], "path string, text string"))
    got = {(r.symbol_text, r.line_start, r.line_end, r.column_start) for r in sites.collect()}
    assert got == {("org.x.Box", 4, 5, 14), ("Inner", 5, 5, 5)}
    advisories = spark.createDataFrame([("p1", "A1", "class", "org.x", "Box"), ("p1", "A2", "class", "org.x", "None"), ("p2", "A1", "method", "q", "Inner"), ("p3", "A3", "class", "q", "Inner")], "purl string, advisory_id string, symbol_type string, symbol_value string, symbol_name string")
    direct = spark.createDataFrame([("p1",), ("p3",), ("p1",)], "purl string")
    known = reach.checked_advisories(direct, advisories)
    hits = reach.detect(known, sites)
    pivoted = {r.purl: (r.advisories, r.reachable) for r in reach.pivot(known, hits).collect()}
    assert pivoted == {"p1": (["A1", "A2"], ["A1"]), "p3": (["A3"], ["A3"])}
    assert {r.advisory_id: r.affects for r in reach.affected_purls(reach.pivot(known, hits)).collect()} == {"A1": ["p1"], "A2": [], "A3": ["p3"]}
    assert "A1" in {r.purl: r.locations for r in reach.reachable_symbols(hits).collect()}["p1"]


def test_positions(spark):
    df = spark.createDataFrame([("a\r\n  bé c \n\n",), ("",), ('{\n "x": {\n  "n" : "1.0"}}',), (None,)], "t string")
    lines = positions.split_lines(F.col("t"))
    got = [r[0] for r in df.select(F.transform(lines, lambda x: F.struct(positions.first_column(x), positions.last_column(x)))).collect()]
    assert [tuple(x) for x in got[0]] == [(1, 2), (3, 7), (-1, -1), (-1, -1)] and got[3] is None
    hit = positions.string_in_block(lines, "é", 10)
    assert [r[0] and tuple(r[0]) for r in df.select(hit).collect()] == [(11, 4, 5), None, None, None]
    assert [r[0] for r in df.select(positions.json_section_line(F.col("t"), "x")).collect()][:3] == [-1, -1, 2]
    assert [r[0] for r in df.select(positions.json_pair(F.col("t"), "n")).collect()][2] == '"n" : "1.0"'


def test_columns_of_every_line(spark, tmp_path):
    import re

    from lockgrain.plans.inventory import QUERIES, SQL

    texts = ["\tname = é  ", "  中文\t\r\n\t\t\r\r\n", "", "a\u00a0", "\u00a0x\u3000", "\x0cé\x0c", "𝒳 = '𝒴' \n plain ", "no space", "\x01\x7f", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in enumerate(texts):
        for n, line in enumerate(re.split("\r\n|\r|\n", text) if text is not None else ()):
            at = [k for k, c in enumerate(line) if c not in " \t\f"]
            want.append((i, n, at[0] + 1 if at else -1, at[-1] + 2 if at else -1))
    assert sorted(tuple(r) for r in QUERIES["line_columns"](spark, str(tmp_path)).collect()) == want
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(SQL["line_columns"]).fetchall()) == want
