from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lockgrain.functions.versions import KEYS, compare, compare_versions, rank_versions, semver_key, version_key

#: Chains in ascending order by the public rules of each ecosystem; versions in one inner list are equal.
ASCENDING = {
    "npm": [["0.0.1-alpha"], ["0.0.1"], ["1.0.0-alpha", "1.0.0-alpha+x"], ["1.0.0-alpha.1"], ["1.0.0-alpha.beta"], ["1.0.0-beta"], ["1.0.0-beta.2"], ["1.0.0-beta.11"], ["1.0.0-rc.1"], ["1.2.3.4"], ["1.2.3", "v1.2.3"], ["1.10.0"], ["99999999999999999999.0.0"], ["100000000000000000000.0.0"]],
    "NuGet": [["1.0.0-a"], ["1.0.0-B"], ["1.0.0-c"], ["1.0.0", "1.0", "1"], ["1.0.0.1"], ["1.0.1"]],
    "CRAN": [["0.9"], ["1.0"], ["1.0.0", "1-0-0"], ["1.0-1", "1.0.1"], ["1.10"]],
    "Debian": [["1.0~rc1-1"], ["1.0-1"], ["1.0-1+b1"], ["1.0a-1"], ["1.0+dfsg-1"], ["1.1-1"], ["1:0.1-1"]],
    "PyPI": [["abc"], ["1.0.dev1"], ["1.0a1.dev1"], ["1.0a1"], ["1.0b2"], ["1.0rc1", "1.0c1", "1.0-preview-1"], ["1.0", "1.0.0", "v1.0"], ["1.0+abc"], ["1.0+abc.5"], ["1.0+5"], ["1.0.post1", "1.0-1", "1.0.rev1"], ["1.1.dev1"], ["1!0.1"]],
    "Packagist": [["1.0-dev"], ["1.0-alpha1", "1.0a1"], ["1.0-beta2"], ["1.0-RC1"], ["1.0", "v1.0"], ["1.0.0"], ["1.0.1"]],
    "RubyGems": [["1.a", "1.0.a", "1.0.0.a"], ["1.0.b"], ["1", "1.0", "1.0.0"], ["1.0.0.1"], ["1.0.1.pre"], ["1.0.1"], ["1.2"], ["1.10"]],
    "Maven": [["1-alpha"], ["1-beta", "1-b1"][:1], ["1-milestone"], ["1-rc", "1-cr"], ["1-SNAPSHOT"], ["1", "1.0", "1-ga", "1.0.0-final", "1-release"], ["1-sp"], ["1-abc"], ["1-1"], ["1.1"], ["2"]],
    "Alpine": [["1.0_alpha1"], ["1.0_rc1"], ["1.0", "1.0_cvs"], ["1.0_git1"], ["1.0_p1"], ["1.0a"], ["1.0b"], ["1.1"], ["1.1-r1"], ["1.10"]],
}


@pytest.mark.parametrize("ecosystem", ASCENDING)
def test_ascending_in_both_directions(ecosystem):
    flat = [(i, v) for i, same in enumerate(ASCENDING[ecosystem]) for v in same]
    for (i, a), (j, b) in itertools.product(flat, flat):
        assert compare(ecosystem, a, b) == (i > j) - (i < j), (ecosystem, a, b)


@pytest.mark.parametrize("ecosystem", sorted({*KEYS, "Maven", "Alpine"}))
def test_any_text_can_be_compared(ecosystem):
    rng = random.Random(9)
    texts = ["", ".", "-", "v", "~", ":", "é.1", "1" * 3000] + ["".join(rng.choice("0123456789.-+~_abvrc:") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    for a in texts:
        b = rng.choice(texts)
        assert compare(ecosystem, a, a) == 0
        assert compare(ecosystem, a, b) == -compare(ecosystem, b, a)


def test_unknown_ecosystems():
    assert compare("Linux", "1", "2") is None and compare("", "1", "2") is None and compare("Alpine:v3.10", "1.0", "1.1") == -1


def test_columns(spark):
    rows = [(e, "pkg", v, i) for e, chain in ASCENDING.items() for i, same in enumerate(chain) for v in same] + [("Linux", "pkg", "1", 0), (None, "pkg", "1", 0), ("npm", "pkg", None, 0)]
    df = spark.createDataFrame(rows, "ecosystem string, name string, version string, want int")
    places = {(r.ecosystem, r.version): r.place for r in rank_versions(df).collect()}
    assert {(e, v): p for (e, v), p in places.items()} == {(e, v): w + 1 for e, _, v, w in rows if e in ASCENDING and v is not None}
    keyed = df.withColumn("k", version_key(F.col("ecosystem"), F.col("version")))
    assert keyed.where("k is null").select("ecosystem").distinct().count() == 5
    newest = {r.ecosystem: r.v for r in keyed.where("k is not null").groupBy("ecosystem").agg(F.max_by("version", "k").alias("v")).collect()}
    assert all(newest[e] == ASCENDING[e][-1][-1] for e in newest)
    pair = spark.createDataFrame([("Maven", "1", "1-sp"), ("npm", None, "1"), (None, "1", "1"), ("X", "1", "1")], "e string, a string, b string")
    assert [r[0] for r in pair.select(compare_versions(F.col("e"), F.col("a"), F.col("b"))).collect()] == [-1, None, None, None]


def test_semver_in_catalyst_agrees_with_the_key(spark):
    rng = random.Random(3)
    texts = [v for same in ASCENDING["npm"] for v in same] + ["".join(rng.choice("0123.-+ab") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    order = df.select("v", semver_key(F.col("v")).alias("k")).orderBy("k")
    got = [r.v for r in order.collect()]
    assert all(compare("npm", a, b) <= 0 for a, b in zip(got, got[1:]))


def test_sort_queries_place_every_version(spark, tmp_path):
    """Places in the chains above and in versions put together at random, by the engine, by pairs and by SQL."""
    import duckdb

    from lockgrain.plans.versions import QUERIES, SQL

    queries = {"semver_sort": "npm", "nuget_sort": "NuGet", "cran_sort": "CRAN", "pypi_sort": "PyPI", "packagist_sort": "Packagist", "rubygems_sort": "RubyGems", "maven_sort": "Maven"}
    rng = random.Random(8)
    tails = ("", "", "-alpha", "-beta.3", "-rc.1", ".dev7", "+build.12", ".RELEASE", "-SNAPSHOT", ".a", ".0", "-1", "b2", ".post1")
    made = sorted({".".join(str(rng.choice((0, 1, 2, 10, 21))) for _ in range(rng.randint(1, 4))) + rng.choice(tails) for _ in range(150)})
    rows = [(e, "pkg", v) for e in queries.values() for same in ASCENDING[e] for v in same] + [(e, "made", v) for e in queries.values() for v in made if e != "Maven" or not v.endswith((".dev7", ".a", ".post1"))]  # words behind dots have no consistent order there
    spark.createDataFrame(rows + rows[:3] + [("npm", None, "1"), ("npm", "pkg", None), (None, "pkg", "1")], "ecosystem string, name string, version string").write.parquet(str(tmp_path / "package_rows.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW package_rows AS SELECT * FROM '{tmp_path}/package_rows.parquet/*.parquet'")
    for name, e in queries.items():
        got = [(r.ecosystem, r.name, r.version, r.place) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(g for g in got if g[1] == "pkg") == sorted((e, "pkg", v, i + 1) for i, same in enumerate(ASCENDING[e]) for v in same)
        for (_, n, a, i), (_, m, b, j) in itertools.product(got, got):
            assert n != m or compare(e, a, b) == (i > j) - (i < j), (e, a, b)
        found = con.execute(SQL[name]).fetchall()
        assert sorted(map(tuple, found)) == sorted(got), (name, set(found) ^ set(got))
    for name in ("debian_sort", "newest_versions", "maven_compare", "alpine_compare"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        found = con.execute(SQL[name]).fetchall()
        assert sorted(map(tuple, found)) == sorted(got), (name, set(found) ^ set(got))
