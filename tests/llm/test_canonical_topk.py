from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lockgrain.llm")
from lockgrain.llm import canonical  # noqa: E402
from lockgrain.llm.topk import Counters, frequent_items, top_k  # noqa: E402

SCHEMA = "report_id long, payload string, name string"


def records(spark, rows):
    df = spark.createDataFrame([(i, p, "clash") for i, p in rows], SCHEMA)
    df = df.select("report_id", canonical.json_fields(F.col("payload"), ["name", "version", "ecosystem"]).alias("r")).where("r is not null")
    return canonical.canonical_records(df, "report_id", [F.col(f"r.{f}") for f in ("name", "version", "ecosystem")])


ROWS = [
    (5, '{"name": "A-b", "version": "1.0", "ecosystem": "npm"}'),
    (3, '{"VERSION":"1_0","Name":" a.B ","ecosystem":"NPM","commit":"x"}'),
    (9, '{"name": "ab", "version": "1.0", "ecosystem": "npm"}'),
    (7, '{"name": "«a»/b", "version": "-1 0-", "ecosystem": "npm"}'),
    (1, '{"name": "x", "version": null, "ecosystem": "npm"}'),
    (2, '{"name": "X", "ecosystem": "npm"}'),
    (4, '{"name": "x", "version": " - ", "ecosystem": "npm"}'),
    (6, '{"name": "x", "version": "10", "ecosystem": "npm"}'),
    (8, None), (10, "no json"), (11, ""), (12, "[1]"), (13, "{}"), (14, '{"name": "", "version": " "}'),
    (15, '{"name": "' + "y " * 40000 + '"}'), (16, '{"name": "' + "Y-" * 40000 + '"}'),
]


def test_duplicates_and_copies(spark):
    r = records(spark, ROWS)
    got = sorted(tuple(x) for x in canonical.duplicates(r).collect())
    assert got == [(1, 2), (1, 4), (3, 5), (3, 7), (13, 14), (15, 16)]
    copies = {x.first_id: x.copies for x in canonical.collapse(r).collect()}
    assert copies == {3: 3, 9: 1, 1: 3, 6: 1, 13: 2, 15: 2}
    assert canonical.duplicates(records(spark, [])).collect() == []


def test_hot_and_cold_groups_agree(spark, monkeypatch):
    rows = [(i, '{"name": "hot"}' if i % 3 else f'{{"name": "n{i // 30}"}}') for i in range(300)]
    want = sorted(tuple(x) for x in canonical.duplicates(records(spark, rows)).collect())
    for hot in (1, 10, 10**9):
        monkeypatch.setattr(canonical, "HOT", hot)
        assert sorted(tuple(x) for x in canonical.duplicates(records(spark, rows)).collect()) == want


def test_clash_of_the_hash_is_resolved_by_text(spark):
    r = records(spark, ROWS).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")})
    assert sorted(tuple(x) for x in canonical.duplicates(r).collect()) == [(1, 2), (1, 4), (3, 5), (3, 7), (13, 14), (15, 16)]
    assert sum(x.copies for x in canonical.collapse(r).collect()) == 12


def test_counters_bound_memory_and_error():
    rng = random.Random(2)
    data = [f"v{int(rng.paretovariate(0.6))}" for _ in range(20000)]
    c = Counters(50)
    for i in range(0, len(data), 100):
        some = Counter(data[i : i + 100])
        c.add(list(some), list(some.values()))
        assert len(c.counts) < 100
    c.shrink()
    true = Counter(data)
    assert c.error <= len(data) / 50
    assert all(true[v] - c.error <= n <= true[v] for v, n in c.counts.items())
    assert all(v in c.counts for v, n in true.items() if n > c.error)


@pytest.mark.parametrize("capacity", [None, 30])
def test_frequent_items(spark, capacity):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "warm", "", None, f"r{i}", f"s{i % 400}"]), "x" * 2000 if i % 7 == 0 else f"p{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "name string, purl string, item long").repartition(5)
    got = {(r.field, r.item): r for r in frequent_items(df, ["name", "purl"], 20, capacity).collect()}
    want = {("name", k): n for k, n in Counter(r[0] for r in rows if r[0]).items() if n * 20 >= 6000} | {("purl", k): n for k, n in Counter(r[1] for r in rows).items() if n * 20 >= 6000}
    assert {k: r.n for k, r in got.items()} == want
    assert all(r.approx <= r.n for r in got.values())
    assert frequent_items(df.limit(0), ["name"], 20).collect() == []


@pytest.mark.parametrize("capacity,most", [(4, 8), (1000, 1000), (16, 1 << 18)])
def test_top_k_is_exact_with_ties(spark, capacity, most):
    rng = random.Random(5)
    rows = [(f"v{min(int(rng.paretovariate(0.7)), 300)}",) for _ in range(3000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "name string").repartition(3)
    got = [(r.item, r.n) for r in top_k(df, "name", 6, capacity, most).collect()]
    want = sorted(((n, k) for k, n in Counter(r[0] for r in rows if r[0]).items()), key=lambda x: (-x[0], x[1]))[:6]
    assert got == [(k, n) for n, k in want]
    assert top_k(df.limit(0), "name", 3).collect() == []
