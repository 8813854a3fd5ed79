from __future__ import annotations

import random

import pytest

pytest.importorskip("lockgrain.llm")
from lockgrain.llm.mixing import pareto_mix  # noqa: E402

TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, weights=False):
    rng = random.Random(8)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randint(1, 400)) for i in range(3000)]
    rows += [(5000, "big", 0), (5001, None, 50), (5002, "alone", 60), (5003, "big", None), (1, "big", 10)]
    if weights:
        return spark.createDataFrame([(*r, rng.choice([0.5, 1.0, 3.0, None])) for r in rows], "doc_id long, source string, n_tokens long, weight double")
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


@pytest.mark.parametrize("weights", [False, True])
def test_shares_are_reached(spark, weights):
    docs = corpus(spark, weights)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 9), (None, 0.1, 1)], TARGETS)
    mix, shares = pareto_mix(docs, targets, total=60_000.0)
    got = {r.source: r for r in shares.collect()}
    assert got["big"].actual_share == pytest.approx(5 / 9, abs=0.01) and got["mid"].actual_share == pytest.approx(3 / 9, abs=0.01) and got["small"].actual_share == pytest.approx(1 / 9, abs=0.01)
    assert got["absent"].tokens_used == 0 and got["alone"].tokens_used == 0
    cap = {"big": 1, "mid": 2, "small": 3}
    rows = mix.collect()
    assert all(1 <= r.copies <= cap[r.source] for r in rows)
    assert not {r.doc_id for r in rows} & {5000, 5001, 5002, 5003}
    again = pareto_mix(docs.repartition(7), targets, total=60_000.0)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = pareto_mix(docs, targets, seed=2, total=60_000.0)[0].collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_largest_mix_is_bound_by_the_scarcest_source(spark):
    docs = spark.createDataFrame([(i, "a" if i < 10 else "b", 10) for i in range(200)], "doc_id long, source string, n_tokens long")
    mix, shares = pareto_mix(docs, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], TARGETS))
    got = {r.source: r for r in shares.collect()}
    assert got["a"].tokens_used == 300 and got["a"].most_copies == 3 and got["b"].tokens_used == 300
    assert {r.copies for r in mix.where("source = 'a'").collect()} == {3}


def test_inclusion_follows_weights(spark):
    docs = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, source string, n_tokens long, weight double")
    mix, _ = pareto_mix(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=10_000.0)
    odd = mix.where("doc_id % 2 = 1").count()
    assert mix.count() == 1000 and 690 < odd < 810


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("b", 1.0, 1)], TARGETS)
    for d, t in ((docs, targets), (docs.limit(0), targets), (docs, targets.limit(0))):
        mix, shares = pareto_mix(d, t)
        assert mix.collect() == []
        assert all(r.tokens_used == 0 for r in shares.collect())
