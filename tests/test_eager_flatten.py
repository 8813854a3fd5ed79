from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from lockgrain.operators.eager import eager_join_aggregate, join_states, key_states
from lockgrain.operators.flatten import child_tables, flatten_locks, flatten_package_vulns, unnest


def test_join_without_joined_rows(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 5), (None, 9), ("hot", 1)] + [("hot", 1)] * 200, "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("hot", 1), ("c", 3), (None, 1)], "k string, y int")
    got = {r.k: r for r in eager_join_aggregate(left, right, ["k"], {"sx": F.col("x")}, {"sy": F.col("y")}).collect()}
    want = {r.k: r for r in left.join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()}
    assert set(got) == set(want)
    for k in got:
        assert (got[k].n_pairs, got[k].sx, got[k].sy) == (want[k].n, want[k].sx, want[k].sy)
    kept = {r.k: r for r in eager_join_aggregate(left, right, ["k"], {"sx": F.col("x")}, {"sy": F.col("y")}, keep_left=True).collect()}
    assert kept["b"].n_pairs == 0 and kept["b"].sy is None and kept["b"].sx == 5 and None not in kept


def test_roll_up_and_states(spark):
    left = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "a")], "g string, k string")
    right = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    both = left.select("g", "k").join(right, "k").groupBy("g").count().collect()
    rolled = eager_join_aggregate(left.select("k", "g"), right, ["k"]).collect()
    assert sum(r.n_pairs for r in rolled) == sum(r["count"] for r in both)
    rows = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("a", None), ("b", None)], "k string, s string")
    got = {r.k: (r.n_rows, r.n_members) for r in join_states(rows, rows, ["k"], "s").collect()}
    assert got == {"a": (3, 1), "b": (1, 0)}
    assert key_states(rows.limit(0), ["k"]).collect() == []


def test_unnest_counts_null_elements():
    values, parent, position = unnest(pa.array([[1, None, 3], None, [], [4]]))
    assert (values.to_pylist(), parent.to_pylist(), position.to_pylist()) == ([1, 3, 4], [0, 0, 3], [0, 2, 0])
    values, parent, position = unnest(pa.array([[9], [1, None], [5]]).slice(1))
    assert (values.to_pylist(), parent.to_pylist(), position.to_pylist()) == ([1, 5], [0, 1], [0, 0])


def test_lock_tree(spark):
    deep = {"version": "1"}
    for i in range(200):
        deep = {"dependencies": {f"d{i}": deep}}
    rows = [
        (1, json.dumps({"dependencies": {"a": {"requires": {"x": "1"}, "dependencies": {"b": {"requires": True, "dependencies": None}}}, "c": None}})),
        (2, None), (3, "no json"), (4, "[1]"), (5, '﻿{"dependencies": {"z": {}}}'), (6, json.dumps({"dependencies": ["a"], "requires": {"q": "1"}})), (7, json.dumps(deep)), (8, ""), (9, "{}"),
    ]
    got = {tuple(r) for r in flatten_locks(spark.createDataFrame(rows, "lock_id long, content string")).collect() if r.record_id != 7}
    assert got == {("dependency", 1, "", "a"), ("dependency", 1, "", "c"), ("require", 1, "a", "x"), ("dependency", 1, "a", "b"), ("dependency", 5, "", "z")}
    chain = flatten_locks(spark.createDataFrame(rows, "lock_id long, content string")).where("record_id = 7").collect()
    assert len(chain) == 200 and max(len(r.parent_path.split(" > ")) for r in chain) == 199
    assert flatten_locks(spark.createDataFrame([], "lock_id long, content string")).collect() == []


def test_package_vulns(spark):
    schema = """pv_id long, locations array<struct<block:struct<file_name:string>>>,
      vulnerabilities array<struct<id:string,affected:array<struct<ranges:array<struct<type:string,events:array<struct<fixed:string>>>>>>>>, kind string"""
    place = ((("f",)),)
    event = [("1",), None, ("2",)]
    rows = [
        (1, [None, place], [("V1", [None, ([("SEMVER", event), None],)]), None, ("V2", None)], "k"),
        (2, None, None, None), (3, [], [], None), (4, [None], [(None, [([],), (None,)])], None),
    ]
    got = sorted(map(tuple, flatten_package_vulns(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [
        ("location", 1, "", "1"), ("vulnerability", 1, "", "V1"), ("vulnerability", 1, "", "V2"), ("affected", 1, "V1", "1"),
        ("event", 1, "V1/1/0", "0"), ("event", 1, "V1/1/0", "2"), ("vulnerability", 4, "", None), ("affected", 4, None, "0"), ("affected", 4, None, "1"),
    ]
    assert got == sorted(want, key=str)


def test_child_tables(spark):
    schema = "id string, a array<struct<id:string,s:struct<x:int,l:array<string>>,b:array<struct<at_1:int,m:map<string,int>>>,q:array<array<int>>>>, s struct<t:array<int>>, other string"
    rows = [
        ("r1", [("e0", (1, ["u", None, "v"]), [(7, {"k": 1}), None], [[1]]), None, ("e2", None, [], None)], ([5, None],), "x"),
        ("r2", None, None, None), (None, [(None, (None, None), None, None)], (None,), None), ("r1", [], ([],), "y"),
    ]
    got = {k: sorted((tuple(r) for r in t.collect()), key=str) for k, t in child_tables(spark.createDataFrame(rows, schema), "id", "a", "s").items()}
    assert got == {
        "a": [("r1", 0, "e0", 1), ("r1", 2, "e2", None), (None, 0, None, None)],
        "a.s.l": [("r1", 0, 0, "u"), ("r1", 0, 2, "v")],
        "a.b": [("r1", 0, 0, 7, {"k": 1})],
        "s.t": [("r1", 0, 5)],
    }
    tables = child_tables(spark.createDataFrame(rows, schema), "id", "a")
    assert tables["a"].columns == ["id", "at_1", "id_2", "s_x"] and tables["a.b"].columns == ["id", "at_1", "at_2", "at_1_2", "m"]
    assert all(t.count() == 0 for t in child_tables(spark.createDataFrame([], schema), "id", "a", "s").values())
