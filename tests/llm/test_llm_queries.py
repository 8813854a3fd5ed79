"""Every training-data query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
queries = pytest.importorskip("lockgrain.llm.queries")
DATA = os.environ.get("LOCKGRAIN_TEST_DATA", "/root/testdata/sf0.001")
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, engine, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got
    if name in queries.SQL:
        found = engine.execute(queries.SQL[name])
        names = [c[0] for c in found.description]
        at = [names.index(c) for c in df.columns]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_named_columns(spark):
    kinds = {"p1_found": [("first_id", "bigint"), ("report_id", "bigint")], "p5_found": [("field", "string"), ("item", "string")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint")]}
    for name, want in kinds.items():
        assert queries.QUERIES[name](spark, DATA).dtypes == want
