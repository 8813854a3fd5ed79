"""Every core query against its SQL on the smallest tables; the driver does the same at a larger scale."""

from __future__ import annotations

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("LOCKGRAIN_TEST_DATA", "/root/testdata/sf0.001")
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)

from lockgrain.plans import corpus, inventory, parsers, versions  # noqa: E402

QUERIES = {**corpus.QUERIES, **inventory.QUERIES, **parsers.QUERIES, **versions.QUERIES}
SQL = {**corpus.SQL, **inventory.SQL, **parsers.SQL, **versions.SQL}


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert got
        return
    found = engine.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_entry_point():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_named_columns(spark):
    kinds = {
        "p2_found": [("tbl", "string"), ("source_path", "string"), ("node_key", "string"), ("root_key", "string"), ("depth", "int"), ("n_descendants", "bigint")],
        "p3_found": [("field", "string"), ("item", "string"), ("n_rows", "bigint"), ("n_sources", "bigint")],
        "p4_found": [("source_path", "string"), ("rev", "int"), ("drift", "string"), ("old_field", "string"), ("new_field", "string")],
        "p6_found": [("kind", "string"), ("record_id", "bigint"), ("parent_path", "string"), ("item", "string")],
    }
    for name, want in kinds.items():
        assert QUERIES[name](spark, DATA).dtypes == want
