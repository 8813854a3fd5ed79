"""Schema drift and flattening against plain Python over whole small tables."""

from __future__ import annotations

import json
import os
from collections import defaultdict

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("LOCKGRAIN_TEST_DATA", "/root/testdata/sf0.001")
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)

from lockgrain.plans import corpus  # noqa: E402


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    return "array<" + "|".join(sorted({kind(x) for x in v})) + ">"


@pytest.fixture(scope="module")
def contents():
    out = []
    for row in duckdb.connect().execute(f"SELECT lock_id, source_path, parsed_as, rev, content FROM '{DATA}/lockfiles.parquet'").fetchall():
        try:
            value = json.loads((row[4] or "").lstrip("﻿"))
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append((*row[:4], value))
    return out


def test_drift(spark, contents):
    by = defaultdict(dict)
    for _, source, _, rev, value in contents:
        by[source][rev] = {k: v for k, v in value.items() if v is not None}
    want = []
    for source, revs in by.items():
        order = sorted(revs)
        for before, now in zip(order, order[1:]):
            x, y = revs[before], revs[now]
            gone, new = [k for k in sorted(x) if k not in y], [k for k in sorted(y) if k not in x]
            for g in list(gone):
                match = next((n for n in new if x[g] == y[n] and kind(x[g]) == kind(y[n])), None)
                if match:
                    want.append((source, now, "renamed", g, match))
                    gone.remove(g)
                    new.remove(match)
            want += [(source, now, "removed", g, "") for g in gone] + [(source, now, "added", "", n) for n in new]
            want += [(source, now, "retyped", k, k) for k in x if k in y and kind(x[k]) != kind(y[k])]
    assert sorted(map(tuple, corpus.p4_found(spark, DATA).collect())) == sorted(want)


def test_flat_rows(spark, contents):
    want = []

    def walk(record, entries, path):
        for key, value in entries.items():
            want.append(("dependency", record, path, key))
            here = f"{path} > {key}" if path else key
            if isinstance(value, dict):
                if isinstance(value.get("requires"), dict):
                    want.extend(("require", record, here, r) for r in value["requires"])
                if isinstance(value.get("dependencies"), dict):
                    walk(record, value["dependencies"], here)

    for record, _, parsed, _, value in contents:
        if parsed == "package-lock" and isinstance(value.get("dependencies"), dict):
            walk(record, value["dependencies"], "")
    for record, places, vulns in duckdb.connect().execute(f"SELECT pv_id, locations, vulnerabilities FROM '{DATA}/package_vulns.parquet'").fetchall():
        want += [("location", record, "", str(i)) for i, x in enumerate(places or []) if x is not None]
        for v in filter(None, vulns or []):
            want.append(("vulnerability", record, "", v["id"]))
            for i, a in enumerate(v["affected"] or []):
                if a is None:
                    continue
                want.append(("affected", record, v["id"], str(i)))
                for j, r in enumerate(a["ranges"] or []):
                    if r is not None:
                        want += [("event", record, f"{v['id']}/{i}/{j}", str(k)) for k, e in enumerate(r["events"] or []) if e is not None]
    assert sorted(map(tuple, corpus.p6_found(spark, DATA).collect()), key=repr) == sorted(want, key=repr)
