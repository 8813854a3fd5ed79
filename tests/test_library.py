from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lockgrain.functions.positions import json_objects, safe_int, toml_tables
from lockgrain.sinks.cyclonedx import vulnerability_json, vulnerability_rows
from lockgrain.sources.advisories import NoCredentials, Service, auth_headers, base_url, fetch
from lockgrain.sources.files import drop_ignored
from lockgrain.sources.formats.go_binary import FRAME, MAGIC
from lockgrain.sources.gitignore import read_rules
from lockgrain.sources.lockfiles import apk_packages, go_binary_packages

SERVICE = Service(("AA", "BB"), "api.host.example", "v1/symbols", "x-jwt", ("x-key", "x-app"))


def test_service_settings():
    assert base_url(SERVICE, env={}) == "https://api.host.example" and base_url(SERVICE, "http://o", {}) == "http://o"
    assert base_url(SERVICE, env={"BB_SITE": "s.example"}) == "https://api.s.example" and base_url(SERVICE, env={"AA_HOSTNAME": "h", "BB_SITE": "s"}) == "https://h"
    assert auth_headers(SERVICE, "t", {}) == {"x-jwt": "t"} and auth_headers(SERVICE, env={"BB_JWT_TOKEN": "u"}) == {"x-jwt": "u"}
    assert auth_headers(SERVICE, env={"AA_API_KEY": "1", "BB_API_KEY": "2", "BB_APP_KEY": "3"}) == {"x-key": "1", "x-app": "3"}
    with pytest.raises(NoCredentials, match="APP_KEY"):
        auth_headers(SERVICE, env={"AA_API_KEY": "1"})


def test_fetch(spark):
    asked = []

    def post(url, headers, body):
        asked.append((url, json.loads(body)["data"]["attributes"]["purls"]))
        return json.dumps({"data": {"attributes": {"results": [{"purl": p, "vulnerable_symbols": [{"advisory_id": "A", "symbols": [{"type": "class", "value": "v", "name": "n"}]}]} for p in asked[-1][1]]}}})

    purls = spark.createDataFrame([("p1",), ("p2",), ("p1",), ("p3",)], "purl string")
    got = fetch(spark, purls, SERVICE, jwt="t", per_call=2, post=post).collect()
    assert {r.purl for r in got} == {"p1", "p2", "p3"} and len(asked) == 2 and asked[0][0].endswith("/v1/symbols")


def test_images_and_programs(spark):
    files = spark.createDataFrame([("i", "/lib/apk/db/installed", "P:a\nV:1\n"), ("i", "/etc/alpine-release", "3.20.0_alpha\n"), ("j", "/lib/apk/db/installed", "P:b\nV:2\n"), ("k", "/lib/apk/db/installed", None)], "image string, path string, text string")
    assert {(r["name"], r.ecosystem) for r in apk_packages(files).collect()} == {("a", "Alpine:v3.20"), ("b", "Alpine")}
    modules = b"x" * FRAME + b"dep\ta.org/b\tv1.0.0\th\n" + b"y" * FRAME
    raw = MAGIC + bytes([8, 2]) + bytes(16) + b"\x06go1.21" + bytes([len(modules)]) + modules
    rows = spark.createDataFrame([("/bin/x", bytearray(raw)), ("/bin/y", bytearray(b"no")), ("/bin/z", None), ("/a.txt", bytearray(raw))], "path string, content binary")
    assert {(r["name"], r.version) for r in go_binary_packages(rows).collect()} == {("stdlib", "1.21"), ("a.org/b", "1.0.0")}


def test_ignored_paths(spark):
    df = spark.createDataFrame([("a/x.log",), ("a/b",), (None,), ("dir/q",)], "path string")
    assert [r.path for r in drop_ignored(df, read_rules(["*.log", "dir/"], "")).collect()] == ["a/b", None]


def test_small_functions(spark):
    assert toml_tables(["[[p]]", "a = 1", "", "[[p]]", "b", "[m]", "c"], "[[p]]") == [(1, 2, 1, 6), (4, 5, 1, 2)] and toml_tables([], "[[p]]") == []
    assert [r[0] for r in spark.createDataFrame([(1,), (2**40,), (None,)], "n long").select(safe_int(F.col("n"))).collect()] == [1, None, None]


def test_vulnerabilities(spark):
    schema = """source_path string, package struct<purl:string>, vulnerabilities array<struct<id:string,modified:timestamp_ntz,published:timestamp_ntz,withdrawn:timestamp_ntz,aliases:array<string>,summary string,
      affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>,severity array<struct<type:string,score:string>>>>"""
    vuln = ("V1", None, None, None, ["CVE-1"], "s", [(("npm", "a", "p"), None, None), (None, None, None)], [("CVSS_V3", "x"), ("odd", "y")])
    df = spark.createDataFrame([("b", ("q",), [vuln]), ("a", ("p",), [vuln[:5] + ("first",) + vuln[6:], None, (None,) * 8]), ("c", None, None)], schema.replace("summary string", "summary:string").replace("affected array", "affected:array").replace("severity array", "severity:array"))
    (row,) = vulnerability_rows(df).collect()
    assert row.description == "first" and row.affects == ["p"] and [r.method for r in row.ratings] == ["CVSSv3", None] and row.references == ["CVE-1"] and row.updated is None


def test_places_of_json_objects():
    text = '{\n  "dependencies": {\n    "a": {\n      "version": "}{",\n      "dependencies": {\n        "b": { "x": [{"c": {}}] }\n      }\n    }, "d": {}\n  },\n  "other": {"e": {}}\n}\n'
    assert json_objects(text, "dependencies") == {("a",): (3, 8, 5, 6), ("a", "b"): (6, 6, 9, 34), ("d",): (8, 8, 5, 15)}
    assert json_objects("", "x") == {} and json_objects('{"x": [1, {"y": {}}]}', "x") == {}
    deep = '{"k":' * 3000 + "{}" + "}" * 3000
    assert len(json_objects(deep, "k")) == 2999


def test_vulnerability_text(spark):
    kind = "array<struct<id:string,modified:timestamp_ntz,affected:array<struct<package:struct<ecosystem:string,name:string,purl:string>,versions:array<string>>>>>"
    rows = [(1, None), (2, []), (3, [None]), (4, [("V", None, [((None, None, ""), ["1"]), (("npm", "a", None), None), None])])]
    df = spark.createDataFrame(rows, f"id int, v {kind}")
    got = {r.id: r.j for r in df.select("id", vulnerability_json(F.col("v")).alias("j")).collect()}
    assert got == {1: "[]", 2: "[]", 3: "[]", 4: '[{"id":"V","affected":[{"versions":["1"]},{"package":{"ecosystem":"npm","name":"a"}}]}]'}
    back = df.where("id = 4").select(F.from_json(vulnerability_json(F.col("v")), kind).alias("v")).first().v
    assert back[0].id == "V" and len(back[0].affected) == 2
