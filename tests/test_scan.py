from __future__ import annotations

import json

import pytest

from lockgrain.cli import main
from lockgrain.scan import NoPackagesFound, ScanOptions, scan, to_cyclonedx
from lockgrain.sources.lockfiles import parse_as
from lockgrain.streaming import stream_packages


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    lock = '{"packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1.0"}, "node_modules/b": {"version": "2.0"}}}'
    put(".git/HEAD", "")
    put(".gitignore", "skipped/\n")
    put("package-lock.json", lock)
    put("package.json", '{\n "dependencies": {\n  "a": "^1"\n }\n}')
    put("skipped/package-lock.json", lock.replace("2.0", "9.9"))
    put("wide/package-lock.json", ("﻿" + lock).encode("utf-16"))
    put("py/requirements.txt", "flask==1.0\n-r sub/more.txt\n")
    put("py/sub/more.txt", "six==1.2\n-r ../requirements.txt\n")
    put("pom.xml", "<project><groupId>g</groupId><artifactId>top</artifactId><version>1</version><properties><v>3</v></properties></project>")
    put("m/pom.xml", "<project><parent><groupId>g</groupId><artifactId>top</artifactId><version>1</version></parent><artifactId>m</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>top</artifactId><version>1</version></dependency><dependency><groupId>q</groupId><artifactId>r</artifactId><version>${v}</version></dependency></dependencies></project>")
    put("m/src/A.java", "class A { Object o = new q.Box(); }")
    put("bad/composer.lock", "no json")
    return tmp_path


def test_scan(spark, tree):
    advisories = spark.createDataFrame([("pkg:maven/q/r@3", "ADV-1", "class", "q", "Box"), ("pkg:maven/q/r@3", "ADV-2", "class", "q", "No")], "purl string, advisory_id string, symbol_type string, symbol_value string, symbol_name string")
    result = scan(spark, ScanOptions((str(tree),), reachability=True, advisories=advisories))
    rows = {(r.source_path, r["name"]): r for r in result.packages.collect()}
    assert set(rows) == {("package-lock.json", "a"), ("package-lock.json", "b"), ("wide/package-lock.json", "a"), ("wide/package-lock.json", "b"), ("py/requirements.txt", "flask"), ("py/requirements.txt", "six"), ("m/pom.xml", "g:top"), ("m/pom.xml", "q:r")}
    assert rows["package-lock.json", "a"].block.file_name == "package.json" and rows["package-lock.json", "a"].is_direct
    assert rows["m/pom.xml", "q:r"].version == "3" and "reachable-symbol-location:ADV-1" in rows["m/pom.xml", "q:r"].metadata
    assert [(r.path, r.parser) for r in result.errors.collect()] == [("bad/composer.lock", "composer.lock")]
    made = {r.filename: r for r in result.artifacts.collect()}
    assert made["m/pom.xml"].depends_on.filename == "pom.xml" and made["pom.xml"].depends_on is None
    bom = to_cyclonedx(spark, result)
    refs = [c["bom-ref"] for c in bom["components"]]
    assert refs == sorted(refs) and {"pkg:npm/a@1.0", "pom.xml"} <= set(refs)
    assert {"ref": "m/pom.xml", "dependsOn": ["pom.xml", "pom.xml"]} in bom["dependencies"]
    assert [(v["id"], v.get("affects")) for v in bom["vulnerabilities"]] == [("ADV-1", [{"ref": "pkg:maven/q/r@3"}]), ("ADV-2", None)]
    direct = next(c for c in bom["components"] if c["bom-ref"] == "pkg:npm/a@1.0")["properties"]
    assert {"name": "osv-scanner:is-direct", "value": "true"} in direct


def test_options(spark, tree):
    flat = scan(spark, ScanOptions((str(tree),), recursive=False, parsers=("package-lock.json",)))
    assert {r.source_path for r in flat.packages.collect()} == {"package-lock.json"} and flat.artifacts.count() == 0
    everything = scan(spark, ScanOptions((str(tree),), ignore=False, parsers=("package-lock.json",)))
    assert "skipped/package-lock.json" in {r.source_path for r in everything.packages.collect()}
    one = scan(spark, ScanOptions((str(tree / "package-lock.json"),)))
    assert {r.source_path for r in one.packages.collect()} == {"package-lock.json"}
    with pytest.raises(NoPackagesFound):
        scan(spark, ScanOptions((str(tree / "bad"),)))


def test_command_line(spark, tree, tmp_path, capsys):
    out = tmp_path / "out.json"
    assert main([str(tree), "--output", str(out), "--enable-parsers", "package-lock.json"], spark) == 0
    doc = json.loads(out.read_text())
    assert [r["source"]["path"] for r in doc["results"]] == ["package-lock.json", "wide/package-lock.json"]
    assert main(["scan", str(tree / "bad"), "-f", "cyclonedx-1-5"], spark) == 0
    assert json.loads(capsys.readouterr().out)["components"] == []
    assert main(["scan", "--format", "nonsense", str(tree)], spark) == 127
    assert main(["scan", str(tree / "absent")], spark) == 127


def test_parse_as_and_stream(spark, tree, tmp_path):
    files = spark.createDataFrame([("/x/odd.name", "npm,,a,1\n")], "path string, text string")
    assert [r["name"] for r in parse_as(files, "csv").collect()] == ["a"]
    with pytest.raises(ValueError):
        parse_as(files, "nothing")
    with pytest.raises(Exception, match="field"):
        parse_as(spark.createDataFrame([("/x", ",,,\n")], "path string, text string"), "csv").collect()
    query = stream_packages(spark, str(tree), ["package-lock.json"]).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("streamed").where("error is null").count() == 6


def test_advisories_from_a_service(spark, tree, tmp_path, capsys):
    """Without any the scan goes on; required ones that can't be had end it with 129; a service is asked for direct packages."""
    from lockgrain.sources.advisories import Service, fetch

    asked = []

    def post(url, headers, body):
        asked.extend(json.loads(body)["data"]["attributes"]["purls"])
        return json.dumps({"data": {"attributes": {"results": [{"purl": "pkg:maven/q/r@3", "vulnerable_symbols": [{"advisory_id": "A", "symbols": [{"type": "class", "value": "q", "name": "Box"}]}]}]}}})

    ask = lambda s, purls: fetch(s, purls, Service((), "h.example", "v1", "Authorization", ("", "")), jwt="t", post=post)
    result = scan(spark, ScanOptions((str(tree),), reachability=True, ask_advisories=ask))
    assert "pkg:maven/q/r@3" in asked and {r.purl: r.reachable for r in result.reachable.collect()} == {"pkg:maven/q/r@3": ["A"]}
    out = tmp_path / "o.json"
    closed = ["--reachability", "--advisories-url", "http://127.0.0.1:9/v1", "--advisories-token", "t", "--enable-parsers", "package-lock.json", "--output", str(out)]
    assert main([str(tree), *closed], spark) == 0 and json.loads(out.read_text())["results"]
    assert main([str(tree), *closed, "--require-advisories"], spark) == 129
    assert main([str(tree), "--reachability", "--require-advisories", "--enable-parsers", "package-lock.json"], spark) == 129


def test_vulnerabilities_in_the_document(spark, tree):
    vuln = "struct<id:string,modified:timestamp_ntz,published:timestamp_ntz,withdrawn:timestamp_ntz,aliases:array<string>,summary:string,affected:array<struct<package:struct<ecosystem:string,name:string,purl:string>>>,severity:array<struct<type:string,score:string>>,references:array<struct<type:string,url:string>>,credits:array<struct<name:string,contact:array<string>>>>"
    one = ("V1", None, None, None, ["CVE-1"], "bad", [(("npm", "a", "pkg:npm/a@1.0"),), (None,)], [("CVSS_V3", "x")], [("ADVISORY", "u1"), ("WEB", "u2")], [("n", ["c"])])
    records = spark.createDataFrame([("s", ("pkg:npm/a@1.0",), [one]), ("s", ("pkg:npm/other@1",), [("V2", *one[1:])])], f"source_path string, package struct<purl:string>, vulnerabilities array<{vuln}>")
    bom = to_cyclonedx(spark, scan(spark, ScanOptions((str(tree),), parsers=("package-lock.json",))), records)
    assert bom["vulnerabilities"] == [
        {"bom-ref": "V1", "id": "V1", "description": "bad", "references": [{"id": "CVE-1"}], "ratings": [{"method": "CVSSv3", "vector": "x"}], "advisories": [{"url": "u1"}], "affects": [{"ref": "pkg:npm/a@1.0"}], "credits": {"organizations": [{"name": "n", "url": ["c"]}]}}
    ]


def test_json_lines_and_shared_folders(spark, tree, tmp_path):
    out = tmp_path / "lines"
    assert main([f"file://{tree}", "--format", "jsonl", "--output", str(out), "--enable-parsers", "package-lock.json"], spark) == 0
    rows = [json.loads(line) for p in out.glob("part-*") for line in p.read_text().splitlines()]
    assert len(rows) == 4 and not any("skipped" in r["source_path"] for r in rows)
    assert main([f"file://{tree}", "--no-ignore", "--format", "jsonl", "--output", str(out), "--enable-parsers", "package-lock.json"], spark) == 0
    assert sum(len(p.read_text().splitlines()) for p in out.glob("part-*")) == 6
    assert main([str(tree), "--format", "jsonl"], spark) == 127
