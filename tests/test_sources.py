from __future__ import annotations

import json

import pytest

from lockgrain.sources import gitignore
from lockgrain.sources.commits import find_commit
from lockgrain.sources.files import decode_bytes, relative_to
from lockgrain.sources.formats import line_formats, manifests, maven
from lockgrain.sources.formats.go_binary import FRAME, MAGIC, go_binary, may_be_program
from lockgrain.sources.formats.json_formats import conan_reference, merge_groups
from lockgrain.sources.formats.toml_yaml_formats import pnpm_path
from lockgrain.sources.lockfiles import LIBRARY_ONLY, PARSERS, list_parsers, parse_text, parser_of


def short(parser, text, manifest=(), path="/p/f"):
    rows, failed = parse_text(parser, path, text, list(manifest))
    assert not failed
    return [(r["name"], r["version"], r["commit"], r["dep_groups"], r["is_direct"], r["target_versions"]) for r in rows]


def test_commits():
    urls = {
        "git+ssh://git@github.com/o/r.git#abc123": "abc123", "https://x.org/r.git#ffee": "ffee", "https://codeload.github.com/o-1/r.js/tar.gz/0a1b": "0a1b", "r@https://x/y#commit=12ab": "12ab",
        "github:o/r#v1": "v1", "https://github.com/o/r?x=1&ref=main": "main", "https://gitlab.com/o/r#frag": "frag", "https://example.org/r#frag": "", "": "", "1.2.3": "",
    }
    assert {u: find_commit(u) for u in urls} == urls
    assert find_commit(None) == ""
    odd = {"x@git+https://h/r#a_1": "a_1", "@git://h/r#a": "", "git://#a": "", "git://h/r#a-b": "", "https://x.org/.git#a": "", "https://codeload.github.com/o/r/zip/a": "", "https://codeload.github.com/tar.gz/a": "", "gitlab:#a": "", "#commit=a": "", "http://[x": ""}
    assert {u: find_commit(u) for u in odd} == odd


def test_npm_versions():
    v1 = {"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0", "dev": True}}}, "b": {"version": "2.0.0", "optional": True}, "c": {"version": "npm:real@3.0.0"}, "d": {"version": "file:../d"}, "e": {"version": "git+https://h/r.git#abc", "dev": True}}}
    assert short("package-lock.json", json.dumps(v1)) == [
        ("a", "1.0.0", "", ["prod"], False, []), ("b", "2.0.0", "", ["dev", "optional", "prod"], False, []), ("d", "", "", ["prod"], False, []), ("e", "", "abc", ["dev"], False, []), ("real", "3.0.0", "", ["prod"], False, []),
    ]
    v2 = {"packages": {"": {"dependencies": {"a": "^1", "@s/b": "npm:x@~2"}, "devDependencies": {"c": "file:./c"}}, "node_modules/a": {"version": "1.1", "devOptional": True}, "node_modules/@s/b": {"version": "2.0"}, "node_modules/c": {"link": True, "resolved": "c"}, "c": {}, "node_modules/a/node_modules/d": {"name": "dd", "version": "1", "optional": True}}}
    assert short("package-lock.json", json.dumps(v2)) == [
        ("@s/b", "2.0", "", ["prod"], False, ["~2"]), ("a", "1.1", "", ["dev", "optional"], False, ["^1"]), ("c", "0.0.0", "", ["prod"], False, []), ("dd", "1", "", ["optional", "prod"], False, []),
    ]
    assert merge_groups(["dev"], []) == [] and merge_groups(["dev"], ["a", "dev"]) == ["a", "dev"]
    deep = {"version": "1"}
    for _ in range(400):
        deep = {"version": "1", "dependencies": {"x": deep}}
    assert len(short("package-lock.json", json.dumps({"dependencies": {"top": deep}}))) == 2


def test_pnpm():
    v9 = """lockfileVersion: '9.0'
importers:
  .:
    dependencies:
      a: {specifier: ^1.0.0, version: 1.0.0(p@2)}
    devDependencies:
      b: {specifier: ^2.0.0, version: 2.10}
packages: {}
snapshots:
  a@1.0.0(p@2):
    dependencies: {c: 3.0.0, b: 2.10}
  c@3.0.0:
    optionalDependencies: {a: 1.0.0(p@2)}
"""
    assert short("pnpm-lock.yaml", v9) == [("a", "1.0.0", "", ["prod"], True, ["^1.0.0"]), ("b", "2.10", "", ["dev", "prod"], True, ["^2.0.0"]), ("c", "3.0.0", "", ["prod"], False, [])]
    v5 = "lockfileVersion: 5.3\nspecifiers: {a: ^1}\ndependencies: {a: 1.0.0}\npackages:\n  /a/1.0.0: {dev: false}\n  /@s/b/2.0.0_peer: {dev: true}\n  file:x: {name: loc, version: 1.0.0}\n"
    assert short("pnpm-lock.yaml", v5) == [("@s/b", "2.0.0", "", ["dev"], False, []), ("a", "1.0.0", "", [], True, ["^1"]), ("loc", "1.0.0", "", [], False, [])]
    assert pnpm_path("/a@1.2.3") == ("a", "1.2.3") and pnpm_path("x") == ("", "") and pnpm_path("/a/next") == ("", "")
    assert short("pnpm-lock.yaml", "") == []


def test_yarn():
    text = '# yarn lockfile v1\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.2.0"\n  resolved "https://codeload.github.com/o/r/tar.gz/abc"\n  dependencies:\n    b "^2.0.0"\n    c "npm:^3"\n\nb@^2.0.0:\n  version "2.0.0"\n\n__metadata:\n  version: 6\n\n"c@npm:^3, al@npm:real@^9":\n  version: 3.0.0\n  resolution: "c@npm:3.0.0"\n'
    rows, _ = parse_text("yarn.lock", "/p/yarn.lock", text)
    got = {r["name"]: r for r in rows}
    assert got["@s/a"]["target_versions"] == ["^1.0.0", "^1.1.0"] and got["@s/a"]["commit"] == "abc" and got["@s/a"]["children"] == ["b@2.0.0"]
    assert got["real"]["version"] == "3.0.0" and got["b"]["version"] == "2.0.0" and "__metadata" not in got


def test_gemfile_lock_and_gemfile():
    lock = "GIT\n  remote: https://x\n  revision: abc123\n  specs:\n    g (1.0)\n\nGEM\n  remote: https://rubygems.org/\n  specs:\n    rails (7.0.1)\n      sub (>= 1)\n    nok (1.13-x86_64-linux)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  rails (~> 7)\n  other\n\nBUNDLED WITH\n   2.3\n"
    gemfile = "source 'https://rubygems.org'\ngem 'rails', '~> 7', group: :web\n# gem 'nok'\ngroup :test, :ci do\n  gem \"nok\"\nend\n"
    rows = {r["name"]: r for r in parse_text("Gemfile.lock", "/p/Gemfile.lock", lock, [("Gemfile", "/p/Gemfile", gemfile)])[0]}
    assert rows["g"]["commit"] == "abc123" and rows["rails"]["is_direct"] and rows["other"]["is_direct"] and rows["nok"]["version"] == "1.13" and "sub" not in rows
    assert rows["rails"]["dep_groups"] == ["web"] and rows["nok"]["dep_groups"] == ["test", "ci"]
    assert rows["rails"]["block"] == {"file_name": "/p/Gemfile", "line_start": 2, "line_end": 2, "column_start": 1, "column_end": 33}
    assert rows["nok"]["name_loc"]["line_start"] == 5
    spec = "Gem::Specification.new do |s|\n  s.add_dependency 'rails', '>= 6', '< 8'\n  s.add_development_dependency('nok')\nend\n"
    rows = {r["name"]: r for r in parse_text("Gemfile.lock", "/p/Gemfile.lock", lock, [("gemspec", "/p/x.gemspec", spec)])[0]}
    assert rows["nok"]["dep_groups"] == ["dev"] and rows["rails"]["version_loc"]["column_start"] == 29 and rows["rails"]["block"]["column_start"] == 3


def test_go_mod():
    text = "module m\n\ngo 1.21\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d/v2 v2.0.0 // indirect\n\tgithub.com/e/f v0.0.0-2020-abcdef\n\tx.org/l v1.0.0\n)\nrequire y.org/z/v8 master\nreplace github.com/a/b => fork.org/b v1.2.4\nreplace x.org/l v9.9.9 => q.org/q v1.0.0\nreplace github.com/e/f => ../local\n"
    got = {r["name"]: r for r in parse_text("go.mod", "/p/go.mod", text)[0]}
    assert got["fork.org/b"]["version"] == "1.2.4" and got["fork.org/b"]["is_direct"] and not got["github.com/c/d/v2"]["is_direct"]
    assert got["x.org/l"]["version"] == "1.0.0" and got["github.com/e/f"]["version"] == "" and got["y.org/z/v8"]["version"] == "8" and got["stdlib"]["version"] == "1.21"
    assert got["github.com/c/d/v2"]["block"]["line_start"] == 7 and got["github.com/c/d/v2"]["name_loc"]["column_start"] == 2


def test_requirements():
    text = "# autogenerated by pip-compile\nFlask_X[async]==1.0 ; python_version > '3'\n    # via -r in.txt\nsix>=1.2 \\\n  --hash=sha256:aa\n    # via flask\nwheel @ https://h/wheel-2.1-py3-none-any.whl\nnot!=3\n-r more.txt\n-r https://x/y.txt\n-e .\n./local\nlast\n    # via\n    #   flask\n    #   six\n"
    rows, includes = line_formats.requirements("/p/dev-requirements.txt", text)
    got = {r["name"]: (r["version"], r["is_direct"], r["dep_groups"]) for r in rows}
    assert got == {"flask-x": ("1.0", True, ["dev-requirements"]), "six": ("1.2", False, ["dev-requirements"]), "wheel": ("2.1", True, ["dev-requirements"]), "not": ("", True, ["dev-requirements"]), "last": ("", False, ["dev-requirements"])}
    assert includes == ["/p/more.txt"]
    assert line_formats.requirements("/p/requirements.txt", "") == ([], [])


def test_small_formats():
    assert short("Cargo.lock", '[[package]]\nname = "a"\nversion = "1.0"\n') == [("a", "1.0", "", [], False, [])]
    assert short("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\noptional = true\n[package.source]\nresolved_reference = "abc"\n') == [("a", "1", "abc", ["optional"], False, [])]
    assert short("pdm.lock", '[[package]]\nname = "a"\nversion = "1"\ngroups = ["dev", "x"]\n[[package]]\nname = "b"\nversion = "1"\n') == [("a", "1", "", ["dev"], False, []), ("b", "1", "", ["optional"], False, [])]
    assert short("pubspec.lock", 'packages:\n  a:\n    dependency: "direct dev"\n    description: {resolved-ref: abc}\n    version: "1.10"\n  b: {description: flutter, version: 0.0.0, dependency: transitive}\n') == [("a", "1.10", "abc", ["dev"], False, []), ("b", "0.0.0", "", [], False, [])]
    assert short("composer.lock", '{"packages": [{"name": "v/p", "version": "1", "dist": {"reference": "abc"}}], "packages-dev": [{"name": "v/q", "version": "2"}]}') == [("v/p", "1", "abc", [], False, []), ("v/q", "2", "", ["dev"], False, [])]
    assert short("conan.lock", '{"graph_lock": {"nodes": {"0": {"path": "c"}, "1": {"ref": "zlib/1.2@u/c#rev"}, "2": {"ref": "noname"}}}}') == [("zlib", "1.2", "", [], False, [])]
    assert short("conan.lock", '{"build_requires": ["n/1#r%1"], "requires": ["m/2"]}') == [("m", "2", "", ["requires"], False, []), ("n", "1", "", ["build-requires"], False, [])]
    assert conan_reference("a/1@u/c#r:pkg#prev%12.5") == ("a", "1")
    assert short("packages.lock.json", '{"version": 1, "dependencies": {"net6": {"A": {"type": "Direct", "resolved": "1"}, "P": {"type": "project"}}}}') == [("A", "1", "", [], True, [])]
    with pytest.raises(ValueError):
        short("packages.lock.json", '{"version": 3}')
    assert short("Pipfile.lock", '{"default": {"a": {"version": "==1"}, "n": {}}, "develop": {"a": {"version": "==1"}, "b": {"version": "==2"}}}') == [("a", "1", "", [], False, []), ("b", "2", "", ["dev"], False, [])]
    assert short("renv.lock", '{"Packages": {"a": {"Package": "a", "Version": "1", "Repository": "CRAN"}, "b": {"Package": "b", "Version": "1", "Repository": "X"}}}') == [("a", "1", "", [], False, [])]
    assert short("gradle.lockfile", "# c\nempty=x\ng:a:1=s1,s2\nbad\n") == [("g:a", "1", "", ["s1", "s2"], False, [])]
    assert short("gradle/verification-metadata.xml", '<?xml version="1.0" encoding="UTF-16"?><v xmlns="urn:x"><components><component group="g" name="a" version="1"/></components></v>') == [("g:a", "1", "", [], False, [])]
    assert short("mix.lock", '%{\n  "a": {:hex, :a, "1.0", "hash", [:mix]},\n  "g": {:git, "https://x", "abc", []},\n  "s": {:x},\n}\n') == [("a", "1.0", "hash", [], False, []), ("g", "", "abc", [], False, [])]
    assert short("csv", "npm,,a,1\n,,b,abc\n") == [("a", "1", "", [], False, []), ("b", "", "abc", [], False, [])]
    assert [(r["name"], r["ecosystem"]) for r in line_formats.apk("/x", "P:a\nV:1\nc:abc\n\nV:2\n", "3.10.2\n")] == [("a", "Alpine:v3.10")]
    dpkg = "Package: base-files\nStatus: install ok installed\nVersion: 12.4+deb12u5\n\nPackage: x\nStatus: deinstall ok config-files\nVersion: 1\n\nPackage: y\nSource: src (2.0)\nVersion: 1\n"
    assert [(r["name"], r["version"], r["ecosystem"]) for r in line_formats.dpkg("/x", dpkg)] == [("base-files", "12.4+deb12u5", "Debian:12"), ("src", "2.0", "Debian:12")]
    assert short("results", '{"results": [{"packages": [{"package": {"name": "a", "version": "1", "ecosystem": "npm"}}, {"package": {"name": "b", "commit": "abc"}}]}]}') == [("a", "1", "", [], False, []), ("b", "", "abc", [], False, [])]


def test_go_binary():
    text = lambda s: bytes([len(s) & 0x7F | 0x80, len(s) >> 7]) + s if len(s) > 127 else bytes([len(s)]) + s
    modules = b"x" * FRAME + b"path\tm\nmod\tm\t(devel)\ndep\ta.org/b\tv1.0.0\th1:x\ndep\tc.org/d\tv2.0.0\n=>\te.org/f\tv3.0.0\th1:y\n" + b"y" * FRAME
    raw = b"ELF" + MAGIC + bytes([8, 2]) + bytes(16) + text(b"go1.21.3") + text(modules)
    assert [(r["name"], r["version"]) for r in go_binary("/bin/x", raw)] == [("stdlib", "1.21.3"), ("a.org/b", "1.0.0"), ("e.org/f", "3.0.0")]
    with pytest.raises(ValueError):
        go_binary("/bin/x", b"nothing")
    assert may_be_program("/bin/x") and may_be_program("x.exe") and not may_be_program("x.txt") and not may_be_program(".hidden")


def test_manifests():
    lock = json.dumps({"packages": {"": {"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}, "node_modules/a": {"version": "1"}, "node_modules/b": {"version": "2", "dev": True}, "node_modules/t": {"version": "3"}}})
    manifest = '{\n  "devDependencies": {\n    "b": "2"\n  },\n  "dependencies": {"a": "^1"}\n}\n'
    rows = {r["name"]: r for r in parse_text("package-lock.json", "/p/l", lock, [("package.json", "/p/package.json", manifest)])[0]}
    assert rows["a"]["is_direct"] and rows["a"]["dep_groups"] == ["prod"] and rows["b"]["dep_groups"] == ["dev"] and not rows["t"]["is_direct"]
    assert rows["b"]["block"] == {"file_name": "/p/package.json", "line_start": 3, "line_end": 3, "column_start": 5, "column_end": 13}
    rows, failed = parse_text("package-lock.json", "/p/l", lock, [("package.json", "/p/package.json", "broken")])
    assert len(rows) == 3 and failed
    rows = {r["name"]: r for r in parse_text("poetry.lock", "/p/l", '[[package]]\nname = "django"\nversion = "4"\n[[package]]\nname = "black"\nversion = "1"\n', [("pyproject.toml", "/p/pyproject.toml", '[tool.poetry.dependencies]\nDjango = "^4"\n[tool.poetry.group.dev.dependencies]\nblack = "1"\n')])[0]}
    assert rows["django"]["is_direct"] and rows["django"]["version_loc"]["column_start"] == 11 and rows["black"]["dep_groups"] == ["dev"] and rows["django"]["dep_groups"] == []
    rows = {r["name"]: r for r in parse_text("gradle.lockfile", "/p/gradle.lockfile", "g.x:a:1.0=r\ng.x:b:2=r\n", [("build.gradle", "/p/build.gradle", "runtimeOnly 'g.x:a:1.0'\nimplementation(\"g.x:b:9\")\n\n")])[0]}
    assert rows["g.x:a"]["dep_groups"] == ["r", "runtimeClasspath"] and rows["g.x:a"]["version_loc"]["column_start"] == 20 and rows["g.x:b"]["block"] is None and not rows["g.x:a"]["is_direct"]
    rows = {r["name"]: r for r in parse_text("composer.lock", "/p/l", '{"packages": [{"name": "v/p", "version": "1"}]}', [("composer.json", "/p/composer.json", '{"require": {"v/p": "^1"}}')])[0]}
    assert rows["v/p"]["is_direct"] and rows["v/p"]["dep_groups"] == []
    project = '<Project>\n  <ItemGroup>\n    <PackageReference Include="A" Version="1" PrivateAssets="all" />\n    <PackageReference>\n      <Include>B</Include>\n      <Version>2</Version>\n    </PackageReference>\n  </ItemGroup>\n</Project>\n'
    lock = '{"version": 1, "dependencies": {"n": {"A": {"type": "Direct", "resolved": "1"}, "B": {"type": "Transitive", "resolved": "2"}}}}'
    rows = {r["name"]: r for r in parse_text("packages.lock.json", "/p/l", lock, [("csproj", "/p/x.csproj", project)])[0]}
    assert rows["A"]["dep_groups"] == ["dev"] and rows["B"]["dep_groups"] == ["prod"] and rows["B"]["block"]["line_start"] == 4 and rows["B"]["block"]["line_end"] == 7
    assert rows["A"]["block"]["column_start"] == 5 and rows["A"]["version_loc"]["column_start"] == 44
    assert manifests.csproj_references("<Project/>") == {}


def test_maven():
    parent = maven.decode("/p/pom.xml", "<project><groupId>g</groupId><artifactId>par</artifactId><version>1</version><properties><a>${b}</a><b>2</b><loop>${loop}</loop></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>7</version><scope>Test</scope></dependency></dependencies></dependencyManagement></project>")
    child = maven.decode("/p/c/pom.xml", "<project>\n<parent><groupId>g</groupId><artifactId>par</artifactId><version>1</version></parent>\n<artifactId>c</artifactId>\n<dependencies>\n<dependency><groupId>g</groupId><artifactId>x</artifactId><version>${a}</version><scope>RUNTIME</scope></dependency>\n<dependency><groupId>${pom.groupId}</groupId><artifactId>m</artifactId></dependency>\n<dependency><groupId>g</groupId><artifactId>r</artifactId><version>[1.5,2)</version></dependency>\n<dependency><groupId>g</groupId><artifactId>l</artifactId><version>${loop}${none}</version></dependency>\n</dependencies></project>")
    assert maven.parent_path(child) == ("/p/pom.xml", "g/par/1/par-1.pom") and maven.parent_path(parent) is None
    got = {r["name"]: r for r in maven.packages([child, parent])}
    assert got["g:x"]["version"] == "2" and got["g:x"]["dep_groups"] == ["runtime"] and got["g:x"]["version_loc"]["file_name"] == "/p/pom.xml"
    assert got["g:m"]["version"] == "7" and got["g:m"]["dep_groups"] == ["Test"] and got["g:r"]["version"] == "1.5" and got["g:l"]["version"] == ""
    assert got["g:x"]["block"]["line_start"] == 5 and got["g:r"]["version_loc"]["column_start"] == 68
    made = maven.artifact([child, parent], "/p/pom.xml")
    assert made["name"] == "g:c" and made["version"] == "1" and made["depends_on"]["filename"] == "/p/pom.xml"


def test_selection_and_decoding(spark):
    names = {"/a/package-lock.json": "package-lock.json", "/a/buildscript-gradle.lockfile": "gradle.lockfile", "/gradle/verification-metadata.xml": "gradle/verification-metadata.xml", "/a/verification-metadata.xml": None, "/dev-requirements.txt": "requirements.txt", "/requirements/x.txt": None, "pom.xml": "pom.xml", "/a/x.lock": None}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path: r.p for r in df.select("path", parser_of(df.path).alias("p")).collect()} == names
    assert len(list_parsers()) == 20 and not set(PARSERS) & set(LIBRARY_ONLY)
    assert decode_bytes("é".encode("utf-16")) == "é" and decode_bytes(b"\xef\xbb\xbfa") == "a" and decode_bytes(b"\xe9") == "�" and decode_bytes(b"") == ""
    rel = spark.createDataFrame([("/r/a/b",), ("/rx/a",), ("/r",)], "p string")
    assert [r[0] for r in rel.select(relative_to(rel.p, "/r/")).collect()] == ["a/b", "rx/a", "r"]


def test_gitignore():
    rules = gitignore.read_rules(["# c", "", "*.log", "!keep.log", "/top", "dir/", "a/**/z", "sp\\ ace", "[ab].txt", "doc/*.md"], "") + gitignore.read_rules(["inner"], "sub")
    ignored = lambda p: gitignore.is_ignored(rules, p)
    assert ignored("x.log") and ignored("d/x.log") and not ignored("d/keep.log")
    assert ignored("top") and not ignored("d/top") and ignored("dir/f") and ignored("q/dir/f") and not ignored("dir")
    assert ignored("a/z") and ignored("a/b/c/z") and ignored("sp ace") and ignored("a.txt") and not ignored("c.txt")
    assert ignored("doc/x.md") and not ignored("doc/s/x.md") and ignored("sub/inner") and not ignored("inner") and ignored("sub/q/inner/x")
