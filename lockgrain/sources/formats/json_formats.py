"""Lockfiles in JSON: npm, composer, conan, NuGet, Pipenv, renv, and results of earlier runs."""

from __future__ import annotations

from lockgrain.functions.jsontext import read_json
from lockgrain.sources.commits import find_commit
from lockgrain.sources.formats.common import package, strings, table, text_of

LOCAL_PREFIXES = ("file", "link", "portal")


def read(text: str) -> dict:
    value = read_json(text)
    if not isinstance(value, dict):
        raise ValueError("no JSON object")
    return value


def merge_groups(a: list[str], b: list[str]) -> list[str]:
    """No groups on either side means none: the package is needed in production."""
    return sorted({*a, *b}) if a and b else []


class _Merged(dict):
    def put(self, key: str, row: dict) -> None:
        if key in self:
            row = row | {"dep_groups": merge_groups(self[key]["dep_groups"], row["dep_groups"])}
        self[key] = row


def npm(path: str, text: str) -> list[dict]:
    lock = read(text)
    rows = _flat_npm(table(lock["packages"])) if isinstance(lock.get("packages"), dict) else _nested_npm(table(lock.get("dependencies")))
    return list(rows.values())


def _nested_npm(top: dict) -> dict[str, dict]:
    """Lockfile version 1. Inner levels come before the entry that holds them; explicit stack, so depth has no limit."""
    order: list[tuple[str, dict]] = []
    stack = [iter(sorted(top.items()))]
    held: list[tuple[str, dict]] = []
    while stack:
        for name, entry in stack[-1]:
            entry = table(entry)
            held.append((name, entry))
            stack.append(iter(sorted(table(entry.get("dependencies")).items())))
            break
        else:
            stack.pop()
            if held:
                order.append(held.pop())
    rows = _Merged()
    for name, entry in order:
        spec = text_of(entry.get("version"))
        version, key = spec, spec
        if spec.startswith("npm:"):
            name, _, version = spec[4:].rpartition("@")
        commit = ""
        if spec.startswith("file:"):
            version = key = ""
        elif commit := find_commit(spec):
            version, key = "", commit
        groups = [g for g, on in (("optional", entry.get("optional") is True), ("dev", entry.get("dev") is True), ("prod", entry.get("dev") is not True)) if on]
        rows.put(f"{name}@{key}", package(name, version, "npm", "NPM", commit=commit, dep_groups=groups))
    return rows


def npm_path_name(path: str) -> str:
    """The last part of a package path, with its scope."""
    parts = path.rstrip("/").split("/")
    return "/".join(parts[-2:]) if len(parts) > 1 and parts[-2].startswith("@") else parts[-1]


def local_spec(spec: str) -> str:
    for p in LOCAL_PREFIXES:
        if spec.startswith(p + ":"):
            spec = spec[len(p) + 1 :].removeprefix("./")
    return spec


def _flat_npm(entries: dict) -> dict[str, dict]:
    """Lockfile version 2 and 3: a map by path; the entry '' is the project and holds the specs of direct packages."""
    root = table(entries.get(""))
    specs = table(root.get("devDependencies")) | table(root.get("dependencies"))
    rows = _Merged()
    for path, entry in sorted(entries.items()):
        entry = table(entry)
        if path == "" or entry.get("link") is True:
            continue
        name = text_of(entry.get("name")) or npm_path_name(path)
        version, commit = text_of(entry.get("version")), find_commit(text_of(entry.get("resolved")))
        key = commit or version
        version = version if key else "0.0.0"
        spec = text_of(specs.get(path.partition("/")[2]))
        if spec.startswith("npm:"):
            spec = spec.partition("@")[2]
        spec = local_spec(spec)
        on = {k: entry.get(k) is True for k in ("dev", "optional", "devOptional")}
        groups = ["dev"] * on["dev"] + ["optional"] * on["optional"] + ["dev", "optional"] * on["devOptional"] + ["prod"] * (not on["dev"] and not on["devOptional"])
        rows.put(f"{name}@{key}", package(name, version, "npm", "NPM", commit=commit, dep_groups=groups, target_versions=[spec] if spec else []))
    return rows


def composer(path: str, text: str) -> list[dict]:
    lock = read(text)
    return [
        package(text_of(p.get("name")), text_of(p.get("version")), "Packagist", "Composer", commit=text_of(table(p.get("dist")).get("reference")), dep_groups=groups)
        for section, groups in (("packages", []), ("packages-dev", ["dev"]))
        for p in map(table, lock.get(section) or [])
    ]


def conan_reference(text: str) -> tuple[str, str]:
    """(name, version) of name/version[@user[/channel]][#revision][:package[#revision]][%time]; no name without '/'."""
    for mark in "%:#@":
        text = text.partition(mark)[0]
    name, slash, version = text.partition("/")
    return (name, version) if slash else ("", text)


def conan(path: str, text: str) -> list[dict]:
    lock = read(text)
    nodes = table(lock.get("graph_lock")).get("nodes")
    if isinstance(nodes, dict):
        refs = [(text_of(n.get("pref")) or text_of(n.get("ref")), []) for n in map(table, nodes.values()) if not n.get("path")]
    else:
        refs = [(r, [group]) for section, group in (("requires", "requires"), ("build_requires", "build-requires"), ("python_requires", "python-requires")) for r in strings(lock.get(section))]
    named = [(conan_reference(r), groups) for r, groups in refs]
    return [package(name, version, "ConanCenter", "Conan", dep_groups=groups) for (name, version), groups in named if name]


def nuget(path: str, text: str) -> list[dict]:
    lock = read(text)
    if lock.get("version") not in (1, 2):
        raise ValueError(f"unsupported lock file version {lock.get('version')}")
    rows = {}
    for framework in table(lock.get("dependencies")).values():
        for name, p in table(framework).items():
            kind = text_of(table(p).get("type"))
            if kind.lower() != "project":
                version = text_of(table(p).get("resolved"))
                rows[f"{name}@{version}"] = package(name, version, "NuGet", "NuGet", is_direct=kind == "Direct")
    return list(rows.values())


def pipenv(path: str, text: str) -> list[dict]:
    lock = read(text)
    rows: dict[str, dict] = {}
    for section, groups in (("default", []), ("develop", ["dev"])):
        for name, p in table(lock.get(section)).items():
            pinned = text_of(table(p).get("version"))
            if pinned:
                version = pinned[2:]
                rows.setdefault(f"{name}@{version}", package(name, version, "PyPI", "Pipfile", dep_groups=groups))
    return list(rows.values())


def renv(path: str, text: str) -> list[dict]:
    entries = map(table, table(read(text).get("Packages")).values())
    return [package(text_of(p.get("Package")), text_of(p.get("Version")), "CRAN", "Renv") for p in entries if p.get("Repository") == "CRAN"]


def earlier_results(path: str, text: str) -> list[dict]:
    """The JSON document of an earlier run; a commit comes before a version."""
    rows = []
    for source in map(table, read(text).get("results") or []):
        for p in (table(table(x).get("package")) for x in source.get("packages") or []):
            commit, name = text_of(p.get("commit")), text_of(p.get("name"))
            rows.append(package(name, "", "", "Unknown", commit=commit) if commit else package(name, text_of(p.get("version")), text_of(p.get("ecosystem")), "Unknown"))
    return rows
