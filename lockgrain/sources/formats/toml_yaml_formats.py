"""Lockfiles in TOML and YAML: Cargo, pdm, poetry, pnpm, pub; and gradle verification metadata in XML."""

from __future__ import annotations

import re
import tomllib
from collections import deque
from xml.etree import ElementTree

from lockgrain.sources.commits import ARCHIVES, archive_commit
from lockgrain.sources.formats.common import package, strings, table, text_of
from lockgrain.sources.formats.json_formats import local_spec


def _toml(text: str) -> list[dict]:
    found = tomllib.loads(text.replace("\r\n", "\n")).get("package", [])
    return [table(p) for p in found] if isinstance(found, list) else []


def cargo(path: str, text: str) -> list[dict]:
    return [package(text_of(p.get("name")), text_of(p.get("version")), "crates.io", "Crates") for p in _toml(text)]


def pdm(path: str, text: str) -> list[dict]:
    rows = []
    for p in _toml(text):
        groups = strings(p.get("groups"))
        marks = ["dev"] * groups.count("dev") + ([] if {"dev", "default"} & set(groups) else ["optional"])
        rows.append(package(text_of(p.get("name")), text_of(p.get("version")), "PyPI", "Pdm", commit=text_of(p.get("revision")), dep_groups=marks))
    return rows


def poetry(path: str, text: str) -> list[dict]:
    return [
        package(text_of(p.get("name")), text_of(p.get("version")), "PyPI", "Poetry", commit=text_of(table(p.get("source")).get("resolved_reference")), dep_groups=["optional"] if p.get("optional") is True else [])
        for p in _toml(text)
    ]


def _yaml(text: str) -> dict:
    """Plain scalars stay text, so that versions like 1.10 keep their digits."""
    import yaml

    value = yaml.load(text, Loader=getattr(yaml, "CBaseLoader", yaml.BaseLoader))
    if value in (None, ""):
        return {}
    if not isinstance(value, dict):
        raise ValueError("no mapping")
    return value


def pub(path: str, text: str) -> list[dict]:
    return [
        package(name, text_of(table(p).get("version")), "Pub", "Pub", commit=text_of(table(table(p).get("description")).get("resolved-ref")), dep_groups=["dev"] if "dev" in text_of(table(p).get("dependency")).split(" ") else [])
        for name, p in table(_yaml(text).get("packages")).items()
    ]


def _lock_version(lock: dict) -> float:
    m = re.fullmatch(r"\d+(?:\.\d+)?", text_of(lock.get("lockfileVersion")).replace("-flavoured", ""))
    return float(m.group()) if m else 0.0


def pnpm(path: str, text: str) -> list[dict]:
    lock = _yaml(text)
    return _pnpm_by_snapshot(lock) if _lock_version(lock) >= 7 else _pnpm_by_path(lock)


def _pnpm_by_snapshot(lock: dict) -> list[dict]:
    """Version 9: importers are the roots; what hangs below a root in the snapshots takes on the root's groups."""
    packages, snapshots = table(lock.get("packages")), table(lock.get("snapshots"))

    def clean(name: str, version: str) -> str:
        return text_of(table(packages.get(f"{name}@{version}")).get("version")) if version.startswith(ARCHIVES) else version.split("(")[0]

    def commit(version: str) -> str:
        return archive_commit(version) if version.startswith(ARCHIVES) else ""

    rows: dict[str, dict] = {}

    def put(name: str, raw: str, groups: list[str], specs: list[str], direct: bool) -> None:
        version = clean(name, raw)
        row = rows.get(f"{name}@{version}")
        if row is None:
            rows[f"{name}@{version}"] = package(name, version, "npm", "Pnpm", commit=commit(raw), dep_groups=list(groups), target_versions=list(specs), is_direct=direct)
            return
        specs = list(dict.fromkeys([*row["target_versions"], *specs]))
        if specs:  # groups are merged only where one of the two is declared
            row["dep_groups"] = sorted({*row["dep_groups"], *groups})
            row["target_versions"] = specs
        row["is_direct"] |= direct

    for importer in map(table, table(lock.get("importers")).values()):
        for section, group in (("dependencies", "prod"), ("optionalDependencies", "optional"), ("devDependencies", "dev")):
            for name, entry in table(importer.get(section)).items():
                raw = text_of(table(entry).get("version"))
                put(name, raw, [group], [text_of(table(entry).get("specifier"))], True)
                seen, queue = set(), deque([f"{name}@{raw}"])
                while queue:
                    at = queue.popleft()
                    if at in seen:
                        continue
                    seen.add(at)
                    below = table(snapshots.get(at))
                    for kind in ("dependencies", "optionalDependencies"):
                        for child, spec in table(below.get(kind)).items():
                            put(child, text_of(spec), [group], [], False)
                            queue.append(f"{child}@{text_of(spec)}")
    return list(rows.values())


def pnpm_path(path: str) -> tuple[str, str]:
    """(name, version) in a dependency path such as /@scope/name/1.0.0_peer or /name@1.0.0; blanks if there is none."""
    if path.startswith("file:"):
        return "", ""
    parts = path.split("/")[1:]
    if not parts:
        return "", ""
    cut = 2 if parts[0].startswith("@") else 1
    name, version = "/".join(parts[:cut]), parts[cut] if len(parts) > cut else ""
    if not version:
        name, _, version = name.rpartition("@")
        if not name or set(version) - set("0123456789."):
            return "", ""
    return (name, version.split("_")[0]) if version[:1].isdigit() else ("", "")


def _pnpm_by_path(lock: dict) -> list[dict]:
    """Versions below 7: a map by dependency path."""
    specifiers = table(lock.get("specifiers"))
    entries = {}
    for section in ("optionalDependencies", "devDependencies", "dependencies"):
        for name, e in table(lock.get(section)).items():
            entries[name] = (text_of(e.get("specifier")), text_of(e.get("version"))) if isinstance(e, dict) else ("", text_of(e))
    mark = "@" if _lock_version(lock) >= 6 else "/"
    rows = []
    for path, p in table(lock.get("packages")).items():
        p = table(p)
        name, version = pnpm_path(path)
        name, version = text_of(p.get("name")) or name, text_of(p.get("version")) or version
        if not name or not version:
            continue
        source = table(p.get("resolution"))
        declared = entries.get(name)
        spec = text_of(specifiers[name]) if name in specifiers else declared[0] if declared else ""
        pinned = local_spec(declared[1] if declared else "")
        rows.append(
            package(
                name, version, "npm", "Pnpm", commit=archive_commit(text_of(source.get("tarball"))) or text_of(source.get("commit")), dep_groups=["dev"] if text_of(p.get("dev")).lower() == "true" else [],
                target_versions=[local_spec(spec)] if path[path.rfind(mark) + 1 :] in pinned else [], is_direct=declared is not None,
            )
        )
    return rows


def gradle_verification(path: str, text: str) -> list[dict]:
    top = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    found = [e for c in top.iter() if c.tag.rpartition("}")[2] == "components" for e in c if e.tag.rpartition("}")[2] == "component"]
    return [package(f"{e.get('group', '')}:{e.get('name', '')}", e.get("version", ""), "Maven", "Gradle") for e in found]


