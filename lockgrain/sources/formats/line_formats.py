"""Lockfiles read line by line: yarn, Gemfile.lock, go.mod, requirements, gradle, mix, apk, dpkg, CSV."""

from __future__ import annotations

import csv
import io
import posixpath
import re

from lockgrain.functions.positions import find_in_lines
from lockgrain.sources.commits import find_commit, is_word
from lockgrain.sources.formats.common import package, place

LINES = re.compile(r"\r\n|\r|\n")


def lines_of(text: str) -> list[str]:
    return LINES.split(text)


def _at(file: str, found: tuple[int, int, int, int] | None) -> dict | None:
    return place(file, *found) if found else None


# --- yarn -----------------------------------------------------------------------------------------------------------

def yarn_entry(line: str) -> tuple[str, str]:
    """(key, value as written) of a stanza's line, in either syntax: key "value", "key" value, key: value."""
    bare = line.strip()
    if bare.startswith('"'):
        key, _, rest = bare[1:].partition('"')
    else:
        end = next((i for i, c in enumerate(bare) if c in ' :"'), len(bare))
        key, rest = bare[:end], bare[end:]
    return key, rest.lstrip().removeprefix(":").lstrip()


def _yarn_field(stanza: list[str], *keys: str) -> str:
    """The value of the first own field (two blanks deep) with one of the keys, as written; '' if there is none."""
    own = (yarn_entry(x) for x in stanza[1:] if x.startswith("  ") and not x[2:3].isspace())
    return next((value for key, value in own if key in keys), "")


def _yarn_version(stanza: list[str]) -> str:
    value = _yarn_field(stanza, "version").strip('"')
    return value if is_word(re.sub("[.+-]", "a", value)) else ""


def _yarn_source(stanza: list[str]) -> str:
    """What a package was resolved to; only a quoted text without blanks or quotes counts."""
    value = _yarn_field(stanza, "resolution", "resolved")
    inner = value[1:-1] if len(value) > 2 and value[0] == value[-1] == '"' else ""
    return "" if set(inner) & set(" '\"") else inner


def yarn_header(header: str) -> tuple[str, list[str]]:
    """(name, target versions) of 'name@spec, name@spec:'; an alias gives the real name."""
    name, targets = "", []
    for part in header.replace('"', "").removesuffix(":").split(","):
        part = part.removeprefix(" ")
        scope = "@" if part.startswith("@") else ""
        found, _, spec = part.removeprefix("@").partition("@")
        name = name or scope + found
        if spec.startswith("npm:"):
            spec = spec[4:]
            if "@" in spec:
                name, inner = yarn_header(spec)
                targets += inner
                continue
        for prefix in ("file:", "link:", "portal:"):
            spec = spec.removeprefix(prefix)
        targets.append(spec.partition("::locator")[0])
    return name, targets


def _yarn_children(stanza: list[str]) -> list[tuple[str, str, str]]:
    """(name, registry, spec) of the dependencies section."""
    indent, found = None, []
    for line in stanza:
        bare = line.strip()
        depth = len(line) - len(bare)
        if bare.startswith("dependencies"):
            indent = depth
        elif indent is not None and depth == indent:
            break
        elif indent is not None:
            name, wanted = yarn_entry(bare)
            wanted = wanted.strip('"')
            registry, colon, spec = wanted.partition(":")
            if name and wanted:
                found.append((name, registry, spec) if colon else (name, "npm", wanted))
    return found


def yarn(path: str, text: str) -> list[dict]:
    stanzas: list[list[str]] = []
    for line in lines_of(text):
        if line == "" or line.startswith("#"):
            continue
        if not line.startswith(" ") or not stanzas:
            stanzas.append([])
        stanzas[-1].append(line)
    rows, wants = [], []
    for s in stanzas:
        name, targets = yarn_header(s[0])
        if name == "__metadata":
            continue
        rows.append(package(name, _yarn_version(s), "npm", "Yarn", target_versions=targets, commit=find_commit(_yarn_source(s))))
        wants.append(_yarn_children(s))
    by_spec = {f"{r['name']}@{t}": r for r in rows for t in r["target_versions"]}
    for row, children in zip(rows, wants):
        hits = (by_spec.get(f"{n}@{spec}") or by_spec.get(f"{n}@{registry}:{spec}") for n, registry, spec in children)
        row["children"] = [f"{h['name']}@{h['version']}" for h in hits if h]
    return rows


# --- Bundler --------------------------------------------------------------------------------------------------------

#: Section heads of a Gemfile.lock; the first list holds packages.
GEM_SOURCES = ("GIT", "GEM", "PATH", "PLUGIN SOURCE")


def gem_line(line: str) -> tuple[int, str, str]:
    """(indent, name, version without its platform) of an entry such as '    name (1.0-platform)!'."""
    entry = line.lstrip(" ")
    name, bracket, inner = entry.removesuffix("!").partition(" (")
    if not bracket or not inner.endswith(")"):
        return len(line) - len(entry), entry.removesuffix("!"), ""
    return len(line) - len(entry), name, inner[:-1].partition("-")[0]


def gem_option(line: str) -> tuple[str, str] | None:
    """(key, value) of a source's option, '  key: value'; None for other lines."""
    key, colon, value = line[2:].partition(": ")
    return (key, value) if colon and line.startswith("  ") and key.isascii() and key.isalpha() else None


def gemfile_lock(path: str, text: str) -> list[dict]:
    rows: list[dict] = []
    section, commit = "", ""
    for line in lines_of(text):
        if "DEPENDENCIES" in line:
            section, commit = "direct", ""
        elif any(s in line for s in GEM_SOURCES):
            section, commit = "source", ""
        elif line[:1].strip():
            section = ""
        elif section:
            if option := gem_option(line):
                if option[0] == "revision":
                    commit = option[1]
                continue
            depth, name, version = gem_line(line)
            if depth != 4 and not (depth == 2 and section == "direct"):
                continue
            known = next((r for r in rows if r["name"] == name), None) if section == "direct" else None
            if known:
                known["is_direct"] = True
            else:
                rows.append(package(name, version, "RubyGems", "Bundler", commit=commit, is_direct=section == "direct"))
    return rows


# --- Go -------------------------------------------------------------------------------------------------------------

_CANONICAL = re.compile(r"v(\d+)(?:\.(\d+))?(?:\.(\d+))?(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?\Z", re.ASCII)


def go_version(module: str, version: str) -> str:
    """The version in full form without 'v'; one that isn't a version gives the major version in the path, or ''."""
    if m := _CANONICAL.match(version):
        short = m.group(2) is None or m.group(3) is None
        if not short or not m.group(4):
            build = m.group(5) if m.group(5) == "+incompatible" else ""
            return f"{m.group(1)}.{m.group(2) or 0}.{m.group(3) or 0}{m.group(4) or ''}{build or ''}"
    major = re.search(r"(?:/v|\.v)(\d+)(?:-unstable)?\Z", module)
    return major.group(1) if major else ""


def _is_module(target: str) -> bool:
    """Whether a replacement is a module, whose path begins with a host, and no folder."""
    host = target.partition("://")[2] or target
    return host[:1] not in (".", "/") and "." in host.partition("/")[0]


def _go_statements(lines: list[str]):
    """(verb, words, comment, line number) of each directive, blocks opened."""
    block = ""
    for number, raw in enumerate(lines, 1):
        code, _, comment = raw.partition("//")
        words = [w.strip('"`') for w in code.split()]
        if not words:
            continue
        if block:
            if words == [")"]:
                block = ""
            else:
                yield block, words, comment.strip(), number, raw
        elif words[-1] == "(":
            block = words[0]
        else:
            yield words[0], words[1:], comment.strip(), number, raw


def go_mod(path: str, text: str) -> list[dict]:
    lines = lines_of(text)
    rows: dict[str, dict] = {}
    replaces, release = [], ""

    def spots(raw: str, number: int, words: list[str], name: str, version: str) -> dict:
        begin = raw.find(words[0])
        end = raw.find(words[-1], begin) + len(words[-1])
        block = place(path, number, number, begin + 1, end + 1)
        return {"block": block, "name_loc": _at(path, find_in_lines([raw], name, number)), "version_loc": _at(path, find_in_lines([raw], version, number))}

    for verb, words, comment, number, raw in _go_statements(lines):
        if verb == "require" and len(words) >= 2:
            name, version = words[0], go_version(words[0], words[1])
            indirect = comment == "indirect" or comment.startswith("indirect;")
            rows[f"{name}@{version}"] = package(name, version, "Go", "Golang", is_direct=not indirect, **spots(raw, number, raw.partition("//")[0].split()[-2:], name, version))
        elif verb == "replace" and "=>" in words:
            at = words.index("=>")
            replaces.append((words[:at], words[at + 1 :], number, raw))
        elif verb == "go" and words:
            release = words[0]
    for old, new, number, raw in replaces:
        if not old or not new:
            continue
        hit = [k for k, r in rows.items() if r["name"] == old[0]] if len(old) == 1 else [k for k in [f"{old[0]}@{go_version(old[0], old[1])}"] if k in rows]
        version = go_version(new[0], new[1]) if len(new) > 1 else ""
        where = spots(raw, number, raw.partition("//")[0].split(), new[0], version)
        if _is_module(new[0]):
            name = new[0]
        else:  # a folder: the module keeps its name and has no version
            name, version = old[0], ""
            where |= {"name_loc": None, "version_loc": None}
        for k in hit:
            rows[k] = package(name, version, "Go", "Golang", is_direct=rows[k]["is_direct"], **where)
    if release:
        rows["stdlib"] = package("stdlib", release, "Go", "Golang", is_direct=True, block=place(path, 0, 0, 0, 0))
    return list({f"{r['name']}@{r['version']}": r for r in rows.values()}.values())


# --- requirements ---------------------------------------------------------------------------------------------------

#: Constraints in the order they are looked for; the last found counts.
CONSTRAINTS = ("==", ">=", "~=", "!=")
_COMMENT = re.compile(r"\s*#.*$", re.M)


def _goes_on(line: str) -> bool:
    """Whether a line ends with a backslash that isn't one of a pair."""
    return (len(line) - len(line.rstrip("\\"))) % 2 == 1


def requirement_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower().partition("[")[0]


def _requirement(path: str, text: str, first: int, last: int, columns: tuple[int, int]) -> dict:
    text = text.split(";")[0]
    sign = next((c for c in reversed(CONSTRAINTS) if c in text), "")
    name, version = text, ""
    if sign:
        name, _, rest = text.partition(sign)
        name = name.strip()
        version = "" if sign == "!=" else rest.strip().partition(" ")[0]
    elif "@" in text:
        name, _, where = text.partition("@")
        name, parts = name.strip(), where.strip().split("/")[-1].split("-")
        version = parts[1] if where.strip().endswith(".whl") and len(parts) > 1 else ""
    block = text.split("\n")
    return package(
        requirement_name(name), version, "PyPI", "Requirements", is_direct=True, block=place(path, first, last, *columns),
        name_loc=_at(path, find_in_lines(block, name, first)), version_loc=_at(path, find_in_lines(block, version, first)),
    )


class _Via:
    """Reads the '# via' comments that pip-compile writes under a package."""

    def __init__(self):
        self.kinds: list[str] = []
        self.open = False

    def read(self, comment: str) -> str:
        """direct, indirect or none."""
        body = comment.strip().removeprefix("#").strip()
        if not body:
            return "direct"
        if self.kinds:
            self.kinds.append(self.kind(body))
            return self.kinds[-1]
        if not body.lower().startswith("via"):
            return "direct"
        body = body.lower().removeprefix("via").strip()
        if not body:
            self.kinds, self.open = ["none"], True
            return "none"
        return self.kind(body)

    @staticmethod
    def kind(body: str) -> str:
        return "indirect" if re.fullmatch(r"[a-zA-Z0-9_-]+", body) else "direct"


def requirements(path: str, text: str) -> tuple[list[dict], list[str]]:
    """(packages of this file, paths of local files it includes)."""
    group = posixpath.splitext(posixpath.basename(path))[0]
    rows: dict[str, dict] = {}
    includes: list[str] = []
    head, generated, last, via = False, False, None, _Via()
    source = lines_of(text)
    if source and source[-1] == "":
        source.pop()
    at = 0
    while at < len(source):
        first, line, final = at + 1, source[at], source[at]
        while _goes_on(line) and at + 1 < len(source):
            at += 1
            final = source[at]
            line = line[:-1] + "\n" + final
        if _goes_on(line):
            line = line[:-1]
        at += 1
        comment = line.lstrip().startswith("#")
        head = comment and (head or first == 1)
        generated |= head and "autogenerated" in line
        if generated and comment:
            kind = via.read(line)
            if not via.open and kind == "indirect" and last is not None:
                last["is_direct"] = False
        else:
            if via.open and last is not None:
                last["is_direct"] = "direct" in via.kinds
            via = _Via()
        line = _COMMENT.sub("", line).strip()
        if line.startswith("-r "):
            target = line[3:].strip()
            if not target.startswith(("http://", "https://")):
                includes.append(posixpath.normpath(posixpath.join(posixpath.dirname(path), target)))
            continue
        if line == "" or line.startswith(("-", "https://", "http://", ".", "/")):
            continue
        opening = source[first - 1]
        columns = (len(opening) - len(opening.lstrip()) + 1, len(final.rstrip()) + 1)
        row = _requirement(path, line, first, at, columns)
        row = rows.setdefault(f"{row['name']}@{row['version']}", row)
        if group not in row["dep_groups"]:
            row["dep_groups"].append(group)
        last = row
    if via.open and last is not None:
        last["is_direct"] = "direct" in via.kinds
    return list(rows.values()), includes


# --- others ---------------------------------------------------------------------------------------------------------


def gradle(path: str, text: str) -> list[dict]:
    rows = []
    for line in map(str.strip, lines_of(text)):
        parts = line.split(":", 2)
        if len(parts) == 3 and not line.startswith(("#", "empty=")):
            version, equals, scopes = parts[2].partition("=")
            rows.append(package(f"{parts[0]}:{parts[1]}", version, "Maven", "Gradle", dep_groups=scopes.split(",") if equals else []))
    return rows


def mix(path: str, text: str) -> list[dict]:
    rows = []
    for line in lines_of(text):
        entry = line.lstrip(" ")
        name, _, rest = entry[1:].partition('"')
        fields = [f for f in rest.split(",") if f]
        if entry != line and entry.startswith('"') and is_word(name) and rest.startswith(": {") and rest.endswith(",") and len(fields) >= 4:
            a, b = (f.strip().removeprefix('"').removesuffix('"') for f in fields[2:4])
            version, commit = ("", a) if fields[0].endswith(":git") else (a, b)
            rows.append(package(name, version, "Hex", "Hex", commit=commit))
    return rows


def _records(text: str) -> list[list[str]]:
    return [r.split("\n") for r in re.split(r"\n{2,}", "\n".join(lines_of(text)).strip("\n")) if r]


def apk(path: str, text: str, release: str | None = None) -> list[dict]:
    """``release``: the text of /etc/alpine-release, whose major and minor number qualify the ecosystem."""
    parts = (release or "").split(".")
    ecosystem = f"Alpine:v{parts[0]}.{parts[1]}" if len(parts) > 1 else "Alpine"
    rows = []
    for record in _records(text):
        field = {line[:1]: line[2:] for line in record if line[1:2] == ":"}
        if field.get("P"):
            rows.append(package(field["P"], field.get("V", ""), ecosystem, "Unknown", commit=field.get("c", "")))
    return rows


def dpkg(path: str, text: str) -> list[dict]:
    rows = []
    for record in _records(text):
        field = {}
        for line in record:
            key, colon, value = line.partition(":")
            if colon and not line[:1].isspace():
                field.setdefault(key, value.strip())
        status = field.get("Status")
        if status is not None and (len(status.split()) != 3 or status.split()[2] in ("not-installed", "config-files")):
            continue
        name, version = field.get("Package", ""), field.get("Version", "")
        if "Source" in field:
            m = re.match(r"(.*)\((.*)\)", field["Source"])
            name = m.group(1).strip() if m else field["Source"]
            version = m.group(2).strip() if m and m.group(2).strip() else version
        if name:
            rows.append(package(name, version, "Debian", "Unknown"))
    release = next((r["version"] for r in rows if r["name"] == "base-files"), "").partition("+")[0].partition(".")[0]
    return [r | {"ecosystem": f"Debian:{release}"} for r in rows] if release else rows


def csv_rows(path: str, text: str) -> list[dict]:
    """ecosystem, anything, name, version; without an ecosystem the fourth field is a commit. Bad rows fail the file."""
    rows = []
    for i, record in enumerate(csv.reader(io.StringIO(text), strict=True), 1):
        if not record:
            continue
        if len(record) < 4:
            raise ValueError(f"row {i}: not enough fields, want 4")
        ecosystem, _, name, last = (f for f in record[:4])
        if not ecosystem:
            if not last:
                raise ValueError(f"row {i}: field 4 must be a commit")
        if not name:
            raise ValueError(f"row {i}: field 3 must be a name")
        if not ecosystem:
            rows.append(package(name, "", "", "Unknown", commit=last))
        else:
            rows.append(package(name, last, ecosystem, "Unknown"))
    return sorted(rows, key=lambda r: (r["name"], r["version"]))
