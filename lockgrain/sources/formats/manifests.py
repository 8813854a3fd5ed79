"""What manifests say about the packages of a lockfile: each matcher takes (path, text, packages) and updates the rows.

A matcher marks packages direct, adds or replaces groups and sets locations, counted in characters from 1. It never adds
or drops packages.
"""

from __future__ import annotations

import json
import re
import xml.parsers.expat

from lockgrain.functions.positions import find_in_lines, find_term
from lockgrain.sources.formats.common import place
from lockgrain.sources.formats.line_formats import lines_of


def _spot(file: str, found) -> dict | None:
    return place(file, *found) if found else None


def _line_column(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1


def _between(file: str, text: str, begin: int, end: int) -> dict:
    (l1, c1), (l2, c2) = _line_column(text, begin), _line_column(text, end)
    return place(file, l1, l2, c1, c2)


def add_groups(row: dict, groups: list[str]) -> None:
    row["dep_groups"] = list(dict.fromkeys([*row["dep_groups"], *groups]))


# --- package.json and composer.json ---------------------------------------------------------------------------------


def json_sections(text: str, names: tuple[str, ...]) -> dict[str, tuple[int, int]]:
    """Begin and end of the top-level objects of the given names, in characters."""
    spans: dict[str, tuple[int, int]] = {}
    depth, key, i, last = 0, None, 0, None
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')
    stack: list[tuple[str | None, int]] = []
    for m in token.finditer(text):
        t = m.group()
        if t[0] == '"':
            if depth == 1 and text[m.end() :].lstrip()[:1] == ":":
                last = json.loads(t)
        elif t in "{[":
            stack.append((last if depth == 1 and t == "{" else None, m.start()))
            depth += 1
        else:
            depth -= 1
            if stack:
                key, i = stack.pop()
                if key in names:
                    spans[key] = (i, m.end())
    return spans


_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"')


def _pairs_of(text: str, begin: int, end: int) -> dict[str, list[re.Match]]:
    """The string-valued entries of a section by name, in order; read once, whatever the number of packages."""
    found: dict[str, list[re.Match]] = {}
    for m in _PAIR.finditer(text, begin, end):
        found.setdefault(m.group(1), []).append(m)
    return found


def _set_pair(row: dict, file: str, text: str, m: re.Match) -> None:
    row["block"] = _between(file, text, m.start(), m.end())
    row["name_loc"] = _between(file, text, m.start(1), m.end(1))
    row["version_loc"] = _between(file, text, m.start(2), m.end(2))


def propagate(rows: list[dict]) -> None:
    """Groups go down to children, children's children and so on, in an order-free way."""
    by_key = {f"{r['name']}@{r['version']}": r for r in rows}
    todo = [r for r in rows if r["children"]]
    while todo:
        row = todo.pop()
        for key in row["children"]:
            child = by_key.get(key)
            if child is not None and set(row["dep_groups"]) - set(child["dep_groups"]):
                add_groups(child, row["dep_groups"])
                todo.append(child)


def package_json(file: str, text: str, rows: list[dict]) -> None:
    """Name and one of the target versions; production comes before development and optional for the location."""
    sections = (("dependencies", "prod"), ("devDependencies", "dev"), ("optionalDependencies", "optional"))
    json.loads(text)
    spans = json_sections(text, tuple(s for s, _ in sections))
    for section, group in sections:
        if section not in spans:
            continue
        pairs = _pairs_of(text, *spans[section])
        for row in rows:
            own = pairs.get(row["name"], ())
            hit = next((m for t in row["target_versions"] for m in own if t in ("", m.group(2))), None)
            if hit:
                row["is_direct"] = True
                if group == "prod" or row["block"] is None:
                    _set_pair(row, file, text, hit)
                add_groups(row, [group])
    propagate(rows)


def composer_json(file: str, text: str, rows: list[dict]) -> None:
    json.loads(text)
    spans = json_sections(text, ("require", "require-dev"))
    for section in ("require", "require-dev"):
        pairs = _pairs_of(text, *spans[section]) if section in spans else {}
        for row in rows if pairs else ():
            if section == "require-dev" and row["block"] is not None:
                continue
            if hits := pairs.get(row["name"]):
                row["is_direct"] = True
                _set_pair(row, file, text, hits[0])


# --- Pipfile, pyproject.toml, build.gradle --------------------------------------------------------------------------

#: Tables of development dependencies.
DEV_TABLES = ("[tool.poetry.dev-dependencies]", "[tool.poetry.group.dev.dependencies]")


def _columns(line: str) -> tuple[int, int]:
    bare = line.strip()
    return (len(line) - len(line.lstrip()) + 1, len(line.rstrip()) + 1) if bare else (-1, -1)


def toml_lines(file: str, text: str, rows: list[dict]) -> None:
    """A line that contains a package's name, whatever its case; later lines win. Development tables add dev."""
    named = [(r, r["name"].lower()) for r in rows]
    dev = False
    for number, raw in enumerate(lines_of(text), 1):
        line = raw.lower()
        head = line.strip()
        if head.startswith("[") and head.endswith("]"):
            dev = head in DEV_TABLES
        for row, name in named:
            if name in line:
                row["is_direct"] = True
                row["block"] = place(file, number, number, *_columns(line))
                row["name_loc"] = _spot(file, find_in_lines([line], name, number)) or row["name_loc"]
                row["version_loc"] = _spot(file, find_term([line], r'=\s*"(?P<term>.*)"', number)) or row["version_loc"]
                if dev:
                    row["dep_groups"] = [*row["dep_groups"], "dev"]


def build_gradle(file: str, text: str, rows: list[dict]) -> None:
    """A line that contains group and artifact; runtimeOnly adds a scope; the location needs the version as well."""
    for number, line in enumerate(lines_of(text), 1):
        words = line.partition("(")[0].split() if "(" in line else line.split()[:1]
        runtime = " ".join(words).strip() == "runtimeOnly"
        for row in rows:
            group, _, artifact = row["name"].partition(":")
            if group not in line or artifact not in line:
                continue
            if runtime:
                row["dep_groups"] = [*row["dep_groups"], "runtimeClasspath"]
            if row["version"] in line:
                row["block"] = place(file, number, number, *_columns(line))
                name = find_term([line], rf"['\":](?P<term>{re.escape(artifact)})['\":]", number)
                version = find_term([line], rf"['\":](?P<term>{re.escape(row['version'])})['\"]", number)
                row["name_loc"] = _spot(file, name) or row["name_loc"]
                row["version_loc"] = _spot(file, version) or row["version_loc"]


# --- csproj ---------------------------------------------------------------------------------------------------------


def csproj_references(text: str) -> dict[str, tuple[str, int, int, int, int]]:
    """Include to (PrivateAssets, line start, line end, column start, column end)."""
    found: dict[str, tuple] = {}
    parser = xml.parsers.expat.ParserCreate()
    path: list[str] = []
    at: dict = {}
    raw = text.encode("utf-8")
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]

    def spot() -> tuple[int, int]:
        line = parser.CurrentLineNumber
        return line, len(raw[starts[line - 1] : starts[line - 1] + parser.CurrentColumnNumber].decode("utf-8", "replace")) + 1

    def begin(tag, attributes):
        path.append(tag)
        if tag == "PackageReference" and "ItemGroup" in path:
            at.clear()
            at.update(attributes=attributes, fields={}, begin=spot())

    def text_in(data):
        if at and len(path) > 1 and path[-2] == "PackageReference":
            at["fields"][path[-1]] = at["fields"].get(path[-1], "") + data

    def close(tag):
        if tag == "PackageReference" and at:
            index = parser.CurrentByteIndex
            end = raw.find(b">", index) + 1
            line = raw.count(b"\n", 0, end) + 1
            column = len(raw[starts[line - 1] : end].decode("utf-8", "replace")) + 1
            name = at["fields"].get("Include") or at["attributes"].get("Include")
            private = at["attributes"].get("PrivateAssets", "") + " " + at["fields"].get("PrivateAssets", "")
            if name is not None:
                found[name] = (private, at["begin"][0], line, at["begin"][1], column)
            at.clear()
        path.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, close, text_in
    parser.Parse(re.sub(r'(<\?xml[^>]*?)\s+encoding="[^"]*"', r"\1", text).encode("utf-8"), True) if "encoding=" in text[:200] else parser.Parse(raw, True)
    return found


def csproj(file: str, text: str, rows: list[dict]) -> None:
    found = csproj_references(text)
    lines = lines_of(text)
    for row in rows:
        if row["name"] not in found:
            continue
        private, first, last, c1, c2 = found[row["name"]]
        row["dep_groups"] = ["dev"] if "all" in private else ["prod"]
        block = lines[first - 1 : last]
        row["block"] = place(file, first, last, c1, c2)
        row["name_loc"] = _spot(file, find_in_lines(block, row["name"], first)) or row["name_loc"]
        version = find_term(block, r'Version="(?P<term>.*?)"', first) or find_term(block, r"<Version>(?P<term>.*?)</", first)
        row["version_loc"] = _spot(file, version) or row["version_loc"]


# --- Gemfile and gemspec --------------------------------------------------------------------------------------------

_RUBY = re.compile(r"""#[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|:"[^"]*"|:[A-Za-z_]\w*[?!]?|[A-Za-z_]\w*[?!]?:(?!:)|[A-Za-z_]\w*[?!]?|=>|\n|[^\s]""")
_OPENERS = {"do", "if", "unless", "case", "def", "class", "module", "begin", "while", "until"}


def ruby_tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _RUBY.finditer(text) if not m.group().startswith("#")]


def _is_string(token: str) -> bool:
    return token[0] in "\"'" and len(token) > 1


def _value(token: str) -> str:
    return token.strip("\"'").lstrip(":").rstrip(":").strip("\"'")


def _arguments(tokens, i: int) -> tuple[list[tuple[str, int, int]], int]:
    """Tokens of a call's arguments from i on, and the index behind them; a comma at a line's end goes on."""
    out, depth = [], 0
    paren = i < len(tokens) and tokens[i][0] == "("
    i += paren
    while i < len(tokens):
        t = tokens[i][0]
        if t == "\n":
            if depth == 0 and not paren and (not out or out[-1][0] != ","):
                break
        elif paren and depth == 0 and t == ")":
            i += 1
            break
        elif not paren and depth == 0 and t in ("do", "if", "unless", "end", "}", ";"):
            break
        else:
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
            out.append(tokens[i])
        i += 1
    return out, i


def _pairs(arguments) -> list[str]:
    """Values of group: and groups: pairs, in either hash syntax."""
    groups = []
    i = 0
    while i < len(arguments):
        t = arguments[i][0]
        is_key = t in ("group:", "groups:") or (t in (":group", ":groups") and i + 1 < len(arguments) and arguments[i + 1][0] == "=>")
        if is_key:
            i += 1 if t.endswith(":") else 2
            depth = 0
            while i < len(arguments):
                v = arguments[i][0]
                depth += (v == "[") - (v == "]")
                if v.startswith(":") or _is_string(v):
                    groups.append(_value(v))
                if depth == 0:
                    break
                i += 1
        i += 1
    return groups


def ruby_gems(text: str) -> list[dict]:
    """gem calls with name, version, own groups, and the groups of the blocks around them."""
    tokens = ruby_tokens(text)
    found: list[dict] = []
    blocks: list[list[str] | None] = []
    i = 0
    while i < len(tokens):
        t, begin, end = tokens[i]
        line_start = i == 0 or tokens[i - 1][0] in ("\n", ";", "do", "{", "|")
        if t == "gem" and line_start:
            args, after = _arguments(tokens, i + 1)
            if args and _is_string(args[0][0]):
                requirement = args[2] if len(args) > 2 and args[1][0] == "," and _is_string(args[2][0]) else None
                last = tokens[after - 1] if after > i + 1 and tokens[after - 1][0] == ")" else args[-1]
                outer = [g for b in blocks if b for g in b]
                found.append({"name": args[0], "version": requirement, "begin": begin, "end": last[2], "groups": _pairs(args), "outer": outer})
                i = after
                continue
        elif t == "group" and line_start:
            args, after = _arguments(tokens, i + 1)
            if after < len(tokens) and tokens[after][0] in ("do", "{"):
                plain = []
                for k, a in enumerate(args):
                    if a[0].endswith(":") or (k + 1 < len(args) and args[k + 1][0] == "=>"):
                        break
                    if a[0].startswith(":") or _is_string(a[0]):
                        plain.append(_value(a[0]))
                blocks.append(plain)
                i = after + 1
                continue
        elif t in _OPENERS and (t in ("do", "begin", "case", "def", "class", "module") or line_start):
            blocks.append(None)
        elif t == "end" and blocks:
            blocks.pop()
        elif t == "}" and blocks and blocks[-1] is not None:
            blocks.pop()
        i += 1
    return found


def _set_gem(row: dict, file: str, text: str, gem: dict, version_shift: int = 0) -> None:
    row["block"] = _between(file, text, gem["begin"], gem["end"])
    row["name_loc"] = _between(file, text, gem["name"][1], gem["name"][2])
    if gem["version"]:
        row["version_loc"] = _between(file, text, gem["version"][1] + version_shift, gem["version"][2])


def gemfile(file: str, text: str, rows: list[dict]) -> None:
    by_name = {r["name"]: r for r in rows}
    gems = ruby_gems(text)
    for grouped in (False, True):
        for gem in gems:
            row = by_name.get(_value(gem["name"][0]))
            if row is None or grouped and not gem["outer"]:
                continue
            _set_gem(row, file, text, gem)
            if groups := gem["outer"] if grouped else gem["groups"]:
                row["dep_groups"] = groups


#: Calls that declare a dependency in a gemspec.
GEMSPEC_CALLS = ("add_dependency", "add_runtime_dependency", "add_development_dependency")


def gemspec(file: str, text: str, rows: list[dict]) -> None:
    by_name = {r["name"]: r for r in rows}
    tokens = ruby_tokens(text)
    for i, (t, _, _) in enumerate(tokens):
        if t not in GEMSPEC_CALLS or i < 2 or tokens[i - 1][0] != ".":
            continue
        args, after = _arguments(tokens, i + 1)
        if not args or not _is_string(args[0][0]):
            continue
        row = by_name.get(_value(args[0][0]))
        if row is None:
            continue
        last = tokens[after - 1] if tokens[after - 1][0] == ")" else args[-1]
        wants = [a for a in args[1:] if _is_string(a[0])]
        version = (wants[0][0], wants[0][1], wants[-1][2]) if wants else None
        _set_gem(row, file, text, {"begin": tokens[i - 2][1], "end": last[2], "name": args[0], "version": version})
        if t == "add_development_dependency":
            row["dep_groups"] = ["dev"]
