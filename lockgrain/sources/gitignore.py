"""Ignore rules of a source tree, by the public gitignore grammar.

A rule is (dir, pattern): the folder of its file relative to the repository's root and the line. Later rules win. A path
is ignored if a rule says so for it or for a folder above it; then nothing below that folder can come back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

Rule = tuple[str, str]


def read_rules(lines: Iterable[str], folder: str) -> list[Rule]:
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        if not line.startswith("#") and line.strip():
            out.append((folder, line))
    return out


@lru_cache(maxsize=4096)
def compile_rule(folder: str, line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on paths relative to the root, negated, folders only)."""
    line = re.sub(r"(?<!\\) +$", "", line)
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if line.startswith(("\\!", "\\#")):
        line = line[1:]
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out += "[^/]*"
            i += 1
            while line.startswith("*", i):
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    prefix = re.escape(folder + "/") if folder else ""
    return re.compile(prefix + ("" if anchored else "(?:[^/]+/)*") + out + r"\Z"), negated, only_folders


def matches(rules: Iterable[Rule], path: str, is_folder: bool) -> bool:
    """The last rule that fits a path decides."""
    verdict = False
    for folder, line in rules:
        rule = compile_rule(folder, line)
        if rule and (is_folder or not rule[2]) and rule[0].match(path):
            verdict = not rule[1]
    return verdict


def is_ignored(rules: list[Rule], path: str) -> bool:
    """Whether a file or any folder above it is ignored."""
    parts = path.split("/")
    return any(matches(rules, "/".join(parts[:i]), i < len(parts)) for i in range(1, len(parts) + 1))


def repository_root(folder: str) -> str | None:
    at = os.path.abspath(folder)
    while True:
        if os.path.isdir(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def collect_rules(folder: str) -> tuple[str, list[Rule]] | None:
    """(root, rules) for a local folder: the repository's exclude file, folders above, then folders below; None outside one."""
    root = repository_root(folder)
    if root is None:
        return None
    rules: list[Rule] = []

    def add(file: str, at: str) -> None:
        if os.path.isfile(file):
            with open(file, encoding="utf-8", errors="replace") as f:
                rules.extend(read_rules(f, at))

    add(os.path.join(root, ".git", "info", "exclude"), "")
    inner = os.path.relpath(os.path.abspath(folder), root).replace(os.sep, "/")
    parts = [] if inner == "." else inner.split("/")
    for i in range(len(parts)):
        add(os.path.join(root, *parts[:i], ".gitignore"), "/".join(parts[:i]))
    for at, folders, files in os.walk(os.path.abspath(folder)):
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        if ".gitignore" in files:
            add(os.path.join(at, ".gitignore"), rel)
        folders[:] = sorted(f for f in folders if f != ".git" and not matches(rules, f"{rel}/{f}" if rel else f, True))
    return root, rules
