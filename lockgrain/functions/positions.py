"""Positions in text: lines, columns and offsets, counted in characters from 1.

Column expressions for tables of text; the functions with Python in their name serve the parsers.
"""

from __future__ import annotations

import bisect
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = r"\r\n|\r|\n"


def split_lines(text: Column) -> Column:
    return F.split(text, NEWLINE, -1)


def first_column(line: Column) -> Column:
    """Column of the first character that isn't white space; -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_instr(line, F.lit(r"\S")), F.lit(0)), F.lit(-1))


def last_column(line: Column) -> Column:
    """Column behind the last character that isn't white space; -1 if there is none."""
    kept = F.length(F.regexp_replace(line, r"\s+$", ""))
    return F.when(kept > 0, kept + 1).otherwise(F.lit(-1))


def string_in_block(lines: Column, text: str | Column, first_line: int | Column = 1, prefix: str = "", suffix: str = "") -> Column:
    """struct(line_no, column_start, column_end) of the first line with prefix + text + suffix; null if there is none.

    The columns are those of the text's first place in that line.
    """
    text = F.lit(text) if isinstance(text, str) else text
    whole = F.concat(F.lit(prefix), text, F.lit(suffix))
    hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.contains(s["x"], whole))
    hit = F.get(hits, F.lit(0))
    at = F.call_function("instr", hit["x"], text)
    return F.when(hit.isNotNull() & (text != ""), F.struct((hit["i"] + first_line).cast("int").alias("line_no"), at.cast("int").alias("column_start"), (at + F.length(text)).cast("int").alias("column_end")))


def line_of(text: Column, pattern: str) -> Column:
    """Line number of a pattern's first match; -1 if there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(F.lit(-1))


def json_section_line(text: Column, section: str) -> Column:
    """Line of '"section": {'; -1 if there is none."""
    return line_of(text, r'"\Q' + section + r'\E"\s*:\s*\{')


def json_pair(text: Column, name: str, value: str | None = None) -> Column:
    """The first '"name": "value"' of a JSON text, any value if none is given; '' if there is none."""
    wanted = r"\Q" + value + r"\E" if value else r"[^\"]*"
    return F.regexp_extract(text, r'"\Q' + name + r'\E"\s*:\s*"' + wanted + '"', 0)


def is_extracted(position: Column) -> Column:
    numbers = [position[c] for c in ("line_start", "line_end", "column_start", "column_end")]
    ok = position["file_name"] != ""
    for n in numbers:
        ok = ok & (n > 0)
    return F.coalesce(ok, F.lit(False))


def clean_locations(block: Column, name: Column, version: Column) -> Column:
    """struct(block, name, version) with invalid name and version as null; null if the block has no file or lines."""
    ok = F.coalesce((block["file_name"] != "") & (block["line_start"] > 0) & (block["line_end"] > 0), F.lit(False))
    return F.when(ok, F.struct(block.alias("block"), F.when(is_extracted(name), name).alias("name"), F.when(is_extracted(version), version).alias("version")))


def find_in_lines(lines: list[str], text: str, first_line: int) -> tuple[int, int, int, int] | None:
    """Python: (line, line, column start, column end) of the first line that holds the text."""
    if not text:
        return None
    for i, line in enumerate(lines):
        at = line.find(text)
        if at >= 0:
            return first_line + i, first_line + i, at + 1, at + 1 + len(text)
    return None


def find_term(lines: list[str], pattern: str, first_line: int) -> tuple[int, int, int, int] | None:
    """Python: place of the group 'term' of the first match."""
    for i, line in enumerate(lines):
        m = re.search(pattern, line)
        if m:
            return first_line + i, first_line + i, m.start("term") + 1, m.end("term") + 1
    return None


def toml_tables(lines: list[str], head: str) -> list[tuple[int, int, int, int]]:
    """Python: (line start, line end, column start, column end) of each table with exactly this head line.

    A table ends before the next head of any kind, without the blank line in front of it, or with the file.
    """
    found: list[tuple[int, int, int, int]] = []
    begin = None
    for i in range(len(lines) + 1):
        if i == len(lines) or lines[i].startswith("["):
            if begin is not None:
                end = i
                while end > begin + 1 and not lines[end - 1].strip():
                    end -= 1
                line = lines[begin]
                found.append((begin + 1, end, len(line) - len(line.lstrip()) + 1, len(lines[end - 1].rstrip()) + 1))
            begin = i if i < len(lines) and lines[i] == head else None
    return found


def json_objects(text: str, group: str) -> dict[tuple[str, ...], tuple[int, int, int, int]]:
    """Python: (line start, line end, column start, column end) of each object that is a value in an object named group,
    by the keys down to it without the group's own; groups nested in such objects count as well.

    The start is the first character of the key's line, the end stands behind the closing brace. Braces in strings don't
    count, and objects may share a line.
    """
    found: dict[tuple[str, ...], tuple[int, int, int, int]] = {}
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect.bisect_right(starts, at) - 1
    stack: list[tuple[str | None, int, tuple[str, ...] | None]] = []  # key, its place, and the path if the object counts
    key, key_at = None, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', text):
        token = m.group()
        if token[0] == '"':
            if text[m.end() :].lstrip()[:1] == ":":
                key, key_at = json.loads(token), m.start()
        elif token in "{[":
            above = next((p for _, _, p in reversed(stack) if p is not None), ())
            inside = bool(stack) and stack[-1][0] == group and token == "{" and key is not None
            stack.append((key, key_at, (*above, key) if inside else None))
            key = None
        elif token in "}]" and stack:
            _, at, path = stack.pop()
            if path is not None:
                first, last = line(at), line(m.start())
                raw = text[starts[first] : at]
                found[path] = (first + 1, last + 1, len(raw) - len(raw.lstrip()) + 1, m.end() - starts[last] + 1)
        elif token == ",":
            key = None
    return found


def safe_int(value: Column) -> Column:
    """A whole number as int; null if it doesn't fit."""
    return value.try_cast("int")
