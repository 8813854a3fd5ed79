"""Modules that a Go program was built from, read from the build information inside the program."""

from __future__ import annotations

from lockgrain.sources.formats.common import package

#: The mark before the build information, its size, the flag for inline strings, and the module text's frame.
MAGIC = b"\xff Go buildinf:"
HEADER, INLINE, FRAME = 32, 2, 16


def _text(raw: bytes, at: int) -> tuple[bytes, int]:
    """A string with its length as a variable-length number in front, and where it ends."""
    size = shift = 0
    while True:
        byte = raw[at]
        at += 1
        size |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return raw[at : at + size], at + size


def may_be_program(path: str) -> bool:
    """Names without an extension, or with .exe."""
    name = path.rsplit("/", 1)[-1]
    return bool(name) and ("." not in name or name.endswith(".exe"))


def go_binary(path: str, raw: bytes) -> list[dict]:
    at = raw.find(MAGIC)
    if at < 0 or len(raw) < at + HEADER or not raw[at + 15] & INLINE:
        raise ValueError("no build information")
    version, end = _text(raw, at + HEADER)
    modules, _ = _text(raw, end)
    rows = [package("stdlib", version.decode("utf-8", "replace").removeprefix("go"), "Go", "Golang")]
    for line in modules[FRAME:-FRAME].decode("utf-8", "replace").split("\n"):
        kind, _, rest = line.partition("\t")
        fields = rest.split("\t")
        if kind in ("dep", "=>") and len(fields) > 1:
            if kind == "=>" and len(rows) > 1:
                rows.pop()
            rows.append(package(fields[0], fields[1].removeprefix("v"), "Go", "Golang"))
    return rows
