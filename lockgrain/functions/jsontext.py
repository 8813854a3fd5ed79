"""Strict JSON reading shared by the operators on raw file contents."""

from __future__ import annotations

import json


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def read_json(text: str | None):
    """The value of a JSON text, a byte order mark aside; raises ValueError where there is none."""
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text.lstrip("\ufeff"))
    except RecursionError:
        raise ValueError("nested beyond the decoder's limit") from None


def read_object(text: str | None) -> dict | None:
    """The JSON object a text holds, else None. Of a repeated key the last value counts."""
    try:
        value = read_json(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def kind_of(value) -> str:
    """string, number, boolean, object, null, or array<...> with the kinds of its elements in order."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    try:
        return "array<" + "|".join(sorted({kind_of(v) for v in value})) + ">"
    except RecursionError:
        return _deep_kind(value)


def _deep_kind(value: list) -> str:
    """kind_of for lists of any depth."""
    inside, at = [value], 0  # lists in breadth-first order
    while at < len(inside):
        inside += [v for v in inside[at] if isinstance(v, list)]
        at += 1
    kinds: dict[int, str] = {}
    for x in reversed(inside):
        kinds[id(x)] = "array<" + "|".join(sorted({kinds[id(v)] if isinstance(v, list) else kind_of(v) for v in x})) + ">"
    return kinds[id(value)]


def canonical(value) -> str:
    """One text for equal JSON values: keys sorted, no layout, whole numbers without a fraction."""
    try:
        return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except RecursionError:
        return _deep_canonical(value)


def _deep_canonical(value) -> str:
    """canonical for values of any depth."""
    out: list[str] = []
    todo: list = [(value,)]  # values in tuples, and texts as they are; the next one last
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (v,) = x
        if isinstance(v, dict):
            inner = [y for k in sorted(v) for y in (",", json.dumps(k) + ":", (v[k],))]
            todo += ["}", *reversed(inner[1:]), "{"]
        elif isinstance(v, list):
            inner = [y for e in v for y in (",", (e,))]
            todo += ["]", *reversed(inner[1:]), "["]
        else:
            out.append(json.dumps(_plain(v)))
    return "".join(out)


def _plain(value):
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value
