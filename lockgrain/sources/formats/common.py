"""Package rows as the formats make them."""

from __future__ import annotations


def package(name: str, version: str, ecosystem: str, manager: str, **more) -> dict:
    row = {"name": name or "", "version": version or "", "ecosystem": ecosystem, "package_manager": manager, "commit": "", "dep_groups": [], "is_direct": False, "target_versions": [], "block": None, "name_loc": None, "version_loc": None, "children": []}
    row.update(more)
    return row


def place(file: str, line_start: int, line_end: int, column_start: int, column_end: int) -> dict:
    return {"file_name": file, "line_start": line_start, "line_end": line_end, "column_start": column_start, "column_end": column_end}


def text_of(value) -> str:
    """A scalar as text; '' for anything else."""
    if value is None or isinstance(value, (dict, list, bool)):
        return ""
    return str(value)


def strings(value) -> list[str]:
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def table(value) -> dict:
    return value if isinstance(value, dict) else {}


def last_by_key(rows: list[dict], key) -> list[dict]:
    return list({key(r): r for r in rows}.values())
