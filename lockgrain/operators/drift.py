"""Schemas that drift between files: fingerprints per revision, a report of each change, one consistent table.

Every readable content gets a schema fingerprint: its top-level fields with their JSON kinds. Revisions of a file are
compared with the readable revision before them (``schema_changes``). ``migrate`` routes each content by its fingerprint:
the chain of explicit steps (rename, cast, default) from that schema to the newest one of its format is made once for
each fingerprint (``route``), and every step a content took is recorded. ``schema_registry`` lists the fingerprints with
their chains. A value that
can't be told from what it was cast to stays beside it as ``field#kind`` (step ``kept``), as does one that can't be cast.

Defined results: null, broken or non-object contents are unreadable and take no part; a byte order mark is dropped; a
null value is an absent field; of a repeated key the last value counts; a revision loaded twice counts once (the row
with the smallest id); a null source_path or rev gives no comparison. Contents nested deeper than the JSON decoder
allows count as unreadable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockgrain.functions.jsontext import canonical, kind_of, read_object
from lockgrain.session import bound_batches, cut_lineage

FIELDS = "array<struct<name:string,kind:string,value:string>>"
BLOCK = 12  # revisions per window: 2**BLOCK


def fingerprint(text: str | None) -> list[tuple[str, str, str]] | None:
    """(name, kind, hash of the value) of each top-level field in name order; None if the text is unreadable."""
    found = read_object(text)
    if found is None:
        return None
    try:
        return [(k, kind_of(v), xxhash.xxh3_128_hexdigest(canonical(v).encode("utf-8", "surrogatepass"))) for k, v in sorted(found.items()) if v is not None]
    except RecursionError:
        return None


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("content").to_pylist()]
        fields = pa.array([None if f is None else [dict(zip(("name", "kind", "value"), x)) for x in f] for f in found], kind)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("source_path", "rev", "id")), fields], names=["source_path", "rev", "id", "fields"])


def schema_fingerprints(lockfiles: DataFrame, record_id: str = "lock_id") -> DataFrame:
    """(source_path, rev, id, fields) of each readable revision, once."""
    bound_batches(lockfiles.sparkSession)
    rows = lockfiles.select(F.col("source_path").cast("string"), F.col("rev").cast("int"), F.col(record_id).cast("long").alias("id"), F.col("content").cast("string"))
    read = rows.where("content is not null").mapInArrow(_fingerprints, f"source_path string, rev int, id long, fields {FIELDS}")
    return read.where("fields is not null").groupBy("source_path", "rev").agg(F.min("id").alias("id"), F.min_by("fields", "id").alias("fields"))


def with_previous(revisions: DataFrame) -> DataFrame:
    """Adds before: the fields of the readable revision before, null for the first.

    Two steps, so that a file with a third of all revisions is no single task: within blocks of 2**BLOCK revision
    numbers, then the last of each block handed to the next block that has rows.
    """
    rows = cut_lineage(revisions.where("source_path is not null and rev is not null").withColumn("block", F.shiftright("rev", BLOCK)))  # contents are parsed once
    inner = Window.partitionBy("source_path", "block").orderBy("rev")
    within = rows.withColumns({"before": F.lag("fields").over(inner), "first": F.row_number().over(inner) == 1})
    last = rows.groupBy("source_path", "block").agg(F.max_by("fields", "rev").alias("fields"))
    handed = last.select("source_path", "block", F.lag("fields").over(Window.partitionBy("source_path").orderBy("block")).alias("handed"))
    return (
        within.join(handed, ["source_path", "block"])
        .withColumn("before", F.when(F.col("first"), F.col("handed")).otherwise(F.col("before")))
        .drop("block", "first", "handed")
    )


def _gone(here: str, there: str) -> F.Column:
    names = F.array_except(F.transform(here, lambda x: x["name"]), F.transform(there, lambda x: x["name"]))
    return F.filter(here, lambda x: F.array_contains(names, x["name"]))


def _numbered(fields: F.Column) -> F.Column:
    """Adds to each field how many before it hold the same value, so equal values pair one to one."""
    return F.transform(fields, lambda x, i: F.struct(x["name"].alias("name"), x["value"].alias("value"), F.size(F.filter(F.slice(fields, F.lit(1), i), lambda y: y["value"] == x["value"])).alias("nth")))


def schema_changes(lockfiles: DataFrame, record_id: str = "lock_id") -> DataFrame:
    """(source_path, rev, drift, old_field, new_field): added, removed, renamed and retyped top-level fields.

    A gone field pairs with a new one of an equal value as renamed; of several equal values the n-th by name pairs with
    the n-th by name.
    """
    pairs = with_previous(schema_fingerprints(lockfiles, record_id)).where("before is not null")
    pairs = pairs.withColumns({"gone": _gone("before", "fields"), "new": _gone("fields", "before")})
    pairs = pairs.withColumns({"gone": _numbered(F.col("gone")), "new": _numbered(F.col("new"))})
    same = lambda x, y: (x["value"] == y["value"]) & (x["nth"] == y["nth"])
    row = lambda drift, old, new: F.struct(F.lit(drift).alias("drift"), old.alias("old_field"), new.alias("new_field"))
    blank = F.lit("")
    renamed = F.flatten(F.transform("gone", lambda x: F.transform(F.filter("new", lambda y: same(x, y)), lambda y: row("renamed", x["name"], y["name"]))))
    removed = F.transform(F.filter("gone", lambda x: ~F.exists("new", lambda y: same(x, y))), lambda x: row("removed", x["name"], blank))
    added = F.transform(F.filter("new", lambda y: ~F.exists("gone", lambda x: same(x, y))), lambda y: row("added", blank, y["name"]))
    kinds = F.map_from_entries(F.transform("before", lambda x: F.struct(x["name"], x["kind"])))
    pairs = pairs.withColumn("kinds", kinds)
    retyped = F.transform(F.filter("fields", lambda y: F.col("kinds")[y["name"]] != y["kind"]), lambda y: row("retyped", y["name"], y["name"]))
    return pairs.select("source_path", "rev", F.explode(F.concat(renamed, removed, added, retyped)).alias("c")).select("source_path", "rev", "c.*")


# --- one consistent table -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One migration step of a format: from a schema version to the next."""

    version: int
    action: str  # rename, cast or default
    field: str
    to: str


#: Migration steps by format, in order. Names on the left are spellings that occur; a field the steps don't know is kept in `extra`.
STEPS: dict[str, tuple[Step, ...]] = {
    "package-lock": (
        *(Step(1, "rename", old, "lockfileVersion") for old in ("LockfileVersion", "lockVersion", "lockfile_version")),
        *(Step(1, "rename", old, "packages") for old in ("Packages", "installed", "package_map")),
        Step(2, "cast", "lockfileVersion", "number"),
        Step(2, "cast", "packages", "object"),
        Step(2, "cast", "requires", "boolean"),
        Step(3, "default", "lockfileVersion", "1"),
        Step(3, "default", "requires", "false"),
    ),
    "conan-lock": (
        *(Step(1, "rename", old, "graph_lock") for old in ("graph", "graphLock", "lock_graph")),
        *(Step(1, "rename", old, "requires") for old in ("Requires", "host_requires", "requirements")),
        Step(2, "cast", "version", "string"),
        Step(2, "cast", "graph_lock", "object"),
        Step(2, "cast", "requires", "array<string>"),
        Step(3, "default", "version", '"0.4"'),
    ),
}

#: Columns of the consistent table; each holds JSON text but for the scalars.
COLUMNS = ("name", "version", "lockfileVersion", "requires", "packages", "dependencies", "graph_lock", "build_requires", "python_requires")


def _cast(value, kind: str) -> tuple:
    """(the value as the wanted kind, whether the value can be told from it); raises ValueError if there is no way."""
    now = kind_of(value)
    if now == kind or kind == "array<string>" and now == "array<>":
        return value, True
    if kind == "string":
        return canonical(value), True
    if kind == "number" and isinstance(value, str):
        number = float(value)
        number = int(number) if number.is_integer() else number
        return number, canonical(number) == value
    if kind == "object":
        if isinstance(value, str):
            inner = read_object(value)
            if inner is not None:
                return inner, True
        if isinstance(value, list):
            named = {}
            for i, v in enumerate(value):
                key = next((v[k] for k in ("path", "key", "name") if isinstance(v, dict) and isinstance(v.get(k), str)), str(i))
                while key in named:
                    key = f"{key}#{i}"
                named[key] = v
            return named, list(named) == sorted(named)  # an object has no order but that of its keys
    if kind == "boolean" and isinstance(value, dict):
        return bool(value), not value
    if kind == "array<string>":
        if isinstance(value, dict):
            names = [k if not isinstance(v, str) or not v else f"{k}/{v}" for k, v in value.items()]
            return names, all(isinstance(v, str) and "/" not in k for k, v in value.items())
        if isinstance(value, list):
            return [v if isinstance(v, str) else next((v[k] for k in ("ref", "name") if isinstance(v, dict) and isinstance(v.get(k), str)), canonical(v)) for v in value], False
    raise ValueError(f"{now} to {kind}")


def _aside(fields: dict, field: str, kind: str, value) -> str:
    """Puts the value beside its field, under a name the content doesn't use, and returns the name."""
    name = f"{field}#{kind}"
    while name in fields:
        name += "#"
    fields[name] = value
    return name


Shape = tuple[tuple[str, str], ...]


def shape_of(fields: dict) -> Shape:
    """The schema of a content: its fields with their kinds, by name."""
    return tuple((k, kind_of(v)) for k, v in sorted(fields.items()))


def schema_id(shape: Shape) -> str:
    return xxhash.xxh3_64_hexdigest("|".join(f"{k}:{kind}" for k, kind in shape).encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=1 << 14)
def route(parsed_as: str, shape: Shape) -> tuple[Step, ...]:
    """The chain of steps from a schema to the newest one of its format; it depends on the fingerprint alone.

    A default stays in the chain behind a cast of its field, for values that can't be cast.
    """
    now = dict(shape)
    chain, cast = [], set()
    for s in STEPS.get(parsed_as, ()):
        if s.action == "rename" and s.field in now and s.to not in now:
            now[s.to] = now.pop(s.field)
            chain.append(s)
        elif s.action == "cast" and s.field in now and now[s.field] != s.to:
            now[s.field] = s.to
            cast.add(s.field)
            chain.append(s)
        elif s.action == "default" and (s.field not in now or s.field in cast):
            chain.append(s)
    return tuple(chain)


def migrate_content(text: str | None, parsed_as: str | None) -> tuple[dict, list[tuple[int, str, str, str]]] | None:
    """(fields after all steps, recorded steps); None if the text is unreadable."""
    found = read_object(text)
    if found is None:
        return None
    fields = {k: v for k, v in found.items() if v is not None}
    return migrate_fields(fields, route(parsed_as or "", shape_of(fields)))


def migrate_fields(fields: dict, chain: tuple[Step, ...]) -> tuple[dict, list[tuple[int, str, str, str]]]:
    """The fields after the steps of their schema's chain, and the steps recorded."""
    fields = dict(fields)
    log: list[tuple[int, str, str, str]] = []
    for s in chain:
        if s.action == "rename":
            fields[s.to] = fields.pop(s.field)
            log.append((s.version, "renamed", s.field, s.to))
        elif s.action == "cast":
            value = fields[s.field]
            was = kind_of(value)
            try:
                fields[s.field], whole = _cast(value, s.to)
                log.append((s.version, "cast", s.field, f"{was} to {s.to}"))
                if not whole:
                    log.append((s.version, "kept", s.field, _aside(fields, s.field, was, value)))
            except (ValueError, OverflowError):
                log.append((s.version, "uncast", s.field, f"{was} to {s.to}"))
                _aside(fields, s.field, was, fields.pop(s.field))
        elif s.field not in fields:
            fields[s.field] = json.loads(s.to)
            log.append((s.version, "default", s.field, s.to))
    return fields, log


UNIFIED_SCHEMA = (
    "lock_id long, source_path string, parsed_as string, rev int, schema_id string, name string, version string, lockfile_version double, "
    "requires string, packages string, dependencies string, graph_lock string, build_requires string, python_requires string, extra map<string,string>, "
    "steps array<struct<version:int,action:string,field:string,detail:string>>"
)


def _unified_arrow() -> pa.Schema:
    text, step = pa.string(), pa.struct([("version", pa.int32()), ("action", pa.string()), ("field", pa.string()), ("detail", pa.string())])
    kinds = {"lock_id": pa.int64(), "rev": pa.int32(), "lockfile_version": pa.float64(), "extra": pa.map_(text, text), "steps": pa.list_(step)}
    names = ("lock_id", "source_path", "parsed_as", "rev", "schema_id", "name", "version", "lockfile_version", "requires", "packages", "dependencies", "graph_lock", "build_requires", "python_requires", "extra", "steps")
    return pa.schema([(n, kinds.get(n, text)) for n in names])


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _unified_arrow()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            try:
                found = read_object(r["content"])
                if found is None:
                    continue
                found = {k: v for k, v in found.items() if v is not None}
                shape = shape_of(found)
                fields, log = migrate_fields(found, route(r["parsed_as"] or "", shape))
                text = {k: v if isinstance(v, str) else canonical(v) for k, v in fields.items()}
                number = fields.get("lockfileVersion")
                rows.append(
                    {
                        **{k: r[k] for k in ("lock_id", "source_path", "parsed_as", "rev")},
                        "schema_id": schema_id(shape),
                        "lockfile_version": float(number) if isinstance(number, (int, float)) and not isinstance(number, bool) else None,
                        **{c: text.get(c) for c in COLUMNS if c != "lockfileVersion"},
                        "extra": [(k, v) for k, v in text.items() if k not in COLUMNS],
                        "steps": [dict(zip(("version", "action", "field", "detail"), s)) for s in log],
                    }
                )
            except (RecursionError, OverflowError):
                continue
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def migrate(lockfiles: DataFrame) -> DataFrame:
    """One row per readable content in one schema, with the steps it took; unknown fields stay in ``extra``."""
    bound_batches(lockfiles.sparkSession)
    rows = lockfiles.select(F.col("lock_id").cast("long"), F.col("source_path").cast("string"), F.col("parsed_as").cast("string"), F.col("rev").cast("int"), F.col("content").cast("string"))
    return rows.where("content is not null").mapInArrow(_unify, UNIFIED_SCHEMA)


def migration_report(lockfiles: DataFrame) -> DataFrame:
    """(lock_id, source_path, rev, version, action, field, detail): every step taken for every content."""
    return migrate(lockfiles).select("lock_id", "source_path", "rev", F.explode("steps").alias("s")).select("lock_id", "source_path", "rev", "s.*")


def schema_registry(lockfiles: DataFrame) -> DataFrame:
    """(parsed_as, schema_id, n_contents, first_rev, last_rev, steps): every schema met, and the steps its contents took.

    ``steps`` are those of the content with the smallest id, as 'version action field' texts; steps that depend on a
    value (``kept``, ``uncast``) may differ between contents and are in ``migration_report``.
    """
    rows = migrate(lockfiles).select("parsed_as", "schema_id", "rev", "lock_id", F.transform("steps", lambda s: F.concat_ws(" ", s["version"].cast("string"), s["action"], s["field"])).alias("steps"))
    return rows.groupBy("parsed_as", "schema_id").agg(
        F.count("*").alias("n_contents"), F.min("rev").alias("first_rev"), F.max("rev").alias("last_rev"), F.min_by("steps", "lock_id").alias("steps")
    )
