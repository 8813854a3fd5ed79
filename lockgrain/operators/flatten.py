"""Deeply nested records to flat tables that keep the link to their parent.

Nested columns are flattened from Arrow buffers: list offsets give the parent index of each element, the child values
are used as they lie, and keys travel down by a vectorised take. Rows are never parsed one by one. JSON text whose
nesting depth is open (a lockfile's dependencies) is decoded once and then flattened level by level in the same way:
each level is one list of keys, one list of lengths that become offsets, and a take of the parents' paths.

``child_tables`` makes the related flat tables of any nested columns: one for each list, with the record's key, the position
at every level as the link to its parents, and the plain values of its elements as columns.

Defined results: null or empty lists, null structs and null elements give no row; positions count null elements; a
text that is no JSON object gives no row; an entry that is no object is a row without children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.functions.jsontext import read_object
from lockgrain.session import bound_batches

SEP = " > "
FLAT_SCHEMA = "kind string, record_id long, parent_path string, item string"


def unnest(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(values, parent index, position) of the non-null elements of a list array, from its offsets."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = np.zeros(len(lists), np.int64)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts[1:] = np.cumsum(lengths)[:-1]
    position = pa.array(np.arange(len(values), dtype=np.int64) - np.repeat(starts, lengths))
    if values.null_count:
        keep = pc.is_valid(values)
        values, parents, position = values.filter(keep), parents.filter(keep), position.filter(keep)
    return values, parents, position


def field(structs: pa.Array, name: str) -> pa.Array:
    """A field of a struct array; null where the struct is null."""
    return pc.struct_field(structs, name)


def _rows(kind: str, ids: pa.Array, path: pa.Array, item: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(kind, n).cast(pa.string()), ids.cast(pa.int64()), path.cast(pa.string()), item.cast(pa.string())],
        names=["kind", "record_id", "parent_path", "item"],
    )


def _join(*parts: pa.Array | str, sep: str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(sep), null_handling="replace", null_replacement="")


def flatten_vulns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (record_id, locations, vulnerabilities) to location, vulnerability, affected and event rows."""
    for batch in batches:
        ids = batch.column("record_id")
        values, parent, pos = unnest(batch.column("locations"))
        yield _rows("location", ids.take(parent), pa.repeat("", len(pos)), pos)
        vuln, parent, _ = unnest(batch.column("vulnerabilities"))
        owner, vid = ids.take(parent), field(vuln, "id").cast(pa.string())
        yield _rows("vulnerability", owner, pa.repeat("", len(vid)), vid)
        affected, parent, a_pos = unnest(field(vuln, "affected"))
        owner, vid = owner.take(parent), vid.take(parent)
        yield _rows("affected", owner, vid, a_pos)
        ranges, parent, r_pos = unnest(field(affected, "ranges"))
        owner, path = owner.take(parent), _join(vid.take(parent), a_pos.take(parent).cast(pa.string()), sep="/")
        events, parent, e_pos = unnest(field(ranges, "events"))
        owner, path = owner.take(parent), _join(path.take(parent), r_pos.take(parent).cast(pa.string()), sep="/")
        yield _rows("event", owner, path, e_pos)


def _level(owners: pa.Array, paths: pa.Array, maps: list[dict]) -> tuple[pa.Array, pa.Array, pa.Array, list]:
    """Entries of one level of objects: owner, parent path, key, value."""
    keys = [k for m in maps for k in m]
    lengths = np.fromiter((len(m) for m in maps), np.int64, len(maps))
    parent = pa.array(np.repeat(np.arange(len(maps)), lengths))
    return owners.take(parent), paths.take(parent), pa.array(keys, pa.string()), [v for m in maps for v in m.values()]


def flatten_lock_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (record_id, content) to dependency and require rows, level by level."""
    for batch in batches:
        found = [(i, d["dependencies"]) for i, t in enumerate(batch.column("content").to_pylist()) if (d := read_object(t)) and isinstance(d.get("dependencies"), dict)]
        owners = batch.column("record_id").take(pa.array([i for i, _ in found], pa.int64()))
        paths, maps = pa.array([""] * len(found), pa.string()), [m for _, m in found]
        top = True
        while maps:
            owners, above, keys, values = _level(owners, paths, maps)
            if not len(keys):
                break
            yield _rows("dependency", owners, above, keys)
            here = keys if top else _join(above, keys, sep=SEP)
            top = False
            for name in ("requires", "dependencies"):
                index = [i for i, v in enumerate(values) if isinstance(v, dict) and isinstance(v.get(name), dict)]
                take = pa.array(index, pa.int64())
                below = owners.take(take), here.take(take), [values[i][name] for i in index]
                if name == "requires":
                    r_owner, r_path, r_key, _ = _level(*below)
                    yield _rows("require", r_owner, r_path, r_key)
                else:
                    owners, paths, maps = below


def flatten_locks(lockfiles: DataFrame, record_id: str | Column = "lock_id", content: str | Column = "content") -> DataFrame:
    """dependency and require rows of every readable content."""
    bound_batches(lockfiles.sparkSession)
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return lockfiles.select(col(record_id).cast("long").alias("record_id"), col(content).alias("content")).where("content is not null").mapInArrow(flatten_lock_tree, FLAT_SCHEMA)


def flatten_package_vulns(vulns: DataFrame, record_id: str = "pv_id") -> DataFrame:
    """location, vulnerability, affected and event rows of every record."""
    pruned = vulns.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.transform("locations", lambda x: F.when(x.isNotNull(), F.struct(F.lit(1).alias("at")))).alias("locations"),
        F.transform(
            "vulnerabilities",
            lambda v: F.when(
                v.isNotNull(),
                F.struct(
                    v["id"].alias("id"),
                    F.transform(
                        v["affected"],
                        lambda a: F.when(
                            a.isNotNull(),
                            F.struct(
                                F.transform(
                                    a["ranges"],
                                    lambda r: F.when(r.isNotNull(), F.struct(F.transform(r["events"], lambda e: F.when(e.isNotNull(), F.struct(F.lit(1).alias("at")))).alias("events"))),
                                ).alias("ranges")
                            ),
                        ),
                    ).alias("affected"),
                ),
            ),
        ).alias("vulnerabilities"),
    )
    return pruned.mapInArrow(flatten_vulns, FLAT_SCHEMA)


# --- any nested columns ---------------------------------------------------------------------------------------------


def _lists_in(kind: T.DataType, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """(fields down to it, type of its elements) of each list in a type, through structs but not through lists."""
    if isinstance(kind, T.ArrayType):
        yield at, kind.elementType
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _lists_in(f.dataType, (*at, f.name))


def _leaves(kind: T.DataType, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """(fields down to it, type) of each value in a type that is neither list nor struct."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, (*at, f.name))
    elif not isinstance(kind, T.ArrayType):
        yield at, kind


def _dig(column: Column, fields: tuple[str, ...]) -> Column:
    for f in fields:
        column = column[f]
    return column


def _pruned(column: Column, steps: list[tuple[str, ...]], leaves: list[tuple[str, ...]]) -> Column:
    """A nested list with nothing left but the way to the wanted list and its elements' values."""
    if steps:
        inner = lambda x: F.struct(_pruned(_dig(x, steps[0]), steps[1:], leaves).alias("next"))
    else:
        inner = lambda x: F.struct(F.lit(True).alias("is"), *(_dig(x, leaf).alias(f"l{i}") for i, leaf in enumerate(leaves)))
    return F.transform(column, lambda x: F.when(x.isNotNull(), inner(x)))


def _flattener(levels: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, positions = batch.column(0), batch.column(1), []
            for level in range(levels):
                values, parent, position = unnest(lists)
                keys, positions = keys.take(parent), [*(p.take(parent) for p in positions), position]
                lists = field(values, "next") if level + 1 < levels else None
            columns = [field(values, f"l{i}") for i in range(len(names) - 1 - levels)]
            yield pa.RecordBatch.from_arrays([keys, *positions, *columns], names=names)

    return run


def child_tables(df: DataFrame, key: str, *columns: str) -> dict[str, DataFrame]:
    """The flat tables of nested columns, by the path of their list ('vulnerabilities.affected.ranges').

    Each has the record's key, at_1 to at_n (positions, from 0, of the element and all elements above it; with the key
    they name the parent row) and the element's plain values, structs spread as a_b; an element that is itself plain is
    the column ``value``. Lists within the element have tables of their own; a list of lists is no table. Null elements
    count in positions and give no row; names that clash get a number.
    """
    bound_batches(df.sparkSession)
    tables: dict[str, DataFrame] = {}
    key_kind = df.schema[key].dataType.simpleString()

    def add(top: Column, steps: list[tuple[str, ...]], path: str, element: T.DataType) -> None:
        if isinstance(element, T.ArrayType):
            return
        leaves = list(_leaves(element))
        names = [key, *(f"at_{i + 1}" for i in range(len(steps) + 1))]
        for at, _ in leaves:
            name = base = "_".join(at) or "value"
            n = 1
            while name in names:
                n += 1
                name = f"{base}_{n}"
            names.append(name)
        kinds = [key_kind, *["long"] * (len(steps) + 1), *(k.simpleString() for _, k in leaves)]
        schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
        slim = df.select(F.col(key), _pruned(top, steps, [at for at, _ in leaves]).alias("lists"))
        tables[path] = slim.mapInArrow(_flattener(len(steps) + 1, names), schema)
        for at, inner in _lists_in(element):
            add(top, [*steps, at], f"{path}.{'.'.join(at)}", inner)

    for c in columns:
        for at, element in _lists_in(df.schema[c].dataType):
            add(_dig(F.col(c), at), [], ".".join((c, *at)), element)
    return tables
