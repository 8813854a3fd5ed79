"""Duplicates hidden by formatting differences.

Records are reduced to a canonical text (characters, case, white space, punctuation and field order taken out), hashed
to 128 bits, and counted with map-side combining. An independent 64-bit hash travels along: where it differs inside a
group two texts share the 128 bits, and those groups are resolved again by their whole canonical text.

Canonical form of a value: its runs of letters and digits in order, lower case, one space between runs. Missing, null
and blank values, and values without any letter or digit, are the same empty value. Null records, and texts that are no
JSON object, are no records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.session import cut_lineage

#: Groups with at least one of so many records are hot: there are at most HOT of them, which bounds their broadcast.
HOT = 1000


def canonical_value(value: Column) -> Column:
    """Runs of letters and digits, lower case, joined by one space; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def json_fields(payload: Column, fields: Sequence[str]) -> Column:
    """Struct of the named top-level fields of a JSON object, whatever the case of its keys; null if it is no object.

    Of keys that differ in case only, the first with a value counts.
    """
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    pick = lambda f: F.get(F.filter(entries, lambda e: (F.lower(e["key"]) == f.lower()) & e["value"].isNotNull()), F.lit(0))["value"]
    return F.when(entries.isNotNull(), F.struct(*(pick(f).alias(f) for f in fields)))


def canonical_records(df: DataFrame, record_id: str, values: Sequence[Column]) -> DataFrame:
    """(id, canon, h1, h2, h3) per row: canonical text, its 128 bits as two numbers, and the independent check."""
    text = F.concat_ws("\u001f", *(canonical_value(v) for v in values))
    rows = df.select(F.col(record_id).alias("id"), text.alias("canon"))
    digest = F.md5("canon")
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return rows.select("id", "canon", half(1).alias("h1"), half(17).alias("h2"), F.xxhash64("canon").alias("h3"))


def _by_hash(records: DataFrame) -> DataFrame:
    """A state of five numbers per group and task; other differs from h3 where two texts share the 128 bits."""
    return records.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("h3").alias("h3"), F.max("h3").alias("other"))


def _by_text(records: DataFrame, clash: DataFrame) -> DataFrame:
    rows = records.join(clash.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return rows.groupBy("canon").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collapse(records: DataFrame) -> DataFrame:
    """(first_id, copies): one row per distinct record with the number of its copies, from canonical_records."""
    found = _by_hash(records)
    out = found.where("h3 = other").select("first_id", "copies")
    clash = found.where("h3 <> other")
    return out if clash.isEmpty() else out.union(_by_text(records, clash).select("first_id", "copies"))


def duplicates(records: DataFrame) -> DataFrame:
    """(first_id, id): every record that isn't the smallest id of its group.

    Groups of more than one are joined back to their members. Hot groups, at most HOT by their share of all records,
    are met by a broadcast; all others by a shuffle in which no group is larger than one in HOT of the records. Groups
    in which the 128 bits clash are grouped by their whole text instead.
    """
    slim = cut_lineage(records.select("id", "h1", "h2", "h3"))  # texts are read and parsed once; four numbers a record stay
    found = cut_lineage(_by_hash(slim))
    groups = found.where("h3 = other and copies > 1").select("h1", "h2", "first_id", "copies")
    total = found.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = groups.where(F.col("copies") * HOT >= total).drop("copies")
    cold = groups.where(F.col("copies") * HOT < total).drop("copies")
    slim = slim.drop("h3")
    marked = slim.join(F.broadcast(hot), ["h1", "h2"], "left")
    of_hot = marked.where("first_id is not null").select("first_id", "id")
    of_cold = marked.where("first_id is null").drop("first_id").join(cold.hint("merge"), ["h1", "h2"]).select("first_id", "id")
    out = of_hot.union(of_cold)
    clash = found.where("h3 <> other").select("h1", "h2")
    if not clash.isEmpty():
        rows = records.join(clash, ["h1", "h2"], "left_semi").select("id", "canon")
        firsts = _by_text(records, clash).select("canon", "first_id")
        out = out.union(rows.join(firsts, "canon").select("first_id", "id"))
    return out.where("id <> first_id")
