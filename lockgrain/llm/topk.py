"""Most frequent values of a column within bounded memory: three-phase threshold top-k.

1. Every node (task) counts its own rows in a table of at most 2 x ``capacity`` values; when it is full the counts are
   lowered together and what falls to zero is dropped (Misra-Gries), so a node knows each of its values up to an error of
   rows / capacity. Nodes hand over their leaders; summed lower bounds give the lower bound of the k-th count, or the
   share of all rows that is asked for is the bound.
2. A value that reaches the bound must reach the bound's share in at least one node, so only values whose upper bound over
   all nodes reaches it are fetched: the candidates.
3. One more pass counts the candidates exactly.

The tables of the nodes hold capacity values whatever the input; the candidates are at most
``bound / (1 - 1 / (capacity x share))`` many. For a top-k the result is certified if the k-th exact count is not below
what any value outside the candidates can reach; if it isn't, the capacity is raised, and in the end an exact
aggregation is made, so the result is always right.

Null and '' are no values, though their rows count for shares. Ties at the k-th place go to the smaller value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.session import cut_lineage

SUMMARY = "field string, item string, low long, node_rows long, error long"


class Counters:
    """Counts of one node, for at most 2 x capacity values; each is at most ``error`` too low."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.error, self.counts = capacity, 0, 0, {}

    def add(self, values: list[str], counts: list[int]) -> None:
        have = self.counts
        for v, n in zip(values, counts):
            have[v] = have.get(v, 0) + n
            if len(have) >= 2 * self.capacity:
                self.shrink()
                have = self.counts

    def shrink(self) -> None:
        """Lowers all counts by the largest that doesn't fit."""
        if len(self.counts) <= self.capacity:
            return
        cut = sorted(self.counts.values(), reverse=True)[self.capacity]
        self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
        self.error += cut


def _node(fields: Sequence[str], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: Counters(capacity) for f in fields}
        for batch in batches:
            for f, c in held.items():
                col = batch.column(f)
                c.rows += len(col)
                got = pc.value_counts(col.filter(pc.and_kleene(pc.is_valid(col), pc.not_equal(col, ""))))
                c.add(got.field(0).to_pylist(), got.field(1).to_pylist())
        for f, c in held.items():
            if c.rows:
                c.shrink()
                items = [None, *c.counts]
                n = len(items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * n, pa.string()), pa.array(items, pa.string()), pa.array([0, *c.counts.values()], pa.int64()), pa.array([c.rows] + [0] * (n - 1), pa.int64()), pa.array([c.error] * n, pa.int64())],
                    names=["field", "item", "low", "node_rows", "error"],
                )

    return run


def _summaries(df: DataFrame, fields: Sequence[str], capacity: int) -> DataFrame:
    """The tables of all nodes; the row without an item carries the node's rows and error."""
    slim = df.select(*(F.col(f).cast("string").alias(f) for f in fields))
    return cut_lineage(slim.mapInArrow(_node(fields, capacity), SUMMARY))


def _bounds(nodes: DataFrame) -> DataFrame:
    """(field, item, low, high, total_error): bounds of each value's count over all nodes.

    A node that doesn't hold a value may still have had it up to its error: high is low plus the errors of all nodes.
    """
    totals = nodes.where("item is null").groupBy("field").agg(F.sum("node_rows").alias("n"), F.sum("error").alias("total_error"))
    low = nodes.where("item is not null").groupBy("field", "item").agg(F.sum("low").alias("low"))
    return low.join(F.broadcast(totals), "field").withColumn("high", F.col("low") + F.col("total_error"))


NEAR_BYTES = 64 << 20  # bytes of all candidates up to which they are broadcast; they are few, but may be long


def _exact(df: DataFrame, candidates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exact counts of the candidates: one pass, one broadcast of a bounded list, partial counts in each task.

    Candidates of more than NEAR_BYTES are met by a shuffle of counts per value instead.
    """
    candidates = candidates.select("field", "item")
    size = candidates.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    kinds = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields))
    items = df.select(F.inline(kinds)).where("item is not null and item <> ''")
    if size > NEAR_BYTES:
        return items.groupBy("field", "item").agg(F.count("*").alias("n")).join(candidates, ["field", "item"], "left_semi")
    return items.join(F.broadcast(candidates), ["field", "item"]).groupBy("field", "item").agg(F.count("*").alias("n"))


def frequent_items(df: DataFrame, fields: Sequence[str], one_in: int, capacity: int | None = None) -> DataFrame:
    """(field, item, n, approx): every value in at least one of ``one_in`` rows of the table, with its exact count.

    ``approx`` is the lower bound known after the first pass. At most one_in x 8 / 7 candidates a field are counted.
    """
    nodes = _summaries(df, fields, capacity or 8 * one_in)
    known = _bounds(nodes)
    candidates = cut_lineage(known.where(F.col("high") * one_in >= F.col("n")).select("field", "item", F.col("low").alias("approx"), "n"))
    exact = _exact(df, candidates, fields).withColumnRenamed("n", "count")
    return exact.join(candidates, ["field", "item"]).where(F.col("count") * one_in >= F.col("n")).select("field", "item", F.col("count").alias("n"), "approx")


def top_k(df: DataFrame, field: str, k: int, capacity: int | None = None, most_capacity: int = 1 << 18) -> DataFrame:
    """(item, n): the k most frequent values with exact counts."""
    capacity = capacity or max(1024, 16 * k)
    while True:
        nodes = _summaries(df, [field], capacity)
        known = _bounds(nodes)
        leaders = known.orderBy(F.desc("low"), "item").limit(k)
        edge = leaders.agg(F.min("low").alias("bound"), F.count("*").alias("n"), F.max("total_error").alias("error")).first()
        bound = edge["bound"] if edge["n"] == k else 0
        error = edge["error"] or 0
        if bound > error or error == 0:  # what no node kept occurs at most `error` times
            candidates = known.where(F.col("high") >= bound)
            if error == 0:  # nothing was dropped: the counts are exact already
                exact = known.select("field", "item", F.col("low").alias("n"))
                break
            many = candidates.count()
            if many <= most_capacity:
                exact = _exact(df, candidates, [field])
                break
        if capacity >= most_capacity:
            exact = df.select(F.lit(field).alias("field"), F.col(field).cast("string").alias("item")).where("item is not null and item <> ''").groupBy("field", "item").agg(F.count("*").alias("n"))
            break
        capacity = min(most_capacity, capacity * 8)
    best = exact.orderBy(F.desc("n"), "item").limit(k)
    return best.select("item", "n")


