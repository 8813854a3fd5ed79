"""Connected components of an undirected graph, by alternating large-star and small-star rounds.

Nodes are 64-bit numbers. Each round is two aggregations that combine on the map side (the smallest neighbour of each
node) and a join back; the number of rounds grows with the logarithm of the longest chain. No component is ever
gathered into one task or the driver. A hub's rows lie in one join key whose other side is a single row, so adaptive
execution may split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.session import cut_lineage, replace_lineage


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    others = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge to another node; component is the smallest node number in it.

    Null ends and self-loops are left out: such nodes have no other member. An empty table gives an empty result.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    now = edges.select(col(a).alias("u"), col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = cut_lineage(now), None
    for _ in range(most_rounds):
        now = replace_lineage(_small_star(_large_star(now)), now)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


FEW_EDGES = 1_000_000  # pairs of numbers (16 MB) up to which one task joins them, instead of rounds of small jobs


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges of one task by union and find, each node once."""
    head: dict[int, int] = {}

    def find(n: int) -> int:
        top = n
        while (up := head.setdefault(top, top)) != top:
            top = up
        while head[n] != top:
            head[n], n = top, head[n]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                head[max(x, y)] = min(x, y)
    nodes = list(head)
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(n) for n in some], pa.int64())], names=["node", "component"])


def linked_components(links: DataFrame) -> DataFrame:
    """(node, component, parents) of every node of distinct (k, p) links from a child to its parent or null.

    Each node follows one of its parents; pointers double, so after as many rounds as the logarithm of the depth every
    node of a tree knows its root. Only the links of nodes with several parents and of circles are left for the search
    among roots: up to FEW_EDGES different ones are joined by one task, more by ``connected_components``; the components
    are the same. ``parents`` is the number of links to parents.
    """
    ends = links.select("k", "p").union(links.where("p is not null").select("p", F.lit(None).cast("long")))
    nodes = cut_lineage(ends.groupBy("k").agg(F.min("p").alias("up"), F.count("p").alias("parents")))
    state = cut_lineage(nodes.select("k", F.coalesce("up", "k").alias("at"), F.col("up").isNull().alias("done")))
    left = None
    while True:  # a round in which no node reaches a root leaves circles only, and what hangs below them
        still = state.where("not done").count()
        if still in (0, left):
            break
        left = still
        ahead = state.select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("done").alias("ended"))
        step = state.where("not done").join(ahead, "at").select("k", F.col("next").alias("at"), F.col("ended").alias("done"))
        state = replace_lineage(state.where("done").unionByName(step), state)
    label = F.when(F.col("done"), F.col("at")).otherwise(F.col("k"))
    labels = state.select(F.col("k").alias("node"), label.alias("label"))
    open_ = nodes.where("parents > 1").select("k").union(state.where("not done").select("k")).distinct()
    loose = links.where("p is not null").join(open_, "k", "left_semi").select("k", "p")
    loose = loose.join(labels.withColumnsRenamed({"node": "k", "label": "a"}), "k").join(labels.withColumnsRenamed({"node": "p", "label": "b"}), "p")
    loose = cut_lineage(loose.where("a <> b").select("a", "b").distinct())
    named = labels.join(nodes.select(F.col("k").alias("node"), "parents"), "node")
    many = loose.count()
    if many == 0:
        return named.select("node", F.col("label").alias("component"), "parents")
    found = loose.coalesce(1).mapInArrow(_united, "node long, component long") if many <= FEW_EDGES else connected_components(loose)
    joined = found.withColumnsRenamed({"node": "label", "component": "joined"})
    return named.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("component"), "parents")
