"""Closure of package links, as joins to a fixed point with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.operators.hierarchy import reachable_pairs


def closure(edges: DataFrame) -> DataFrame:
    """(source_path, ancestor, node, distance) of EDGE rows; circles are followed once and include the node itself."""
    links = edges.select(F.col("source_path").alias("space"), F.col("parent_key").alias("a"), F.col("child_key").alias("d"))
    pairs = reachable_pairs(links.where("a is not null and d is not null").distinct())
    return pairs.select(F.col("space").alias("source_path"), F.col("a").alias("ancestor"), F.col("d").alias("node"), F.col("far").alias("distance"))
