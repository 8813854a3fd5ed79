"""Per-key results where a few keys hold most rows: aggregate before joining, never join raw rows.

Each input is first reduced to one compact state per key (partial sums combine on the map side, so a key with a third
of all rows leaves every task as a single row). The states are joined, counts are multiplied and sums scaled by the
other side's count, and only then are results rolled up to coarser groups. No salting is needed: after the first
reduction no key has more than one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, on: Sequence[str], sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """One row per key: n (rows), the named sums, and the number of distinct non-null values of the named columns.

    Distinct values are counted in two steps: first per (key, value), which spreads a hot key over all tasks by its
    values, then per key; rows and sums come along, so the input is read once. Keys with a null part are left out, as an
    inner join would.
    """
    sums, distinct = sums or {}, distinct or {}
    kept = df.dropna(subset=list(on))
    state = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())]
    if not distinct:
        return kept.groupBy(*on).agg(*state)
    (name, column), *more = distinct.items()
    if more:
        raise ValueError("one distinct count per call; join the states of several calls")
    fine = kept.groupBy(*on, F.col(column).alias("__value")).agg(*state)
    up = [F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums), F.count("__value").alias(name)]
    return fine.groupBy(*on).agg(*up)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    roll_up: Sequence[str] | None = None,
    keep_left: bool = False,
) -> DataFrame:
    """What ``left JOIN right USING (on) GROUP BY roll_up`` gives for counts and sums, without making the joined rows.

    Columns: the group, n_left and n_right (rows of either side that take part), n_pairs (joined rows), and each sum
    over the joined rows. ``keep_left`` makes it a left join: keys without a partner have n_right and n_pairs 0 and
    right sums null. Sums of nulls only are null; an empty side gives an empty result (or the left keys).
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    a = key_states(left, on, left_sums).withColumnRenamed("n", "n_left")
    b = key_states(right, on, right_sums).withColumnRenamed("n", "n_right")
    both = a.join(b, list(on), "left" if keep_left else "inner")
    other = F.coalesce("n_right", F.lit(0))
    scaled = both.select(
        *on,
        "n_left",
        other.alias("n_right"),
        (F.col("n_left") * other).alias("n_pairs"),
        *((F.col(k) * F.greatest(other, F.lit(1)) if keep_left else F.col(k) * other).alias(k) for k in left_sums),
        *((F.col(k) * F.col("n_left")).alias(k) for k in right_sums),
    )
    if roll_up is None or list(roll_up) == list(on):
        return scaled
    return scaled.groupBy(*roll_up).agg(*(F.sum(c).alias(c) for c in ("n_left", "n_right", "n_pairs", *left_sums, *right_sums)))


def join_states(rows: DataFrame, members: DataFrame, on: Sequence[str], member: str) -> DataFrame:
    """Per key the rows of one input and the distinct members of the other: n_rows, n_members.

    Both inputs are reduced to one state per key first; the join then meets one row with one row.
    """
    a = key_states(rows, on).withColumnRenamed("n", "n_rows")
    b = key_states(members, on, distinct={"n_members": member}).drop("n")
    return a.join(b, list(on), "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))
