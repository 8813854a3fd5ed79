"""Mixing sources to target weights by Pareto order sampling.

Of each document an expected number of copies follows from its source's share of the mix: whole copies are certain, the
fraction left is its inclusion probability. Documents are ranked by the odds of a random number over the odds of their
inclusion, and taken in that order until the tokens that the source still lacks are filled: a sample of fixed size with
unequal probabilities. The random number comes from the document's id and a seed, so a rerun gives the same mix.

The order is never sorted as a whole: ranks fall into 2**16 bins per source, sums of tokens by bin find the bin in which
the sample ends, and only that bin is sorted.

Defined results: a source without a target or without tokens gets nothing, and the targets of the others are scaled to
sum to 1; a null source is no source; a document without tokens is never used; of repeated rows of one id each counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockgrain.session import cut_lineage

BINS = 1 << 16
FEW_SOURCES = 10_000  # sources up to which their table of one row each is broadcast


def _fit(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_SOURCES else df


def plan_sources(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, n_docs, weighted, share, need): what each source has to give.

    Without ``total`` the mix is as large as the targets allow: the source that first runs out of repeats bounds it.
    """
    have = docs.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("weight")).alias("weighted"))
    both = cut_lineage(targets.where("source is not null").select("source", "target_share", "max_repeats").join(have, "source", "full"))
    usable = both.where("tokens > 0 and target_share > 0 and max_repeats > 0")
    sums = usable.agg(F.sum("target_share").alias("share"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("most")).first()
    given, most = sums["share"] or 1.0, (sums["most"] or 0.0) * (sums["share"] or 1.0)
    size = most if total is None else min(total, most)
    ok = F.coalesce((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.lit(False))
    share = F.when(ok, F.col("target_share") / F.lit(given)).otherwise(0.0)
    return both.withColumn("share", share).withColumn("need", F.col("share") * F.lit(float(size)))


def expected_copies(docs: DataFrame, plan: DataFrame, n_sources: int, most_rounds: int = 30) -> DataFrame:
    """Adds need, cap and expected: copies of each document in proportion to its weight, at most max_repeats.

    Where the cap binds, what capped documents can't take goes to the others; each round is one aggregation by source.
    """
    plan = plan.where("need > 0").select("source", "need", F.col("max_repeats").alias("cap"), (F.col("need") / F.col("weighted")).alias("theta"))
    rows = docs.where("n_tokens > 0").join(_fit(plan, n_sources), "source")
    if docs.where("weight <> 1").isEmpty():
        return rows.withColumn("expected", F.least("cap", F.col("theta") * F.col("weight")))
    for _ in range(most_rounds):
        over = F.col("theta") * F.col("weight") >= F.col("cap")
        state = rows.groupBy("source").agg(
            F.first("need").alias("need"), F.first("cap").alias("cap"), F.first("theta").alias("theta"),
            F.sum(F.when(over, F.col("n_tokens") * F.col("cap")).otherwise(0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("n_tokens") * F.col("weight"))).alias("open"),
        )
        better = F.when(F.col("open") > 0, F.greatest("theta", (F.col("need") - F.col("full")) / F.col("open"))).otherwise(F.col("theta"))
        state = cut_lineage(state.withColumn("next", better))
        moved = not state.where("next > theta * (1 + 1e-9)").isEmpty()
        rows = docs.where("n_tokens > 0").join(_fit(state.select("source", "need", "cap", F.col("next").alias("theta")), n_sources), "source")
        if not moved:
            break
    return rows.withColumn("expected", F.least("cap", F.col("theta") * F.col("weight")))


def pareto_mix(docs: DataFrame, targets: DataFrame, seed: int = 1, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). ``docs`` has doc_id, source, n_tokens and optionally weight; ``targets`` source, target_share, max_repeats.

    mix: doc_id, source, n_tokens, copies (at least 1). shares: what was asked for and what was reached per source.
    """
    weight = F.col("weight").cast("double") if "weight" in docs.columns else F.lit(1.0)
    docs = cut_lineage(docs.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(weight, F.lit(0.0)).alias("weight")))
    plan = cut_lineage(plan_sources(docs, targets, total))
    n_sources = plan.count()
    rows = expected_copies(docs, plan, n_sources)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = rows.withColumn("whole", F.floor(F.col("expected") + 1e-12)).withColumn("chance", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    odds = lambda p: p / (1 - p)
    rank = F.when(F.col("chance") > 0, odds(u) / odds(F.col("chance")))
    rows = rows.withColumn("rank", rank / (1 + rank)).withColumn("bin", F.floor(F.col("rank") * BINS))
    rows = cut_lineage(rows.select("doc_id", "source", "n_tokens", "need", "whole", "rank", "bin"))

    certain = rows.groupBy("source").agg((F.first("need") - F.sum(F.col("whole") * F.col("n_tokens"))).alias("lack"))
    bins = rows.where("rank is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = bins.withColumn("filled", F.sum("tokens").over(upto)).join(certain, "source")
    last = filled.where("filled >= lack").groupBy("source").agg(F.min("bin").alias("last_bin"), F.min_by(F.col("filled") - F.col("tokens"), "bin").alias("before"))
    ends = cut_lineage(certain.join(last, "source", "left").select("source", "lack", F.coalesce("last_bin", F.lit(BINS)).alias("last_bin"), F.coalesce("before", F.lit(0)).alias("before")))
    marked = rows.join(_fit(ends, n_sources), "source")
    inside = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("bin = last_bin").withColumn("sum", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.withColumn("extra", F.when(F.col("sum") + F.col("n_tokens") / 2 <= F.col("lack"), 1).otherwise(0)).drop("sum")
    rest = marked.where("bin is null or bin <> last_bin").withColumn("extra", F.when(F.col("bin") < F.col("last_bin"), 1).otherwise(0))
    mix = rest.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")
    mix = cut_lineage(mix)
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    all_used = mix.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).first()["n"] or 0
    shares = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "tokens", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(max(1, all_used)))).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return mix, shares
