"""Filters, projections and aggregations of the inventory: sanitize, package URLs, metadata, grouping and merging.

All are column expressions and aggregations with map-side combining; rows without the needed values are given to a side
table with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockgrain.functions.devgroup import is_dev_group
from lockgrain.functions.purl import has_purl, purl


def is_ranged(version: Column) -> Column:
    """A version with ',', '>' or '<' is a range; null is none."""
    return F.coalesce(version.rlike("[,><]"), F.lit(False))


def drop_ranged(packages: DataFrame) -> DataFrame:
    return packages.where(~is_ranged(F.col("version")))


def with_purl(packages: DataFrame) -> DataFrame:
    """Sets purl; null where none can be made."""
    return packages.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))


def sanitize(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows with purl, dropped rows with reason): ranged versions and packages without a package URL go."""
    reason = F.when(is_ranged(F.col("version")), "ranged version").when(~has_purl(F.col("ecosystem"), F.col("name")), "no package url")
    judged = packages.withColumn("reason", reason)
    return with_purl(judged.where("reason is null").drop("reason")), judged.where("reason is not null")


def direct_purls(packages: DataFrame) -> DataFrame:
    """Distinct package URLs of direct packages."""
    return packages.where("is_direct and purl is not null").select("purl").distinct()


def base_metadata(packages: DataFrame) -> Column:
    """Map of package-manager (unless Unknown or blank), is-direct and is-dev; keys without a value are left out."""
    manager = F.when(~F.coalesce("package_manager", F.lit("")).isin("", "Unknown"), F.col("package_manager"))
    true = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("true"))
    names = ("package-manager", "is-direct", "is-dev")
    values = (manager, true(F.col("is_direct")), true(is_dev_group(F.col("ecosystem"), F.col("dep_groups"))))
    full = F.create_map(*(x for k, v in zip(names, values) for x in (F.lit(k), v)))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def with_metadata(packages: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """Adds metadata and advisories. ``reachable``: purl, advisories array, locations map<advisory id, JSON>.

    Only direct packages get reachable symbol locations; every package of a checked purl gets its advisories.
    """
    out = packages.withColumn("metadata", base_metadata(packages))
    if reachable is None:
        return out.withColumn("advisories", F.array().cast("array<string>"))
    joined = out.join(reachable, "purl", "left")
    symbols = F.transform_keys(F.coalesce("locations", F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("reachable-symbol-location:"), k))
    return joined.withColumns(
        {"metadata": F.when(F.coalesce("is_direct", F.lit(False)), F.map_concat("metadata", symbols)).otherwise(F.col("metadata")), "advisories": F.coalesce("advisories", F.array().cast("array<string>"))}
    ).drop("locations")


def identify(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be reported, rows that can't): ecosystem and name, or else a commit, which becomes version of GIT."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    named = ~blank(F.col("ecosystem")) & ~blank(F.col("name"))
    commit = ~named & ~blank(F.col("commit"))
    out = packages.withColumns(
        {"name": F.when(named, F.col("name")).otherwise(F.lit("")), "ecosystem": F.when(commit, "GIT").otherwise(F.col("ecosystem")), "version": F.when(commit, F.col("commit")).otherwise(F.col("version"))}
    )
    return out.where(named | commit), packages.where(~(named | commit))


def group_by_source(packages: DataFrame, *columns: str) -> DataFrame:
    """One row per source: its packages as a sorted array of structs of the given columns.

    This is the nested form of the result document; use it where a source's packages fit one row.
    """
    return packages.groupBy("source_path").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("packages"))


def merge_by_purl(packages: DataFrame, order: Column | None = None, strict: bool = False, locations: bool = False) -> DataFrame:
    """One row per package URL: union of groups and merged metadata; with ``locations`` also the list of its places.

    The list gathers all rows of a purl into one, as the result document needs it; over large tables leave it out and
    keep the places as rows.

    A package is dev only if all its rows are, direct if one is; of other metadata the first row's value counts.
    ``strict`` keeps the is-dev key only if the first row has it and every later row is direct, as a fold in order does.
    Rows without a purl are left out. Without locations the state per purl is small: its distinct groups and flags.
    """
    at = order if order is not None else F.struct("source_path", "name", "version")
    rows = packages.where("purl is not null").withColumns({"__at": at, "__dev": is_dev_group(F.col("ecosystem"), F.col("dep_groups"))})
    aggs = [
        F.min_by(F.struct("name", "version", "ecosystem"), "__at").alias("package"),
        F.count("*").alias("n_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("dep_groups")))).alias("dep_groups"),
        F.bool_or(F.coalesce("is_direct", F.lit(False))).alias("is_direct"),
        F.bool_and("__dev").alias("is_dev"),
        F.min_by("package_manager", F.when(F.col("package_manager").isNotNull(), F.col("__at"))).alias("package_manager"),
    ]
    if locations:
        aggs += [F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct(F.col("__at").alias("at"), "block", "name_loc", "version_loc")))), lambda x: F.struct(x["block"], x["name_loc"], x["version_loc"])).alias("locations")]
    if strict:
        first = F.min(F.struct(F.col("__at"), F.col("__dev"), F.coalesce("is_direct", F.lit(False)).alias("direct"))).alias("__first")
        aggs += [first, F.sum(F.coalesce("is_direct", F.lit(False)).cast("long")).alias("__directs")]
    out = rows.groupBy("purl").agg(*aggs)
    if strict:  # a fold drops is-dev at the first row after the first that isn't direct
        later = F.col("__directs") - F.col("__first.direct").cast("long")
        out = out.withColumn("is_dev", F.col("__first.__dev") & (later == F.col("n_rows") - 1)).drop("__first", "__directs")
    return out.select("purl", "package.*", "n_rows", "dep_groups", "is_direct", "is_dev", "package_manager", *(["locations"] if locations else []))


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of rows with one key the last in order, as one map-side combined maximum."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("__last")).select(*key, "__last.*")


def ecosystems(packages: DataFrame) -> DataFrame:
    return packages.where("ecosystem is not null").select("ecosystem").distinct().orderBy("ecosystem")


def sorted_packages(packages: DataFrame) -> DataFrame:
    """By name, then version, in byte order."""
    return packages.orderBy("name", "version")


def render_lines(packages: DataFrame) -> DataFrame:
    """(line): 'ecosystem: name@version (commit)', parts without a value left out."""
    tail = F.when(F.coalesce("commit", F.lit("")) != "", F.concat(F.lit(" ("), F.col("commit"), F.lit(")"))).otherwise(F.lit(""))
    return packages.select(F.concat(F.coalesce("ecosystem", F.lit("")), F.lit(": "), F.coalesce("name", F.lit("")), F.lit("@"), F.coalesce("version", F.lit("")), tail).alias("line"))


def id_rank(identifier: Column) -> Column:
    """CVE first, GHSA last, all others between; equal ranks go by text."""
    prefix = F.substring_index(identifier, "-", 1)
    return F.when(prefix == "CVE", 0).when(prefix == "GHSA", 2).otherwise(1)


def pluralize(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, one).otherwise(many)
