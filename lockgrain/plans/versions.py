"""Queries of the version orderings over package_rows, and of the lockfile parsers over lockfiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockgrain.functions.versions import SEMVER, compare_versions, rank_versions, version_key
from lockgrain.plans import version_sql
from lockgrain.session import table


def _versions(spark, d):
    return table(spark, d, "package_rows").where("name is not null and version is not null and ecosystem is not null").select("ecosystem", "name", "version").distinct()


def _ranked(*ecosystems):
    """Places of every version of the ecosystems' packages."""

    def query(spark, d):
        return rank_versions(_versions(spark, d).where(F.col("ecosystem").isin(*ecosystems))).select("ecosystem", "name", "version", "place")

    return query


def debian_sort(spark, d):
    """Places of every version of every package by Debian's rules, which order any text."""
    key = version_key(F.lit("Debian"), F.col("version"))
    rows = _versions(spark, d).withColumn("k", key)
    return rows.select("ecosystem", "name", "version", F.dense_rank().over(Window.partitionBy("ecosystem", "name").orderBy("k")).alias("place"))


def newest_versions(spark, d):
    """Newest version of each package by its ecosystem's ordering; of equal versions the larger text."""
    return rank_versions(_versions(spark, d)).groupBy("ecosystem", "name").agg(F.max_by("version", F.struct("place", "version")).alias("newest"))


def _compared(ordering, *ecosystems):
    """Order of each version and the next one of its package by text, by an ordering that compares pairs."""

    def query(spark, d):
        rows = _versions(spark, d).where(F.col("ecosystem").isin(*ecosystems)) if ecosystems else _versions(spark, d)
        both = rows.withColumn("next_version", F.lead("version").over(Window.partitionBy("ecosystem", "name").orderBy("version"))).where("next_version is not null")
        return both.withColumn("sign", compare_versions(F.lit(ordering), F.col("version"), F.col("next_version")))

    return query


def _named(name, f):
    f.__name__ = name
    return f


def parse_lock_tables(spark, d):
    """Packages of the raw lockfile contents, by the npm and conan parsers."""
    from lockgrain.sources.lockfiles import packages_of, parse_lockfiles

    rows = table(spark, d, "lockfiles").where("content is not null")
    name = F.when(F.col("parsed_as") == "conan-lock", "conan.lock").otherwise("package-lock.json")
    files = rows.select(F.concat(F.lit("/"), F.col("lock_id").cast("string"), F.lit("/"), name).alias("path"), F.regexp_replace("content", "^﻿", "").alias("text"))
    return packages_of(parse_lockfiles(files)).select(F.split("source_path", "/")[1].cast("long").alias("lock_id"), "name", "version", F.array_join("dep_groups", ",").alias("dep_groups"))


_SORTED = {"semver": SEMVER, "nuget": ("NuGet",), "cran": ("CRAN",), "pypi": ("PyPI",), "packagist": ("Packagist",), "rubygems": ("RubyGems",), "maven": ("Maven",)}
QUERIES = {
    **{f"{q}_sort": _named(f"{q}_sort", _ranked(*e)) for q, e in _SORTED.items()},
    "debian_sort": debian_sort,
    "newest_versions": newest_versions,
    "maven_compare": _named("maven_compare", _compared("Maven", "Maven")),
    "alpine_compare": _named("alpine_compare", _compared("Alpine")),
    "parse_lock_tables": parse_lock_tables,
}
SQL = {**version_sql.SORTS, "newest_versions": version_sql.NEWEST, "maven_compare": version_sql.MAVEN_COMPARE, "alpine_compare": version_sql.ALPINE_COMPARE}
