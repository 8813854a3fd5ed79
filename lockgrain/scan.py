"""From a source tree to an inventory: files, packages, sanitizing, reachability, grouping, documents."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.operators import inventory, reach
from lockgrain.session import cut_lineage
from lockgrain.sinks import cyclonedx
from lockgrain.sources import files as source_files
from lockgrain.sources import lockfiles, poms

log = logging.getLogger("lockgrain")


class NoPackagesFound(Exception):
    """No file gave any package."""


class APIFailed(Exception):
    """A remote source that is required could not be read."""


@dataclass(frozen=True)
class ScanOptions:
    paths: tuple[str, ...]
    recursive: bool = True
    ignore: bool = True
    parsers: tuple[str, ...] = ()
    reachability: bool = False
    advisories: DataFrame | None = None  # ADVISORY rows
    ask_advisories: Callable[[SparkSession, DataFrame], DataFrame] | None = None  # (session, purls) to ADVISORY rows, where there is no table
    require_advisories: bool = False  # raise APIFailed if they can't be had; else the scan goes on without reachability
    pom_repository: DataFrame | None = None  # (path, text) of poms that no local file gives


@dataclass
class ScanResult:
    packages: DataFrame  # kept rows with purl, metadata and advisories
    dropped: DataFrame  # rows that can't be reported, with a reason
    artifacts: DataFrame
    edges: DataFrame
    errors: DataFrame
    reachable: DataFrame | None = field(default=None)


def _relativize(df: DataFrame, root: str, *columns: str) -> DataFrame:
    out = df
    for c in columns:
        kind = dict(df.dtypes)[c]
        if kind == "string":
            out = out.withColumn(c, source_files.relative_to(F.col(c), root))
        else:
            name = "file_name" if "file_name" in kind else "filename"
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).withField(name, source_files.relative_to(F.col(f"{c}.{name}"), root))))
    return out


def _one_root(spark: SparkSession, root: str, options: ScanOptions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    import os

    files = source_files.read_tree(spark, root, options.recursive, options.ignore)
    parsed = lockfiles.with_included(files, lockfiles.parse_lockfiles(files, list(options.parsers) or None))
    packages = lockfiles.packages_of(parsed).drop("children")
    edges, errors = lockfiles.edges_of(parsed), lockfiles.errors_of(parsed)
    if not options.parsers or "pom.xml" in options.parsers:
        decoded = cut_lineage(poms.decode_poms(poms.pom_files(files)))
        chains = poms.pom_chains(decoded, options.pom_repository)
        packages = packages.unionByName(poms.pom_packages(chains).drop("children", "error", "includes"))
        artifacts = poms.pom_artifacts(chains)
        errors = errors.unionByName(decoded.where("error is not null").select("path", F.lit("pom.xml").alias("parser"), F.col("error").alias("message")))
    else:
        artifacts = spark.createDataFrame([], "name string, version string, filename string, ecosystem string, depends_on struct<name:string,version:string,filename:string>")
    base = os.path.dirname(os.path.abspath(root)) if os.path.isfile(root) else os.path.abspath(root) if os.path.exists(root) else re.sub("^file:/+", "/", root)
    return (
        _relativize(packages, base, "source_path", "block", "name_loc", "version_loc"),
        _relativize(artifacts, base, "filename", "depends_on"),
        _relativize(edges, base, "source_path"),
        _relativize(errors, base, "path"),
    )


def _advisories(spark: SparkSession, options: ScanOptions, packages: DataFrame) -> DataFrame | None:
    """ADVISORY rows from the table or the service given; None, with a warning, if there are none to be had."""
    if options.advisories is not None:
        return options.advisories
    try:
        if options.ask_advisories is None:
            raise ValueError("neither a table nor a service of advisories is given")
        return options.ask_advisories(spark, inventory.direct_purls(packages))
    except (OSError, ValueError) as e:
        if options.require_advisories:
            raise APIFailed(f"advisories: {e}") from e
        log.warning("advisories: %s; going on without reachability", e)
        return None


def scan(spark: SparkSession, options: ScanOptions) -> ScanResult:
    """Reads all paths. Raises NoPackagesFound if no file gives a package."""
    parts = [_one_root(spark, p, options) for p in options.paths]
    packages, artifacts, edges, errors = parts[0]
    for more in parts[1:]:
        packages, artifacts, edges, errors = (a.unionByName(b) for a, b in zip((packages, artifacts, edges, errors), more))
    packages = cut_lineage(packages)
    if packages.isEmpty():
        raise NoPackagesFound
    good, dropped = inventory.sanitize(packages)
    good, nameless = inventory.identify(good)
    dropped = dropped.unionByName(nameless.withColumn("reason", F.lit("no name, ecosystem or commit")).drop("purl"))
    reachable = None
    advisories = _advisories(spark, options, good) if options.reachability else None
    if advisories is not None:
        known = reach.checked_advisories(inventory.direct_purls(good), advisories)
        java = [source_files.read_tree(spark, p, options.recursive, False) for p in options.paths]
        sites = reach.java_call_sites(java[0])
        for j in java[1:]:
            sites = sites.unionByName(reach.java_call_sites(j))
        hits = cut_lineage(reach.detect(known, sites))
        reachable = cut_lineage(reach.pivot(known, hits))
        extra = reachable.join(reach.reachable_symbols(hits), "purl", "left").select("purl", "advisories", "locations")
        good = inventory.with_metadata(good, extra)
    else:
        good = inventory.with_metadata(good)
    return ScanResult(cut_lineage(good), dropped, artifacts, edges, errors, reachable)


def merged_packages(result: ScanResult) -> DataFrame:
    """Packages merged by purl with metadata and locations, as the documents need them."""
    merged = inventory.merge_by_purl(result.packages, F.struct("source_path", "name", "version", "block"), locations=True)
    symbols = result.packages.select("purl", F.explode(F.map_filter("metadata", lambda k, v: F.startswith(k, F.lit(cyclonedx.REACHABLE)))).alias("k", "v")).groupBy("purl", "k").agg(F.min("v").alias("v"))
    extra = symbols.groupBy("purl").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("symbols"))
    out = merged.join(extra, "purl", "left")
    flag = lambda c: F.when(F.col(c), F.lit("true"))
    manager = F.when(~F.coalesce("package_manager", F.lit("")).isin("", "Unknown"), F.col("package_manager"))
    base = F.map_filter(F.create_map(F.lit("package-manager"), manager, F.lit("is-direct"), flag("is_direct"), F.lit("is-dev"), flag("is_dev")), lambda k, v: v.isNotNull())
    return out.withColumn("metadata", F.map_concat(base, F.coalesce("symbols", F.create_map().cast("map<string,string>")))).drop("symbols")


def to_cyclonedx(spark: SparkSession, result: ScanResult | None, records: DataFrame | None = None, **prefixes: str) -> dict:
    """The CycloneDX document of a scan; of nothing, an empty one.

    ``records``: PackageVulns rows. Those of the scan's packages are described in the document, ahead of what
    reachability says of the same id.
    """
    if result is None:
        return {"$schema": cyclonedx.SCHEMA, "bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "components": [], "dependencies": [], "vulnerabilities": []}
    merged = cut_lineage(merged_packages(result))
    components = cyclonedx.library_components(merged, **prefixes).unionByName(cyclonedx.file_components(result.artifacts))
    places = merged.select("name", "version", F.explode("locations").alias("l")).select("name", "version", F.col("l.block.file_name").alias("file"))
    edges = cyclonedx.dependency_edges(places, result.artifacts)
    vulns = reach.affected_purls(result.reachable).select(F.col("advisory_id").alias("id"), "affects") if result.reachable is not None else spark.createDataFrame([], "id string, affects array<string>")
    if records is not None:
        own = records.join(result.packages.select(F.col("purl").alias("__purl")).distinct(), records["package.purl"] == F.col("__purl"), "left_semi")
        told = cyclonedx.vulnerability_rows(own)
        vulns = told.unionByName(vulns.join(told.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return cyclonedx.document(components, edges, vulns)


def write_json_lines(result: ScanResult, path: str) -> None:
    """The packages as JSON Lines, one package a line, written by the executors: nothing passes through the driver."""
    cols = ["source_path", "name", "version", "ecosystem", "purl", "dep_groups", "block", "name_loc", "version_loc", "metadata", "advisories"]
    result.packages.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def to_json(result: ScanResult | None) -> dict:
    """The result grouped by source, as plain JSON."""
    if result is None:
        return {"results": [], "artifacts": []}
    cols = ["name", "version", "ecosystem", "purl", "dep_groups", "block", "name_loc", "version_loc", "advisories"]
    rows = result.packages.select("source_path", F.struct(*cols).alias("p"), F.col("metadata"))
    grouped: dict[str, list] = {}
    for r in rows.orderBy("source_path", "p.name", "p.version").toLocalIterator():
        p = r["p"].asDict(recursive=True)
        info = {k: p[k] for k in ("name", "version", "ecosystem", "purl") if p[k]}
        place = {k: p[c] for k, c in (("block", "block"), ("name", "name_loc"), ("version", "version_loc")) if p[c]}
        grouped.setdefault(r["source_path"], []).append({"package": info, "dependency_groups": p["dep_groups"], "locations": [place] if place else [], "metadata": r["metadata"], "advisories": p["advisories"]})
    artifacts = [json.loads(x) for x in (r[0] for r in result.artifacts.orderBy("filename").select(F.to_json(F.struct(*result.artifacts.columns))).toLocalIterator())]
    return {"results": [{"source": {"path": s}, "packages": p} for s, p in grouped.items()], "artifacts": artifacts}
