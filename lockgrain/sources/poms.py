"""Maven projects: poms joined with their parents to a fixed point, then resolved to packages and artifacts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.schema import ARTIFACT
from lockgrain.session import bound_batches, cut_lineage, replace_lineage
from lockgrain.sources.formats import maven
from lockgrain.sources.lockfiles import _ARROW, PARSED, base_name

POM = "path string, pom string, parent string, remote string, error string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("path", "pom", "parent", "remote", "error")}
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            try:
                pom = maven.decode(path, text or "")
                where = maven.parent_path(pom)
                row = (path, json.dumps(pom), where[0] if where else None, where[1] if where else None, None)
            except Exception as e:  # one bad file is an error row
                row = (path, None, None, None, f"{type(e).__name__}: {e}")
            for k, v in zip(out, row):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})


def decode_poms(files: DataFrame) -> DataFrame:
    """(path, pom, parent, remote, error) of (path, text)."""
    bound_batches(files.sparkSession)
    return files.select("path", "text").mapInArrow(_decode, POM)


def pom_chains(poms: DataFrame, repository: DataFrame | None = None) -> DataFrame:
    """(path, chain, parent_file): each pom with its parents, nearest first.

    Only paths travel while chains are found: a round joins each chain with the chain of the pom it ends at, so rounds
    grow with the logarithm of the longest chain; contents are joined once at the end. A parent met before ends a chain.

    ``repository``: (path, text) of poms by repository path (group/artifact/version/artifact-version.pom), for parents
    that no local file gives.
    """
    good = poms.where("pom is not null")
    known = good.select("path", "pom", "parent", "remote", F.lit(True).alias("own"))
    if repository is not None:
        far = decode_poms(repository.select(F.concat(F.lit(maven.REMOTE + "://"), "path").alias("path"), "text")).where("pom is not null")
        known = known.unionByName(far.select("path", "pom", "parent", "remote", F.lit(False).alias("own")))
    known = cut_lineage(known)
    paths = known.select("path")
    away = F.when(F.coalesce("remote", F.lit("")) != "", F.concat(F.lit(maven.REMOTE + "://"), "remote"))
    links = known.select("path", "parent", away.alias("away"), "own").join(paths.withColumnRenamed("path", "parent").withColumn("near", F.col("parent")), "parent", "left")
    links = links.join(paths.withColumnRenamed("path", "away").withColumn("far", F.col("away")), "away", "left")
    wanted = F.when(F.col("near").isNotNull() | F.col("away").isNull(), F.col("parent")).otherwise(F.col("away"))
    links = cut_lineage(links.select("path", "own", F.coalesce("near", "far").alias("next"), wanted.alias("parent_file")))

    chains = cut_lineage(links.select("path", F.array("path").alias("ids"), "next"))
    while not chains.where("next is not null").isEmpty():
        onward = chains.select(F.col("path").alias("next"), F.col("ids").alias("more"), F.col("next").alias("after"))
        both = F.concat("ids", F.coalesce("more", F.array().cast("array<string>")))
        ids = F.array_distinct(both)
        after = F.when(F.size(ids) == F.size(both), F.col("after"))
        chains = replace_lineage(chains.join(onward, "next", "left").select("path", ids.alias("ids"), after.alias("next")), chains)

    places = chains.join(links.where("own").select("path"), "path", "left_semi").select("path", F.posexplode("ids").alias("at", "id"))
    contents = places.join(known.select(F.col("path").alias("id"), "pom"), "id").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "pom"))).alias("found"))
    return contents.select("path", F.transform("found", lambda x: x["pom"]).alias("chain")).join(links.where("own").select("path", "parent_file"), "path")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, chain in zip(batch.column("path").to_pylist(), batch.column("chain").to_pylist()):
            rows = sorted(maven.packages([json.loads(c) for c in chain]), key=lambda r: (r["name"], r["version"]))
            out += [{**row, "source_path": path, "parser": "pom.xml"} for row in rows]
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _artifacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent = pa.struct([("name", pa.string()), ("version", pa.string()), ("filename", pa.string())])
    schema = pa.schema([("name", pa.string()), ("version", pa.string()), ("filename", pa.string()), ("ecosystem", pa.string()), ("depends_on", parent)])
    for batch in batches:
        rows = [maven.artifact([json.loads(c) for c in chain], file or "") for chain, file in zip(batch.column("chain").to_pylist(), batch.column("parent_file").to_pylist())]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def pom_packages(chains: DataFrame) -> DataFrame:
    return chains.select("path", "chain").mapInArrow(_resolve, PARSED)


def pom_artifacts(chains: DataFrame) -> DataFrame:
    return chains.select("chain", "parent_file").mapInArrow(_artifacts, ARTIFACT)


def pom_files(files: DataFrame) -> DataFrame:
    return files.where(base_name(F.col("path")) == "pom.xml").select("path", "text")
