"""Lockfiles that arrive over time: a folder as a stream of parsed packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.sources.files import decoded, plain_path
from lockgrain.sources.lockfiles import PARSED, _parse, enabled


def stream_packages(spark: SparkSession, folder: str, parsers: list[str] | None = None, per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of parsed rows of new lockfiles below a folder.

    Each file is parsed once, on its own; manifests and parents need the batch scan. Only stateless steps are used, so
    any sink and trigger works and a restart goes on from the checkpoint.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    files = raw.select(plain_path(F.col("path")).alias("path"), decoded(F.col("content")).alias("text"))
    wanted = enabled(files, parsers).where("parser <> 'pom.xml'").select("path", "text", "parser", F.lit(None).cast("array<struct<kind:string,file:string,manifest:string>>").alias("manifests"))
    return wanted.mapInArrow(_parse, PARSED)
