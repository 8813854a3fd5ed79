"""Session helpers: a local session for tests and tools, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lockgrain") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOCKGRAIN_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder the cluster names in spark.checkpoint.dir, which every executor shares.

    Only where neither the context nor the session names one (tests on one machine) a temporary folder is made, and
    removed when the process ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lockgrain-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def replace_lineage(df: DataFrame, old: DataFrame | None) -> DataFrame:
    """cut_lineage(df), then the files of ``old``, a checkpoint that only df was made from, are deleted: rounds of an
    iteration hold one state on disk, not all.

    The result has no size estimate. A checkpoint takes over the estimate of its plan, and where each round joins the
    state with itself that number has twice the digits every time, until computing it takes longer than the data.
    """
    spark = df.sparkSession
    new = cut_lineage(df)
    plan = old._jdf.queryExecution().analyzed() if old is not None else None
    if plan is not None and plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    rows = new._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, new._jdf.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Bounds the bytes of one Arrow batch, so a batch of very long texts fits into a worker; a set bound stays."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) < 2**31 - 1:
        spark.conf.set(BATCH_BYTES, str(most))
