"""Session helpers: where shared intermediate results live and how a job is set up."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even when that costs one more exchange above
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # most that is merged into one task of a shuffle: sorts and hash tables of a task take some twenty times as much
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # and most of a file for one task, whose first aggregate holds as many groups as it reads rows where keys hardly repeat
    "spark.sql.files.maxPartitionBytes": "32m",
}

#: Bytes of an input file for which a shuffle starts with one partition; small ones are merged as it runs.
INPUT_BYTES = 8 << 20
#: Whether shuffle files are deleted when the action that wrote them ends; otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on."""
    for key, value in _SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def fit_shuffles(spark: SparkSession, path: str) -> None:
    """Let shuffles start with partitions in proportion to the table at ``path``, the largest one so far.

    A fixed number of partitions would make each of them, and the memory of its task, grow with the input.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0), math.ceil(size / INPUT_BYTES))
    spark.conf.set(_INITIAL, str(wanted))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only on one machine (a local master) may that be
    unset: a fresh folder is made and remembered for the session.  Elsewhere every executor would write
    to its own disk and rows would be missing, so this raises instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.ledgerlift.sharedDir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.ledgerlift.sharedDir", configured)
    return configured.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/ledgerlift-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what this application staged; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing the plan), pins
    values that must not change between two reads, and gives the optimizer true sizes, so that
    later joins broadcast only what is really small.  The shuffle files behind it are deleted, so that a long job
    needs disk for the largest of its steps, not for all of them.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
