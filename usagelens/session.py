"""Session settings and the shared folder used for lineage cuts and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change plans, not results. AQE may split skewed join partitions
# even where that costs one more exchange.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Building a plan is faster without a Python call site on every column.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "usagelens", master: str | None = None, **extra: str) -> SparkSession:
    """Create or get a session with the library's settings.

    ``extra`` holds cluster sizing, for example shuffle partitions; keys use
    ``__`` in place of dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may fall back to its own temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder; nothing is deleted or reused."""
    return f"{shared_dir(spark)}/usagelens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Used where several outputs need one expensive input: the files survive lost
    executors, unlike cached blocks. ``files`` is for a table known to be small:
    without Hadoop's native code each file's mode is set by a forked process.
    """
    path = new_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
