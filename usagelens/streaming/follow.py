"""Streams over landed files, kept as journals.

A stream only takes rows over: each micro-batch appends what it read to a journal
in the shared folder, under its own number, so that a retried batch replaces
itself. Nothing is dropped on the way, whatever order files arrive in and however
many a batch takes. What a journal means - repeats, late rows, pairs, rates - is
worked out by the batch operators over it, so it does not depend on the batches.
``max_files`` is the back-pressure.

Journals and progress folders belong to the caller: a running service names and
keeps them; those of ``run_available`` may go when its result has been used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.functions import usage as U
from usagelens.operators.history import latest_per_key
from usagelens.session import new_path


def follow_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Rows of a file, or of a folder's files as they land."""
    # A stream takes a plain path for a folder; a pattern that only this path matches may be a file.
    path = f"{path[:-1]}[{path[-1]}]" if path[-1:].isalnum() else path
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def follow_requests(spark: SparkSession, path: str, started_at: int, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New successful proxy rows since the start; repeats are left to ``first_arrivals``."""
    rows = follow_files(spark, path, "host string, " + schemas.REQUESTS, fmt, max_files)
    return rows.where(
        (F.col("created_at") >= started_at)
        & (F.coalesce("data_source", F.lit("proxy")) == "proxy")
        & U.success()
        & U.usable_identity(F.col("request_id")).isNotNull()
    )


def follow_trace(spark: SparkSession, path: str, started_at: float, max_files: int = 100) -> DataFrame:
    """Activity of usable sessions from a landed trace table."""
    schema = "id bigint, ts bigint, ts_nanos bigint, target string, thread_id string"
    rows = follow_files(spark, path, schema, max_files=max_files)
    stamp = F.col("ts") + F.col("ts_nanos") / 1e9
    # Fixed value: the trace target that shows a response being read.
    seen = (F.col("target") == "codex_core::stream_events_utils") & U.usable_identity(F.col("thread_id")).isNotNull()
    return rows.where(seen & F.col("ts_nanos").between(0, 999999999) & (stamp >= started_at)).select(
        U.opaque_identity(F.lit("codex"), F.col("thread_id")).alias("session_key"), stamp.alias("stamp")
    )


def append_available(
    stream: DataFrame, journal: str, progress: str, mode: str = "append", reduce: Callable[[DataFrame], DataFrame] | None = None
) -> list:
    """Append what is there now to a journal; the next call goes on from there. Returns the progress of its batches.

    ``reduce`` makes a batch's rows fewer before they are written. In ``update`` mode each batch holds the new values of the keys it changed, and
    ``corrected`` reads the newest of each.
    """
    spark = stream.sparkSession
    # An empty part first, so that a stream without files reads as an empty table.
    empty = spark.createDataFrame([], stream.schema)
    (reduce(empty) if reduce else empty).write.mode("overwrite").parquet(f"{journal}/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        (reduce(batch) if reduce else batch).write.mode("overwrite").parquet(f"{journal}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def read_journal(spark: SparkSession, journal: str, like: DataFrame) -> DataFrame:
    """The journal's rows with the number of the batch that brought them."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    return spark.read.schema(f"{kinds}, batch int").option("basePath", journal).parquet(journal)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and read the journal back."""
    journal = new_path(stream.sparkSession, name)
    append_available(stream, journal, new_path(stream.sparkSession, name + "-progress"), mode)
    return read_journal(stream.sparkSession, journal, stream)


def follow_journal(journal: str, like: DataFrame, max_files: int = 1000) -> DataFrame:
    """A journal as the input of another stream: each batch's rows once."""
    spark = like.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    rows = spark.readStream.schema(f"{kinds}, batch int").option("basePath", journal).option("maxFilesPerTrigger", max_files)
    return rows.parquet(journal).drop("batch")


def first_within(requests: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key, with state for keys of the last ``delay`` only.

    Repeats further apart than that, and rows that come later than that, are not told
    from the rest here: ``left_behind`` finds them in the journal of all rows.
    """
    timed = requests.withColumn("_clock", F.timestamp_seconds(time)).withWatermark("_clock", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_clock")


def left_behind(journal: DataFrame, once: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a journal whose key no first row has: they fell behind the watermark."""
    return journal.join(once.select(*keys).distinct(), keys, "left_anti")


def first_arrivals(journal: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per key, the first to arrive; of several at one time the smallest by its other columns.

    Batch numbers do not count, so the choice is the same however files were cut.
    """
    rest = [c for c in journal.columns if c not in (*keys, arrival, "batch")]
    rows = journal.groupBy(*keys).agg(F.min(F.struct(arrival, *rest)).alias("_row"))
    return rows.select(*keys, "_row.*").select(*[c for c in journal.columns if c != "batch"])


def split_late(samples: DataFrame, limit_s: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Samples in time, and those whose end was older than the limit on arrival."""
    late = F.col("received_at") - F.col("end") > limit_s
    return samples.where(~late), samples.where(late)


def corrected(journal: DataFrame, keys: list[str]) -> DataFrame:
    """The newest value per key of a journal."""
    return latest_per_key(journal, keys, "batch").drop("batch")
