"""Reading back what the sinks wrote: exports, archive and minute journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.functions.usage import UNKNOWN_HOUR
from usagelens.operators import archive, history, quality


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One exported table with its types; session hours become a map again."""
    if name == "session_daily_usage":
        schema = schemas.SESSION_DAILY.replace("hours map<string,bigint>", "hours string")
        rows = spark.read.csv(f"{path}/{name}", schema=schema, header=True)
        rows = rows.fillna("", ["project_key", "project_name", "session_title"])
        return rows.withColumn("hours", F.from_json(F.coalesce("hours", F.lit("{}")), "map<string,bigint>"))
    known = {
        "daily_usage": schemas.DAILY,
        "hourly_usage": schemas.HOURLY,
        "response_speed": schemas.RESPONSES,
        "request_tps": schemas.REQUEST_TPS,
    }
    rows = spark.read.csv(f"{path}/{name}", schema=known[name], header=True)
    # CSV does not tell an empty label from a missing one.
    return rows.fillna("", ["duration_source"]) if name == "response_speed" else rows


def read_archive(spark: SparkSession, path: str, identities: DataFrame | None = None) -> DataFrame:
    """Checked archive entries, of sources that still have their identity."""
    rows = spark.read.schema(schemas.ARCHIVE).parquet(path)
    rules = {k: v for k, v in quality.archive_rules().items() if k not in ("app", "model")}
    rules["source_identity"] = F.col("source_identity").rlike("^[0-9a-f]{64}$")
    checked = quality.strict(rows, rules, "daily archive")
    return checked if identities is None else archive.selected(checked, identities)


def startup_rows(entries: DataFrame) -> DataFrame:
    """Archived usage for a first view: all of it under the unknown hour."""
    return entries.where("app IS NOT NULL").select(*archive.ROW).withColumn("hour", F.lit(UNKNOWN_HOUR))


def read_minutes(spark: SparkSession, path: str, now: float) -> DataFrame:
    """The last record per minute within the retention, checked."""
    rows = spark.read.schema(schemas.MINUTES + ", sequence bigint, day date").parquet(path)
    checked = quality.strict(rows, quality.minute_rules(), "meter history record")
    return history.latest_per_key(
        checked, ["series", "day_only", "minute"], "sequence", history.retention_cutoff(now)
    ).drop("day")
