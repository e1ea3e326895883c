"""Exports, archive, journals and public views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators import archive, history
from usagelens.session import materialize

# Columns a public view may show; ids of requests, sessions and providers are not among them.
PUBLIC = {
    "rows": ("date", "host", "app", "model", "cost_usd", "tokens", "requests"),
    "hourly_rows": ("date", "hour", "host", "app", "model", "cost_usd", "tokens", "requests"),
    "session_rows": (
        "date", "host", "app", "session_key", "model", "cost_usd", "session_title", "hours", "project_key",
        "project_name", "requests", "fresh_input_tokens", "cache_read_tokens", "cache_creation_tokens",
        "output_tokens", "tokens", "tps_count", "tps_sum", "tps_max", "native_tps_count", "native_tps_sum", "native_tps_max",
    ),
    "response_rows": (
        "date", "hour", "host", "app", "model", "duration_source", "output_tokens", "duration_ms", "tps", "first_token_ms",
    ),
}
PRIVATE = ("session_id", "request_id", "provider_id", "cwd")


def public_view(df: DataFrame, view: str) -> DataFrame:
    """The columns a view may show, and no others."""
    named = df.withColumnRenamed("total_tokens", "tokens")
    shown = named.select(*PUBLIC[view])
    leaked = sorted(set(shown.columns) & set(PRIVATE))
    if leaked:
        raise ValueError(f"Private columns in a public view: {', '.join(leaked)}")
    return shown


def write_exports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header; maps as JSON with sorted keys. An empty table leaves no rows."""
    for name, df in tables.items():
        for column, kind in df.dtypes:
            if kind.startswith("map"):
                entries = F.array_sort(F.map_entries(column))
                df = df.withColumn(column, F.to_json(F.map_from_entries(entries)))
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_summary(totals: DataFrame, audit: DataFrame, models: DataFrame, hosts: DataFrame, path: str) -> None:
    """One JSON document; its lists are as short as there are hosts and models."""

    def rows(df: DataFrame):
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("list")).scalar()

    summary = totals.withColumns({"sources": rows(audit), "by_model": rows(models), "by_host_app": rows(hosts)})
    summary.write.mode("overwrite").json(path)


def write_archive(fresh: DataFrame, covered: DataFrame, sources: DataFrame, old: DataFrame, path: str) -> None:
    """Rewrite the days that changed, each as a whole; other days are not touched."""
    entries = archive.next_archive(fresh, covered, sources, old)
    days = archive.changed_days(entries, old)
    # Written apart first: the days replaced below are also being read.
    content = materialize(entries.join(days, "date", "left_semi"), "archive-days")
    content.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date"
    ).parquet(path)


def append_minutes(rows: DataFrame, sequence: int, path: str) -> None:
    """Add minute records to the journal; a higher sequence wins on reading."""
    day = F.date_from_unix_date(F.floor(F.col("minute") / 86400).cast("int"))
    rows.withColumns({"sequence": F.lit(sequence).cast("bigint"), "day": day}).write.mode("append").partitionBy("day").parquet(path)


def compact_minutes(journal: DataFrame, path: str, now: float) -> None:
    """Write the last record per minute within the retention to a new folder."""
    kept = history.latest_per_key(
        journal, ["series", "day_only", "minute"], "sequence", history.retention_cutoff(now) - 86400
    )
    kept.repartition("day").write.mode("errorifexists").partitionBy("day").parquet(path)

