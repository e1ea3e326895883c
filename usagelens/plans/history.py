"""Registered queries over the archive, the minute history and receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators import archive, facts, history, live
from usagelens.plans.columns import flat
from usagelens.plans.usage import Usage
from usagelens.session import materialize
from usagelens.sources import adapters

# The moment usage history is read at: noon of 30 June 1998.
NOW = 899208000
EVENT_NOW = 2842020.0
HOUR = 3600


def archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flat(archive.archive_rows(Usage(spark, sf).daily))


def _collection(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fresh rows of h0 and h1 without every fifth day, their covered days, sources and an old archive."""
    rows = archive.archive_rows(Usage(spark, sf).daily)
    fifth = F.unix_date("date") % 5 == 0
    here = F.col("host").isin("h0", "h1")
    fresh = rows.where(here & ~fifth)
    covered = rows.where(here & ((F.unix_date("date") % 10 == 0) | ~fifth)).select("date", "host").distinct()
    hosts = spark.range(3).select(
        F.concat(F.lit("h"), F.col("id")).alias("host"),
        F.sha2(F.concat(F.lit("settings-h"), F.col("id")), 256).alias("source_identity"),
        F.lit("2001-12-01").cast("timestamp").alias("collected_at"),
        F.lit("UTC").alias("host_timezone"),
    )
    stale_identity = (F.col("host") == "h2") & (F.unix_date("date") % 3 == 0)
    saved = rows.where("host <> 'h9'").withColumns(
        {
            "tokens": F.col("tokens") + F.when(F.unix_date("date") % 4 == 0, 1).otherwise(0),
            "source_identity": F.when(stale_identity, F.lit("old")).otherwise(
                F.sha2(F.concat(F.lit("settings-"), F.col("host")), 256)
            ),
            "collected_at": F.lit("2001-11-30").cast("timestamp"),
            "timezone": F.lit("UTC"),
        }
    )
    return fresh, covered, hosts, saved


def archive_merge(spark: SparkSession, sf: str) -> DataFrame:
    fresh, covered, hosts, saved = _collection(spark, sf)
    return flat(archive.merge_archive(fresh, covered, archive.selected(saved, hosts)))


def archive_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Archived usage as the hourly view shows it, per host and day."""
    fresh, covered, hosts, saved = _collection(spark, sf)
    rows = archive.archived_hours(archive.merge_archive(fresh, covered, archive.selected(saved, hosts)))
    return rows.groupBy("date", "hour", "host").agg(F.sum("tokens").alias("tokens"))


def archive_next(spark: SparkSession, sf: str) -> DataFrame:
    fresh, covered, hosts, saved = _collection(spark, sf)
    entries = archive.next_archive(fresh, covered, hosts.where("host <> 'h2'"), saved)
    return flat(entries.drop("collected_at", "timezone"))


def archive_changed_days(spark: SparkSession, sf: str) -> DataFrame:
    fresh, covered, hosts, saved = _collection(spark, sf)
    return archive.changed_days(archive.next_archive(fresh, covered, hosts.where("host <> 'h2'"), saved), saved)


def stale_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Host h1 failed: its rows come from the collection before, without the last year."""
    daily = Usage(spark, sf).daily
    fresh = daily.where("host IN ('h0', 'h2')")
    previous = daily.where("host IN ('h0', 'h1') AND date < DATE'2001-01-01'")
    expected = spark.range(4).select(F.concat(F.lit("h"), F.col("id")).alias("host"))
    collected = expected.where("host IN ('h0', 'h2')")
    status = archive.source_status(expected, collected, previous)
    rows = archive.with_stale_fallback(fresh, previous, status)
    totals = rows.groupBy("host").agg(F.sum("total_tokens").alias("tokens"), F.sum("requests").alias("requests"))
    return status.join(totals, "host", "left")


def minute_usage(spark: SparkSession, sf: str) -> DataFrame:
    start = (NOW - history.RETENTION) // 60 * 60
    rows = Usage(spark, sf).request_rows()
    return facts.minute_usage(rows, F.lit(start), F.lit(NOW))


def fine_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Five-second usage over the last day of the history."""
    rows = Usage(spark, sf).request_rows()
    return facts.minute_usage(rows, F.lit(NOW - 24 * HOUR), F.lit(NOW), 5, ["host"])


def day_only_usage(spark: SparkSession, sf: str) -> DataFrame:
    return facts.day_only_usage(Usage(spark, sf).rollup_rows, F.lit("1998-06-02").cast("date"))


def _upsert(partial: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Known counts of meter 0 after a report of meter 1 for the second half."""
        tokens = adapters.minute_tokens(spark, sf)
        old = tokens.where("series = 'm0'").select(
            "slot", "tokens", F.lit(True).alias("known"), F.lit(False).alias("partial")
        )
        new = tokens.where("series = 'm1'").select("slot", "tokens")
        return history.upsert_usage(old, new, 2842260, 2844480, partial)

    return run


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Day-only counts per host over all rollups."""
    return facts.day_only_usage(Usage(spark, sf).rollup_rows, F.lit("1900-01-01").cast("date"), ["host"])


def _upsert_days(partial: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Days known of host h0 after a report of host h1 from 1995 on."""
        days = _days(spark, sf)
        old, new = (days.where(F.col("host") == h).select("date", "tokens") for h in ("h0", "h1"))
        begin, end = F.lit("1995-01-01").cast("date"), F.lit("1998-06-30").cast("date")
        return history.upsert_days(old, new.where(F.col("date") >= begin), begin, end, partial)

    return run


def history_untimed(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens without time of day inside each range, by its length."""
    days = materialize(_days(spark, sf).groupBy("date").agg(F.sum("tokens").alias("tokens")), "days")
    rows = [history.untimed_tokens(days, p, NOW).withColumn("period", F.lit(p).cast("bigint")) for p in history.RANGES]
    return reduce(DataFrame.unionByName, rows)


def rate_integral(spark: SparkSession, sf: str) -> DataFrame:
    return flat(history.integrate_rates(adapters.readings(spark, sf)))


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    rates = history.integrate_rates(adapters.readings(spark, sf))
    tokens = adapters.minute_tokens(spark, sf).withColumnRenamed("slot", "minute")
    return rates.join(tokens, ["series", "minute"], "full").withColumns(
        {
            **{
                c: F.coalesce(c, F.lit(0.0))
                for c in ("total_integral", "total_covered_s", "average_integral", "average_covered_s", "partial_s")
            },
            "usage_known": F.col("tokens").isNotNull(),
            "usage_partial": F.lit(False),
        }
    )


def history_10_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Five-second buckets with finer rates and counts."""
    fine_rates = history.integrate_rates(adapters.readings(spark, sf), 5)
    fine_counts = adapters.minute_tokens(spark, sf, 5).withColumn("partial", F.lit(False)).where("series <> 'm2'")
    return flat(history.history_buckets(_minutes(spark, sf), 600, EVENT_NOW, fine_rates, fine_counts))


#: The ranges that have no finer readings here, by name.
LONGER = {
    "1_hour": 3600, "3_hours": 10800, "6_hours": 21600, "12_hours": 43200, "1_day": 86400, "3_days": 259200, "7_days": 604800,
    "14_days": 1209600, "28_days": 2419200,
}


def _range(period: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return flat(history.history_buckets(_minutes(spark, sf), period, EVENT_NOW))

    return run


def _receipts(spark: SparkSession, sf: str) -> DataFrame:
    bins = live.receipt_seconds(live.receipt_deltas(adapters.response_samples(spark, sf)))
    return bins.select(
        F.lit("all").alias("series"), "second", "output_tokens", F.lit(True).alias("observed"), F.col("excluded").alias("partial")
    )


def receipts_120(spark: SparkSession, sf: str) -> DataFrame:
    """Received output in five-second buckets; every fourth minute has lost its seconds."""
    seconds = _receipts(spark, sf)
    kept = seconds.where(F.floor(F.col("second") / 60) % 4 != 0)
    return flat(history.receipt_buckets(history.receipt_minutes(seconds), kept, 600, EVENT_NOW))


def journal_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Last journal record per meter and minute, each event being one record."""
    journal = adapters.table(spark, sf, "events").selectExpr(
        "concat('m', user_id % 3) AS series",
        "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) div 60000 * 60 AS minute",
        "event_id AS sequence",
        "CAST(round(value * 10) AS BIGINT) AS tokens",
    )
    return history.latest_per_key(journal, ["series", "minute"], "sequence", 2841000)


QUERIES = {
    "archive_rows": archive_rows,
    "archive_merge": archive_merge,
    "archive_hours": archive_hours,
    "archive_next": archive_next,
    "archive_changed_days": archive_changed_days,
    "stale_fallback": stale_fallback,
    "minute_usage": minute_usage,
    "fine_usage": fine_usage,
    "day_only_usage": day_only_usage,
    "usage_upsert_full": _upsert(False),
    "usage_upsert_partial": _upsert(True),
    "days_upsert_full": _upsert_days(False),
    "days_upsert_partial": _upsert_days(True),
    "history_untimed": history_untimed,
    "rate_integral": rate_integral,
    "history_10_minutes": history_10_minutes,
    **{f"history_{name}": _range(period) for name, period in LONGER.items()},
    "receipts_120": receipts_120,
    "journal_latest": journal_latest,
}
