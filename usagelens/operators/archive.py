"""Daily archive merged with fresh data, and the fallback for hosts that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.operators import quality

KEY = ["date", "host"]
ROW = [*KEY, "app", "model", "tokens", "requests", "cost_usd"]


def archive_rows(daily: DataFrame) -> DataFrame:
    """Checked daily rows, one per day, host, app and model."""
    rows = daily.withColumnRenamed("total_tokens", "tokens")
    checked = quality.strict(rows.select(*ROW), quality.archive_rules(), "daily accounting row")
    return checked.groupBy(*KEY, "app", "model").agg(
        F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"), F.sum("cost_usd").alias("cost_usd")
    )


def selected(archive: DataFrame, identities: DataFrame) -> DataFrame:
    """Archive entries whose source still has the identity they were written under."""
    return archive.join(identities.select("host", "source_identity"), ["host", "source_identity"], "left_semi")


def merge_archive(fresh: DataFrame, covered: DataFrame, archive: DataFrame) -> DataFrame:
    """Fresh rows, and archived rows only for days no fresh source covers.

    A covered day replaces the archive even when it now has no rows.
    """
    held = covered.select(*KEY).unionByName(fresh.select(*KEY)).distinct()
    kept = archive.where("app IS NOT NULL").join(held, KEY, "left_anti")
    return (
        fresh.select(*ROW)
        .withColumn("archived", F.lit(False))
        .unionByName(kept.select(*ROW).withColumn("archived", F.lit(True)))
    )


def archived_hours(merged: DataFrame) -> DataFrame:
    """Archived days have no hours: their usage goes under the unknown hour."""
    return merged.where("archived").withColumn("hour", F.lit(U.UNKNOWN_HOUR))


def next_archive(fresh: DataFrame, covered: DataFrame, sources: DataFrame, archive: DataFrame) -> DataFrame:
    """Archive content after a collection.

    Covered days of the given sources are replaced; a covered day without rows
    keeps one marker row with a null app, so that it stays replaced.
    """
    named = sources.select("host", "source_identity", "collected_at", F.col("host_timezone").alias("timezone"))
    held = covered.select(*KEY).unionByName(fresh.select(*KEY)).distinct().join(named, "host")
    entries = held.join(fresh.select(*ROW), KEY, "left").withColumns(
        {
            "tokens": F.coalesce("tokens", F.lit(0).cast("bigint")),
            "requests": F.coalesce("requests", F.lit(0).cast("bigint")),
            "cost_usd": F.coalesce("cost_usd", F.lit(0).cast("decimal(38,18)")),
        }
    )
    columns = [*KEY, "source_identity", "collected_at", "timezone", "app", "model", "tokens", "requests", "cost_usd"]
    kept = archive.select(*columns).join(held.select(*KEY, "source_identity"), [*KEY, "source_identity"], "left_anti")
    return entries.select(*columns).unionByName(kept)


def changed_days(new: DataFrame, old: DataFrame) -> DataFrame:
    """Days whose counts differ, and the last day of every source, which is still open."""
    columns = [*ROW, "source_identity"]
    a = new.select(*columns, F.lit(1).alias("_side"))
    b = old.select(*columns, F.lit(-1).alias("_side"))
    differing = a.unionByName(b).groupBy(*columns).agg(F.sum("_side").alias("_net")).where("_net <> 0").select("date")
    latest = new.groupBy("host", "source_identity").agg(F.max("date").alias("date")).select("date")
    return differing.unionByName(latest).distinct()


def with_stale_fallback(fresh: DataFrame, previous: DataFrame, status: DataFrame) -> DataFrame:
    """Fresh rows, and the last good rows of hosts whose collection failed."""
    failed = status.where("status <> 'fresh'").select("host")
    kept = previous.join(failed, "host", "left_semi").join(fresh.select("host").distinct(), "host", "left_anti")
    return fresh.unionByName(kept.select(*fresh.columns))


def source_status(expected: DataFrame, collected: DataFrame, previous: DataFrame) -> DataFrame:
    """Each expected host as fresh, stale (old data kept) or unavailable."""
    now = collected.select("host", F.lit(True).alias("_now"))
    then = previous.select("host").distinct().withColumn("_then", F.lit(True))
    joined = expected.select("host").join(now, "host", "left").join(then, "host", "left")
    state = F.when(F.col("_now"), F.lit("fresh")).when(F.col("_then"), F.lit("stale")).otherwise(F.lit("unavailable"))
    return joined.select("host", state.alias("status"))
