"""Totals, cost leaders, audits and coverage over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.dates import parse_day, period_unit


def _measures() -> list[Column]:
    return [
        F.sum("total_tokens").alias("tokens"),
        F.sum("requests").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
    ]


def by_model(daily: DataFrame) -> DataFrame:
    return daily.groupBy("model").agg(*_measures())


def by_host_app(daily: DataFrame) -> DataFrame:
    return daily.groupBy("host", "app").agg(
        F.sum("total_tokens").alias("tokens"),
        F.sum("requests").alias("requests"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def grand_total(daily: DataFrame) -> DataFrame:
    return daily.agg(*_measures())


def headline(daily: DataFrame) -> DataFrame:
    """Totals and the number of models; models are few enough to be counted after grouping."""
    return by_model(daily).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("requests").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count(F.lit(1)).alias("models"),
    )


def totals_by(daily: DataFrame, *keys: str) -> DataFrame:
    """Data behind the static charts: any grain of the daily fact."""
    return daily.groupBy(*keys).agg(*_measures())


def cost_leaders(daily: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The model with the highest cost per period, with every tie, and its share.

    Without bounds each month is a period, else the bounded range is one. Costs
    are decimals, so ties are exact; a period without cost has no leader.
    """
    unit = period_unit(start, end)
    rows = in_range(daily, start, end)
    if unit == "monthly":
        period, unit = F.date_format("date", "yyyy-MM"), "month"
    else:
        label = {"day": start, "month": (start or "")[:7]}.get(unit, f"{start or '…'} → {end or '…'}")
        period = F.lit(label)
    models = rows.groupBy(period.alias("period"), "model").agg(*_measures())
    of_period = Window.partitionBy("period")
    ranked = models.withColumns(
        {
            "_rank": F.rank().over(of_period.orderBy(F.col("cost_usd").desc())),
            "_total": F.sum("cost_usd").over(of_period),
        }
    )
    share = F.col("cost_usd").cast("double") / F.nullif(F.col("_total").cast("double"), F.lit(0.0))
    return ranked.where((F.col("_rank") == 1) & (F.col("cost_usd") > 0)).select(
        "period", F.lit(unit).alias("unit"), "model", "cost_usd", "tokens", share.alias("share")
    )


def in_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive optional bounds on ``date``."""
    if start:
        df = df.where(F.col("date") >= F.lit(parse_day(start)))
    if end:
        df = df.where(F.col("date") <= F.lit(parse_day(end)))
    return df


def filter_usage(df: DataFrame, start: str | None, end: str | None, models: list[str]) -> DataFrame:
    """Date bounds and a model choice; an empty choice keeps nothing."""
    bounded = in_range(df, start, end)
    return bounded.where(F.col("model").isin(*models)) if models else bounded.where(F.lit(False))


def models_in_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return in_range(df, start, end).select("model").distinct()


def search_models(models: DataFrame, text: str) -> DataFrame:
    return models.where(F.lower("model").contains(text.lower())).orderBy("model")


def source_audit(requests: DataFrame, effective: DataFrame, unique: DataFrame, rollups: DataFrame, sources: DataFrame) -> DataFrame:
    """Collection quality per host; null where a host has no such rows.

    Duplicates are differences of counts before and after each removal.
    """
    count = F.count(F.lit(1))
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    empty = F.lit(True)
    for name in tokens:
        empty = empty & (F.coalesce(F.col(name), F.lit(0)) == 0)
    raw = requests.groupBy("host").agg(
        count.alias("raw_requests"),
        F.count_if(empty).alias("zero_token_requests"),
        F.max("created_at").alias("latest_request"),
    )
    kept = effective.groupBy("host").agg(count.alias("_effective"))
    timed = F.count_if(U.success() & (F.col("output_tokens") > 0) & U.response_duration().isNotNull())
    first = unique.groupBy("host").agg(count.alias("_unique"), timed.alias("timed_requests"))
    rolled = rollups.groupBy("host").agg(
        count.alias("rollup_rows"), F.min("date").alias("rollup_first"), F.max("date").alias("rollup_last")
    )
    joined = sources.select("host", "collected_at", "host_timezone")
    for part in (raw, kept, first, rolled):
        joined = joined.join(part, "host", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return joined.select(
        "host", "collected_at", "host_timezone",
        zero("raw_requests").alias("raw_requests"),
        (zero("raw_requests") - zero("_effective")).alias("proxy_session_duplicates"),
        (zero("_effective") - zero("_unique")).alias("cross_host_duplicates"),
        zero("timed_requests").alias("timed_requests"),
        zero("zero_token_requests").alias("zero_token_requests"),
        "latest_request",
        zero("rollup_rows").alias("rollup_rows"), "rollup_first", "rollup_last",
    )


def status_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("host", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def covered_dates(requests: DataFrame, rollups: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Days each host reported on, before any removal."""
    asked = requests.select("host", U.local_date(F.col("created_at"), timezone).alias("date"))
    return asked.unionByName(rollups.select("host", "date")).distinct()


def unmatched(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Wanted keys that were not found."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def coverage(daily: DataFrame, judged: DataFrame) -> DataFrame:
    """How much of the usage has session and project detail.

    ``judged`` are the rows of all sessions with ``shown`` beside them, so that what is
    recorded and what is visible come from one pass; the daily totals come from another.
    """
    total = daily.agg(F.sum("total_tokens").alias("t"), F.sum("requests").alias("r")).select(F.struct("t", "r")).scalar()
    projects = F.col("project_key") != ""

    def summed(column: str, which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(column))), F.lit(0))

    shown = judged.agg(
        summed("total_tokens", F.col("shown")).alias("session_tokens"),
        summed("requests", F.col("shown")).alias("session_requests"),
        summed("total_tokens", F.col("shown") & projects).alias("project_tokens"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("_recorded"),
    )
    with_totals = shown.withColumns(
        {
            "all_tokens": F.coalesce(total["t"], F.lit(0)),
            "all_requests": F.coalesce(total["r"], F.lit(0)),
            "hidden_requests": F.col("_recorded") - F.col("session_requests"),
        }
    )
    none = F.lit(0).cast("bigint")
    return with_totals.select(
        "all_tokens", "session_tokens", "session_requests", "project_tokens", "hidden_requests",
        F.greatest(none, F.col("all_tokens") - F.col("session_tokens")).alias("tokens_without_session"),
        F.greatest(none, F.col("all_requests") - F.col("hidden_requests") - F.col("session_requests")).alias(
            "requests_without_session"
        ),
        F.greatest(none, F.col("all_tokens") - F.col("project_tokens")).alias("tokens_without_project"),
    )
