"""Normalised rows and the facts every report reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import usage as U

DAILY_KEYS = ("date", "host", "app", "provider", "model", "grain")
HOURS = tuple(f"{h:02d}" for h in range(24))
SESSION_KEYS = ("date", "host", "app", "session_key", "model", "project_key")


def provider_names(providers: DataFrame) -> DataFrame:
    """One name per host, provider and app."""
    return providers.groupBy("host", "id", "app_type").agg(F.min("name").alias("name"))


def attach_provider_names(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Left lookup of the provider's name; its size decides how Spark joins it."""
    names = provider_names(providers).withColumnsRenamed({"id": "provider_id", "name": "provider_name"})
    return rows.join(names, ["host", "provider_id", "app_type"], "left")


def _labels() -> dict[str, Column]:
    return {
        "app": U.app_label(F.col("app_type")),
        "provider": U.provider_label(F.col("session_provider"), F.col("provider_name"), F.col("provider_id")),
        "model": U.model_label(F.col("model")),
        "fresh_input_tokens": U.fresh_input(),
    }


def request_rows(unique: DataFrame, providers: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Unique requests with labels, local date and hour in the analysis zone, and totals."""
    if "session_provider" not in unique.columns:
        unique = unique.withColumn("session_provider", F.lit(None).cast("string"))
    created = F.col("created_at")
    rows = attach_provider_names(unique, providers).withColumns(
        {
            **_labels(),
            "local_datetime": U.wall_clock(created, timezone),
            "date": U.local_date(created, timezone),
            "hour": U.local_hour(created, timezone),
            "requests": F.lit(1).cast("bigint"),
            "grain": F.lit("request"),
        }
    )
    return rows.withColumn("total_tokens", U.total_tokens())


def rollup_rows(rollups: DataFrame, providers: DataFrame) -> DataFrame:
    """Rollups keep their own day and have no hour."""
    rows = attach_provider_names(rollups, providers).withColumn("session_provider", F.lit(None).cast("string"))
    return rows.withColumns(
        {
            **_labels(),
            "requests": F.col("request_count").cast("bigint"),
            "grain": F.lit("rollup"),
            "hour": F.lit(U.UNKNOWN_HOUR),
        }
    ).withColumn("total_tokens", U.total_tokens())


USAGE = (
    "date", "hour", "host", "app", "provider", "model", "grain", "requests", "fresh_input_tokens",
    "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_tokens", "total_cost_usd",
)


def usage_rows(requests: DataFrame, rollups: DataFrame) -> DataFrame:
    """Requests and rollups together; both count."""
    return requests.select(*USAGE).unionByName(rollups.select(*USAGE))


def sums() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in ("requests", *U.COMPONENTS, "total_tokens")],
        F.sum("total_cost_usd").alias("cost_usd"),
    ]


def daily_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAILY_KEYS).agg(*sums())


def hourly_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour", *DAILY_KEYS).agg(*sums())


def daily_from_hourly(hourly: DataFrame) -> DataFrame:
    """The daily fact from the hourly one, without a second read of the ledger."""
    measures = ["requests", *U.COMPONENTS, "total_tokens", "cost_usd"]
    return hourly.groupBy(*DAILY_KEYS).agg(*[F.sum(m).alias(m) for m in measures])


def _rate(duration: Column) -> Column:
    return F.col("output_tokens") * F.lit(1000.0) / duration


def timed(requests: DataFrame) -> DataFrame:
    """Add usable durations and rates; both null for failed or empty responses."""
    if "native_response_ms" not in requests.columns:
        requests = requests.withColumn("native_response_ms", F.lit(None).cast("double"))
    answered = (F.col("output_tokens") > 0) & U.success()
    return requests.withColumns(
        {
            "answered": answered,
            "recorded_ms": U.response_duration(),
            "native_ms": U.finite_positive(F.col("native_response_ms")),
        }
    ).withColumns(
        {
            "recorded_tps": F.when(answered, _rate(F.col("recorded_ms"))),
            "native_tps": F.when(answered & F.col("recorded_ms").isNull(), _rate(F.col("native_ms"))),
        }
    )


def deal_sessions(unique: DataFrame) -> DataFrame:
    """Unique requests that name a session, dealt out by it as they are.

    Keys, labels, titles and projects are wider than what they are made from, so they
    are added behind: ``session_daily`` finds the rows where it needs them.
    """
    key = U.session_key(F.col("session_id"))
    return unique.where(key.isNotNull()).repartition("host", U.app_label(F.col("app_type")), key)


def session_daily(requests: DataFrame, dealt: bool = False) -> DataFrame:
    """Per day, session, model and project: totals, hour map and mergeable rates.

    Rows are dealt out by session once, unless ``dealt`` says that ``deal_sessions`` has
    done it; days and whatever is summed by session afterwards stay where they are. A
    day has 24 hours, so their sums are columns of one aggregate and the map is built
    from them. Title and project name are those of the latest request.
    """
    named = requests.where(F.col("session_key").isNotNull())
    rows = timed(named if dealt else named.repartition("host", "app", "session_key")).withColumn("project_key", F.coalesce("project_key", F.lit("")))
    title, name = F.coalesce("session_title", F.lit("")), F.coalesce("project_name", F.lit(""))
    known = F.col("session_title").isNotNull() | F.col("project_name").isNotNull()
    latest = F.struct("created_at", known.alias("known"), "request_id", title.alias("title"), name.alias("name"))
    merged = rows.groupBy(*SESSION_KEYS).agg(
        *sums(),
        F.max(F.when(F.col("created_at").isNotNull(), latest)).alias("_latest"),
        F.count("recorded_tps").alias("tps_count"),
        F.count("native_tps").alias("native_tps_count"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum") for c in ("recorded_tps", "native_tps")],
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(f"{c}_max") for c in ("recorded_tps", "native_tps")],
        *[F.sum(F.when(F.col("hour") == h, F.col("total_tokens"))).alias(f"_tokens_{h}") for h in HOURS],
        *[F.count_if(F.col("hour") == h).alias(f"_requests_{h}") for h in HOURS],
    )
    hours = [F.when(F.col(f"_requests_{h}") > 0, F.struct(F.lit(h).alias("hour"), F.col(f"_tokens_{h}").alias("tokens"))) for h in HOURS]
    found = merged.withColumns(
        {
            "hours": F.map_from_entries(F.array_compact(F.array(*hours))),
            "session_title": F.coalesce(F.col("_latest.title"), F.lit("")),
            "project_name": F.coalesce(F.col("_latest.name"), F.lit("")),
        }
    ).withColumnsRenamed({"recorded_tps_sum": "tps_sum", "recorded_tps_max": "tps_max"})
    return found.drop("_latest", *[f"_{n}_{h}" for n in ("tokens", "requests") for h in HOURS])


def response_fact(requests: DataFrame) -> DataFrame:
    """One row per successful response with output; missing timing stays null.

    A native estimate is used only where no duration was recorded.
    """
    rows = timed(requests).where("answered")
    return rows.select(
        "date", "hour", "host", "app", "model", "output_tokens",
        F.coalesce("recorded_ms", "native_ms").alias("duration_ms"),
        F.coalesce(
            U.recorded_timing_source(), F.when(F.col("native_ms").isNotNull(), F.lit("native_log")), F.lit("")
        ).alias("duration_source"),
        F.coalesce("recorded_tps", "native_tps").alias("tps"),
        U.first_token_latency(F.col("recorded_ms")).alias("first_token_ms"),
    )


def request_tps(requests: DataFrame) -> DataFrame:
    """Rates of responses with a recorded duration only."""
    rows = timed(requests).where(F.col("recorded_tps").isNotNull())
    return rows.select(
        "date", F.date_format("local_datetime", "yyyy-MM-dd HH:mm:ss").alias("local_datetime"), "host", "app",
        "provider", "model", "created_at", "output_tokens", F.col("recorded_ms").alias("duration_ms"),
        U.recorded_timing_source().alias("duration_source"), F.col("recorded_tps").alias("tps"),
    )


def minute_usage(requests: DataFrame, start: Column, end: Column, step_s: int = 60, by: list[str] | None = None) -> DataFrame:
    """Tokens per time step for requests within [start, end]."""
    slot = (F.floor(F.col("created_at") / step_s) * step_s).alias("slot")
    return (
        requests.where((F.col("created_at") >= start) & (F.col("created_at") <= end))
        .groupBy(*(by or []), slot)
        .agg(F.sum("total_tokens").alias("tokens"))
    )


def day_only_usage(rollups: DataFrame, first_day: Column, by: list[str] | None = None) -> DataFrame:
    """Tokens per day of rollups from ``first_day`` on."""
    return rollups.where(F.col("date") >= first_day).groupBy(*(by or []), "date").agg(F.sum("total_tokens").alias("tokens"))
