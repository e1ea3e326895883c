"""Registered queries over usage, sessions, projects, speed and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions import dates
from usagelens.functions import usage as U
from usagelens.operators import dedupe, facts, reports, sessions, sorting, speed, timeline
from usagelens.plans.columns import flat
from usagelens.plans.usage import SESSION_COLUMNS, Usage
from usagelens.session import materialize
from usagelens.sources import adapters

# The report ranges used by the bounded queries.
YEAR = ("1998-01-01", "1998-12-31")
WEEK = ("1998-03-02", "1998-03-08")
DAY = ("1998-03-04", "1998-03-04")
FORTNIGHT = ("1998-03-02", "1998-03-15")


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return Usage(spark, sf).sessions


def daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    return flat(Usage(spark, sf).daily)


def hourly_usage(spark: SparkSession, sf: str) -> DataFrame:
    return flat(Usage(spark, sf).hourly)


def local_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by date and hour of another analysis zone."""
    rows = Usage(spark, sf, timezone="Asia/Tokyo").request_rows()
    return flat(rows.groupBy("date", "hour").agg(*facts.sums()))


def by_model(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.by_model(Usage(spark, sf).daily))


def by_host_app(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.by_host_app(Usage(spark, sf).daily))


def grand_total(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.grand_total(Usage(spark, sf).daily))


def headline(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.headline(reports.in_range(Usage(spark, sf).daily, *YEAR)))


def date_model_totals(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.totals_by(Usage(spark, sf).daily, "date", "model"))


def effective_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.effective_requests(adapters.requests(spark, sf))
    return rows.select("host", "app_type", "request_id", "created_at", "data_source")


def cross_host_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.unique_requests(dedupe.effective_requests(adapters.requests(spark, sf)), ("model", "output_tokens"))
    return rows.select("host", "app_type", "request_id", "created_at", "model", "output_tokens")


def rollup_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.rollup_overlap(adapters.rollups(spark, sf))
    return rows.select("date", "app_type", "model", "host", "request_count", "input_tokens")


def monthly_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports.cost_leaders(Usage(spark, sf).daily))


def _leaders(span: tuple[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return flat(reports.cost_leaders(Usage(spark, sf).daily, *span))

    return run


def chosen_models(spark: SparkSession, sf: str) -> DataFrame:
    """Date and model filter over the daily fact, then totals per model."""
    rows = reports.filter_usage(Usage(spark, sf).daily, *YEAR, ["model-1", "model-2", "unknown"])
    return flat(reports.by_model(rows))


def model_search(spark: SparkSession, sf: str) -> DataFrame:
    return reports.search_models(reports.models_in_range(Usage(spark, sf).daily, *YEAR), "MODEL-")


def preset_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals for every date preset, ending on the last day with usage."""
    daily = Usage(spark, sf).daily
    anchored = daily.withColumn("anchor", daily.agg(F.max("date")).scalar())
    held = []
    for preset in dates.PRESETS:
        first, last = dates.preset_bounds(preset, F.col("anchor"))
        held.append(F.when((F.col("date") >= first) & (F.col("date") <= last), F.lit(preset)))
    return flat(reports.totals_by(anchored.withColumn("preset", F.explode(F.array_compact(F.array(*held)))), "preset"))


def response_fact(spark: SparkSession, sf: str) -> DataFrame:
    return flat(Usage(spark, sf).responses)


def request_tps(spark: SparkSession, sf: str) -> DataFrame:
    return flat(facts.request_tps(Usage(spark, sf).timed_rows))


def response_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return flat(speed.response_stats(Usage(spark, sf).responses))


def response_stats_recorded(spark: SparkSession, sf: str) -> DataFrame:
    return flat(speed.response_stats(Usage(spark, sf).responses, include_native=False))


def _groups(dimension: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return flat(speed.response_groups(Usage(spark, sf).responses, dimension))

    return run


def speed_windows(spark: SparkSession, sf: str) -> DataFrame:
    responses = Usage(spark, sf).responses
    return flat(speed.speed_windows(responses, F.lit("1998-06-30").cast("date")))


def session_daily(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_sessions(spark, sf).drop("hours"))


def session_hours(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sessions(spark, sf)
    return rows.select(*facts.SESSION_KEYS, F.explode("hours").alias("hour", "tokens"))


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return flat(sessions.summarize_sessions(sessions.with_native_tps(_sessions(spark, sf))))


def session_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return flat(sessions.session_by(_sessions(spark, sf), "model"))


def session_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return flat(sessions.session_by(_sessions(spark, sf), "date"))


def component_share(spark: SparkSession, sf: str) -> DataFrame:
    return flat(sessions.component_share(_sessions(spark, sf)))


def _review(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily and session facts with some single empty requests under Claude labels.

    The given lines have no empty requests, so those with model 0 and quantity 1
    stand for them.
    """
    plan = Usage(spark, sf)
    empty = (F.col("model") == "model-0") & (F.col("output_tokens") == 7)
    emptied = dedupe.effective_requests(plan.enriched, sparse=True).withColumns(
        {
            "model": F.when(empty, F.lit("Claude-review")).otherwise(F.col("model")),
            "total_cost_usd": F.when(empty, F.lit(0).cast("decimal(38,18)")).otherwise(F.col("total_cost_usd")),
            "emptied": empty,
            **{
                c: F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col(c))
                for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
            },
        }
    )
    unique = dedupe.unique_requests(
        emptied, (*dedupe.USAGE_COLUMNS, "emptied", *SESSION_COLUMNS), dedupe.repeated_ids(plan.requests)
    )
    # Names and evidence are written, so that their true size decides how they meet the rows.
    providers = materialize(facts.provider_names(plan.providers), "providers")
    evidence = materialize(adapters.session_evidence(spark, sf), "sessions")
    rows = facts.request_rows(unique, providers)
    daily = facts.daily_usage(facts.usage_rows(rows, facts.rollup_rows(plan.rollups, providers)))
    own = rows.withColumn("own", F.when(F.col("emptied"), F.concat(F.lit("x"), F.col("request_id"))))
    key = F.when(F.col("emptied"), F.col("own")).otherwise(U.session_key(F.col("session_id")))
    # Keys and projects widen rows some twenty times behind the shuffle, so parts of equal compressed size would be too large.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.where(key.isNotNull()).repartition(parts, "host", "app", key)
    known = adapters.with_sessions(dealt, evidence, "own").withColumn("session_key", key)
    return daily, facts.session_daily(known, dealt=True)


def visible_sessions(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _review(spark, sf)
    shown = sessions.visible_sessions(rows)
    return shown.groupBy("host", "app", "session_key").agg(F.sum("requests").alias("requests"))


def available_models(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.available_models(*_review(spark, sf), *YEAR)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    daily, rows = _review(spark, sf)
    return reports.coverage(daily, sessions.judged_sessions(rows))


def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    return flat(sessions.summarize_projects(sessions.with_native_tps(_sessions(spark, sf))))


def project_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sessions(spark, sf).where("project_key <> ''")
    return flat(sessions.grouped_detail(rows, ["project_key"], ["date", "model", "session_key"]))


def project_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.enriched_requests(spark, sf).where("project_key IS NOT NULL")
    return rows.groupBy("project_key", "project_name").agg(F.count(F.lit(1)).alias("requests"))


def top_projects(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.top_projects(_sessions(spark, sf))
    return rows.select("project_name", "project_key", "total_tokens", "requests")


def _buckets(span: tuple[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = reports.in_range(Usage(spark, sf).hourly, *span)
        return flat(timeline.time_buckets(rows, timeline.resolution(rows, *span)))

    return run


def stack_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = Usage(spark, sf).hourly
    return timeline.stack_segments(timeline.time_buckets(rows, timeline.resolution(rows)))


def line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.totals_by(Usage(spark, sf).daily, "date", "model").withColumn("hour", F.lit(U.UNKNOWN_HOUR))
    rows = rows.withColumnRenamed("tokens", "total_tokens").where("model = 'unknown'")
    bounds = timeline.resolution(rows)
    return flat(timeline.line_breaks(timeline.time_buckets(rows, bounds), bounds))


def _matrix(span: tuple[str, str] | None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _sessions(spark, sf)
        if span:
            rows = reports.in_range(rows, *span)
        return flat(timeline.heat_scale(timeline.session_matrix(rows, timeline.resolution(rows, *(span or ())))))

    return run


def temporal_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.in_range(_sessions(spark, sf), *FORTNIGHT)
    bounds = timeline.resolution(rows, *FORTNIGHT)
    return timeline.temporal_runs(timeline.session_matrix(rows, bounds), bounds)


def calendar_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Response counts on a Monday-first calendar grid of a year."""
    grid = dates.calendar_grid(spark, *YEAR)
    counted = Usage(spark, sf).responses.groupBy("date").agg(F.count(F.lit(1)).alias("responses"))
    return grid.join(counted, "date", "left").withColumn("responses", F.coalesce("responses", F.lit(0)))


def table_sort(spark: SparkSession, sf: str) -> DataFrame:
    """First page of models by rate, slowest last; models without a rate at the end."""
    table = speed.response_groups(Usage(spark, sf).responses, "model").select("key", "tps_avg", "responses")
    return flat(sorting.page(sorting.sort_table(table, "tps_avg", "descending", ["key"]), 0, 50))


def text_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of session titles in natural order."""
    rows = sessions.summarize_sessions(_sessions(spark, sf)).select("host", "app", "session_key", "title")
    return sorting.page(sorting.sort_table(rows, "title", "ascending", ["session_key", "host", "app"]), 1, 50)


def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    plan = Usage(spark, sf)
    unique = plan.unique("status_code", "duration_ms", "latency_ms")
    audit = reports.source_audit(plan.requests, plan.effective, unique, plan.rollups, plan.sources)
    return audit.drop("collected_at")


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status_counts(adapters.requests(spark, sf))


def covered_dates(spark: SparkSession, sf: str) -> DataFrame:
    plan = Usage(spark, sf)
    return reports.covered_dates(plan.requests, plan.rollups)


QUERIES = {
    "daily_usage": daily_usage,
    "hourly_usage": hourly_usage,
    "local_hours": local_hours,
    "by_model": by_model,
    "by_host_app": by_host_app,
    "grand_total": grand_total,
    "headline": headline,
    "date_model_totals": date_model_totals,
    "effective_requests": effective_requests,
    "cross_host_unique": cross_host_unique,
    "rollup_overlap": rollup_overlap,
    "monthly_leaders": monthly_leaders,
    "period_leaders_day": _leaders(DAY),
    "period_leaders_week": _leaders(WEEK),
    "period_leaders_range": _leaders(YEAR),
    "chosen_models": chosen_models,
    "model_search": model_search,
    "preset_totals": preset_totals,
    "response_fact": response_fact,
    "request_tps": request_tps,
    "response_stats_all": response_stats_all,
    "response_stats_recorded": response_stats_recorded,
    "response_stats_date": _groups("date"),
    "response_stats_hour": _groups("hour"),
    "response_stats_weekday": _groups("weekday"),
    "response_stats_weekday_hour": _groups("weekday_hour"),
    "response_stats_model": _groups("model"),
    "speed_windows": speed_windows,
    "session_daily": session_daily,
    "session_hours": session_hours,
    "session_summary": session_summary,
    "session_by_model": session_by_model,
    "session_by_date": session_by_date,
    "component_share": component_share,
    "visible_sessions": visible_sessions,
    "available_models": available_models,
    "coverage": coverage,
    "project_summary": project_summary,
    "project_detail": project_detail,
    "project_identity": project_identity,
    "top_projects": top_projects,
    "time_buckets_day": _buckets(DAY),
    "time_buckets_fortnight": _buckets(FORTNIGHT),
    "time_buckets_year": _buckets(YEAR),
    "stack_segments": stack_segments,
    "line_breaks": line_breaks,
    "session_matrix_fortnight": _matrix(FORTNIGHT),
    "session_matrix_all": _matrix(None),
    "temporal_runs": temporal_runs,
    "calendar_grid": calendar_grid,
    "table_sort": table_sort,
    "text_sort": text_sort,
    "source_audit": source_audit,
    "status_counts": status_counts,
    "covered_dates": covered_dates,
}
