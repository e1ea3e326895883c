"""Response-speed statistics with exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.dates import speed_window, weekday
from usagelens.operators.prefix import exact_percentiles, same_keys
from usagelens.session import materialize

# Grouping dimensions as columns of the response fact.
DIMENSIONS = {
    "date": lambda: F.col("date"),
    "hour": lambda: F.col("hour"),
    "weekday": lambda: weekday(F.col("date")),
    "weekday_hour": lambda: F.concat(weekday(F.col("date")).cast("string"), F.lit("/"), F.col("hour")),
    "model": lambda: F.col("model"),
}


def response_stats(
    responses: DataFrame, by: list[str] | None = None, include_native: bool = True, approximate: bool = False
) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum of rate and first-token time.

    Responses without timing stay in ``responses``. Percentiles are exact and
    interpolated unless ``approximate`` is asked for.
    """
    keys = by or []
    native = F.col("duration_source") == "native_log"
    rate = U.finite_positive(F.col("tps"))
    if not include_native:
        rate = F.when(~F.coalesce(native, F.lit(False)), rate)
    rows = responses.select(
        *keys,
        rate.alias("_tps"),
        U.finite_positive(F.col("first_token_ms")).alias("_latency"),
        native.alias("_native"),
    )
    # Read once for sums and twice a percentile: a narrow table, written once.
    rows = materialize(rows, "speed") if not approximate else rows

    def described(column: str, name: str) -> list[Column]:
        shown = [
            F.count(column).alias(f"{name}_count"),
            F.avg(column).alias(f"{name}_avg"),
            F.max(column).alias(f"{name}_max"),
        ]
        if approximate:
            shown += [
                F.percentile_approx(column, 0.5).alias(f"{name}_median"),
                F.percentile_approx(column, 0.95).alias(f"{name}_p95"),
            ]
        return shown

    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("_native") & F.col("_tps").isNotNull()).alias("native"),
        *described("_tps", "tps"),
        *described("_latency", "latency"),
    )
    if approximate:
        return _in_seconds(grouped)
    for column, name in (("_tps", "tps"), ("_latency", "latency")):
        points = exact_percentiles(rows, keys, column, {f"{name}_median": 0.5, f"{name}_p95": 0.95})
        if keys:
            points = points.withColumnsRenamed({key: f"_key_{key}" for key in keys})
            grouped = grouped.join(points, same_keys(keys), "left").drop(*[f"_key_{key}" for key in keys])
        else:
            grouped = grouped.withColumns(
                {c: points.select(c).scalar() for c in (f"{name}_median", f"{name}_p95")}
            )
    return _in_seconds(grouped)


def _in_seconds(stats: DataFrame) -> DataFrame:
    names = ("latency_avg", "latency_max", "latency_median", "latency_p95")
    return stats.withColumns({n: F.col(n) / 1000 for n in names})


def response_groups(responses: DataFrame, dimension: str, include_native: bool = True) -> DataFrame:
    """Statistics per date, hour, weekday (Monday 0), weekday and hour, or model."""
    return response_stats(responses.withColumn("key", DIMENSIONS[dimension]().cast("string")), ["key"], include_native)


def speed_windows(
    responses: DataFrame,
    anchor: Column,
    days: tuple[int, ...] = (7, 30, 0),
    start: Column | None = None,
    end: Column | None = None,
    include_native: bool = True,
) -> DataFrame:
    """Statistics of several trailing windows side by side, in one pass; 0 days is all."""
    inside = []
    for length in days:
        first, last = speed_window(anchor, length, start, end)
        held = F.col("date") <= last
        if first is not None:
            held = held & (F.col("date") >= first)
        inside.append(F.when(held, F.lit(length)))
    member = F.array_compact(F.array(*inside))
    return response_stats(responses.withColumn("window_days", F.explode(member)), ["window_days"], include_native)
