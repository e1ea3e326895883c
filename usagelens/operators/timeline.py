"""Time buckets, stacks, session heat matrices and gaps on a calendar."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.dates import fixed_slot_hours, parse_day, slot_hours, slot_label

IDENTITY = ("host", "app", "session_key")


@dataclass(frozen=True)
class Resolution:
    """The calendar of a chart: ``row`` has first and last day, days and hours per slot.

    Given bounds are literals in every expression; bounds taken from the data
    come in through one scalar subquery each.
    """

    row: DataFrame
    fixed: tuple[int, int] | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_days`` and ``_hours``."""
        if self.fixed:
            days, hours = (F.lit(n) for n in self.fixed)
        else:
            days, hours = self.row.select("days").scalar(), self.row.select("hours").scalar()
        return df.withColumns({"_days": days, "_hours": hours})

    @property
    def whole_days(self) -> bool | None:
        """Whether slots are whole days; None when only the data can tell."""
        return self.fixed[1] == 24 if self.fixed else None


def resolution(rows: DataFrame, start: str | None = None, end: str | None = None, width: int = 1000) -> Resolution:
    """Slots for a date range; a missing bound is the first or last day in ``rows``."""
    if start and end:
        first, last = parse_day(start), parse_day(end)
        days = (last - first).days + 1
        hours = fixed_slot_hours(days, width)
        row = rows.sparkSession.range(1).select(
            F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(days).alias("days"), F.lit(hours).alias("hours")
        )
        return Resolution(row, (days, hours))
    bounds = rows.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    first = F.lit(parse_day(start)) if start else F.col("first")
    last = F.lit(parse_day(end)) if end else F.col("last")
    days = F.datediff(last, first) + 1
    row = bounds.select(first.alias("first"), last.alias("last"), days.alias("days"), slot_hours(days, width).alias("hours"))
    return Resolution(row)


def slots(bounds: Resolution) -> DataFrame:
    """Every slot of a resolution in order, numbered from 0."""
    days = bounds.row.where("first <= last").select(
        "hours", "days", "first", F.explode(F.sequence("first", "last")).alias("date")
    )
    intraday = F.col("hours") < 24
    starts = F.when(intraday, F.sequence(F.lit(0), F.lit(23), F.col("hours"))).otherwise(F.array(F.lit(0)))
    cells = days.withColumn("start", F.explode(starts))
    number = F.datediff("date", "first") * (F.lit(24) / F.col("hours")) + F.floor(F.col("start") / F.col("hours"))
    label = slot_label(F.col("date"), F.col("start").cast("string"), F.col("hours"), F.col("days"))
    return cells.select(number.cast("int").alias("slot_index"), label.alias("slot"))


def time_buckets(hourly: DataFrame, bounds: Resolution) -> DataFrame:
    """Tokens and cost per slot and model, with intraday slots without usage as zero rows.

    A zero row has a null model. Usage without an hour gets its own slot, last.
    """
    label = slot_label(F.col("date"), F.col("hour"), F.col("_hours"), F.col("_days"))
    used = (
        bounds.attach(hourly)
        .groupBy(label.alias("slot"), "model")
        .agg(F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    )
    if bounds.whole_days:
        return used
    intraday = slots(replace(bounds, row=bounds.row.where("hours < 24")))
    idle = intraday.join(used.select("slot").distinct(), "slot", "left_anti").select(
        "slot", F.lit(None).cast("string").alias("model"), F.lit(0).cast("bigint").alias("tokens"),
        F.lit(0).cast("decimal(38,18)").alias("cost_usd"),
    )
    return used.unionByName(idle)


def stack_segments(buckets: DataFrame) -> DataFrame:
    """Bar segments per slot: smallest first, each from the running sum below it."""
    checked = buckets.where(U.require(F.col("tokens") >= 0, "Model token counts must be non-negative"))
    below = Window.partitionBy("slot").orderBy("tokens", "model").rowsBetween(Window.unboundedPreceding, 0)
    return (
        checked.where((F.col("tokens") > 0) & F.col("model").isNotNull())
        .withColumn("segment_end", F.sum("tokens").over(below))
        .select("slot", "model", "tokens", (F.col("segment_end") - F.col("tokens")).alias("segment_base"), "segment_end")
    )


def session_matrix(sessions: DataFrame, bounds: Resolution) -> DataFrame:
    """Tokens per session and slot, in long form.

    With intraday slots the hour map gives the tokens; what it does not explain
    goes to the unknown slot.
    """
    rows = bounds.attach(sessions)
    known = F.aggregate(
        F.map_values("hours"), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
    rest = F.col("total_tokens") - known
    unknown = F.struct(F.lit(U.UNKNOWN_HOUR).alias("key"), rest.alias("value"))
    cells = F.concat(F.map_entries("hours"), F.when(rest > 0, F.array(unknown)).otherwise(F.slice(F.array(unknown), 1, 0)))
    whole = F.array(F.struct(F.lit("00").alias("key"), F.col("total_tokens").alias("value")))
    if bounds.whole_days is None:
        cells = F.when(F.col("_hours") < 24, cells).otherwise(whole)
    elif bounds.whole_days:
        cells = whole
    long = rows.select(*IDENTITY, "date", "_hours", "_days", F.explode(cells).alias("cell"))
    label = slot_label(F.col("date"), F.col("cell.key"), F.col("_hours"), F.col("_days"))
    return long.groupBy(*IDENTITY, label.alias("slot")).agg(F.sum("cell.value").alias("tokens"))


def heat_scale(matrix: DataFrame, value: str = "tokens") -> DataFrame:
    """Position of each value between the grid's smallest and largest; half when flat."""
    ends = matrix.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("ends"))
    scaled = matrix.withColumn("_ends", ends.scalar())
    return scaled.withColumn("heat", heat(F.col(value), F.col("_ends.low"), F.col("_ends.high"))).drop("_ends")


def heat(value: Column, lowest: Column, highest: Column) -> Column:
    t = (value - lowest) / F.nullif(highest - lowest, F.lit(0))
    return F.when(highest == lowest, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def temporal_runs(matrix: DataFrame, bounds: Resolution) -> DataFrame:
    """Unbroken runs of recorded slots per session; the unknown slot is its own run.

    A session has at most one row per calendar slot here, so its window is small.
    """
    numbered = matrix.join(slots(bounds), "slot", "left")
    by_session = Window.partitionBy(*IDENTITY).orderBy("slot_index")
    known = numbered.where(F.col("slot_index").isNotNull()).withColumn(
        "_island", F.col("slot_index") - F.row_number().over(by_session)
    )
    runs = known.groupBy(*IDENTITY, "_island").agg(
        F.min("slot_index").alias("first_index"),
        F.max("slot_index").alias("last_index"),
        F.count(F.lit(1)).alias("slots"),
        F.sum("tokens").alias("tokens"),
    ).drop("_island")
    unknown = numbered.where((F.col("slot") == U.UNKNOWN_HOUR)).select(
        *IDENTITY, F.lit(None).cast("int").alias("first_index"), F.lit(None).cast("int").alias("last_index"),
        F.lit(1).cast("bigint").alias("slots"), "tokens",
    )
    return runs.unionByName(unknown)


def line_breaks(buckets: DataFrame, bounds: Resolution) -> DataFrame:
    """Cost per slot and whether the line restarts because the slot before is not adjacent."""
    cost = buckets.groupBy("slot").agg(F.sum("cost_usd").alias("cost_usd"))
    numbered = cost.join(slots(bounds), "slot", "left")
    earlier = numbered.select((F.col("slot_index") + 1).alias("slot_index"), F.lit(True).alias("joined"))
    return numbered.join(earlier, "slot_index", "left").select(
        "slot", "cost_usd", F.col("joined").isNull().alias("line_break")
    )
