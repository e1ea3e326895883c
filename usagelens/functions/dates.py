"""Calendar presets, report periods and time slots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.usage import UNKNOWN_HOUR

PRESETS = ("today", "past-seven-days", "this-month", "last-month", "this-year", "last-year")


def parse_day(value: str, message: str = "Invalid date") -> dt.date:
    """A calendar day in exactly the form YYYY-MM-DD."""
    try:
        day = dt.date.fromisoformat(value)
    except (TypeError, ValueError) as error:
        raise ValueError(f"{message}: {value!r}") from error
    if day.isoformat() != value:
        raise ValueError(f"{message}: {value!r}")
    return day


def date_preset(preset: str, anchor: str) -> tuple[str, str]:
    """First and last day of a named range that ends at or before the anchor day."""
    end = parse_day(anchor, "Invalid anchor day")
    month_start = end.replace(day=1)
    previous_month_end = month_start - dt.timedelta(days=1)
    ranges = {
        "today": (end, end),
        "past-seven-days": (end - dt.timedelta(days=6), end),
        "this-month": (month_start, end),
        "last-month": (previous_month_end.replace(day=1), previous_month_end),
        "this-year": (end.replace(month=1, day=1), end),
        "last-year": (dt.date(end.year - 1, 1, 1), dt.date(end.year - 1, 12, 31)),
    }
    if preset not in ranges:
        raise ValueError(f"Unknown date preset: {preset!r}")
    first, last = ranges[preset]
    return first.isoformat(), last.isoformat()


def preset_bounds(preset: str, anchor: Column) -> tuple[Column, Column]:
    """The same ranges as columns, for an anchor computed from the data."""
    month_start = F.trunc(anchor, "month")
    year_start = F.trunc(anchor, "year")
    ranges = {
        "today": (anchor, anchor),
        "past-seven-days": (F.date_sub(anchor, 6), anchor),
        "this-month": (month_start, anchor),
        "last-month": (F.add_months(month_start, -1), F.date_sub(month_start, 1)),
        "this-year": (year_start, anchor),
        "last-year": (F.add_months(year_start, -12), F.date_sub(year_start, 1)),
    }
    if preset not in ranges:
        raise ValueError(f"Unknown date preset: {preset!r}")
    return ranges[preset]


def period_unit(start: str | None, end: str | None) -> str:
    """Class of a report period: monthly, day, week, month or range."""
    if not start and not end:
        return "monthly"
    if not (start and end):
        return "range"
    first, last = parse_day(start), parse_day(end)
    if first.day == 1 and first.strftime("%Y-%m") == last.strftime("%Y-%m"):
        if (last + dt.timedelta(days=1)).day == 1:
            return "month"
    return {1: "day", 7: "week"}.get((last - first).days + 1, "range")


def speed_window(anchor: Column, days: int, start: Column | None = None, end: Column | None = None) -> tuple[Column | None, Column]:
    """Trailing window of ``days`` days (0 for all) within the user's bounds.

    Bounds that lie outside leave an empty window; nothing is shifted.
    """
    last = anchor if end is None else F.least(anchor, end)
    first = F.date_sub(anchor, days - 1) if days else None
    if start is not None:
        first = start if first is None else F.greatest(first, start)
    return first, last


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of a fixed range."""
    first, last = parse_day(start), parse_day(end)
    return spark.range(max(0, (last - first).days + 1)).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("date")
    )


def calendar_grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Days from the Monday on or before ``start``, with week number and weekday."""
    first = parse_day(start)
    monday = first - dt.timedelta(days=first.weekday())
    days = calendar(spark, monday.isoformat() if first <= parse_day(end) else start, end)
    return days.select(
        "date",
        F.floor(F.datediff("date", F.lit(monday)) / 7).cast("int").alias("week"),
        weekday(F.col("date")).alias("weekday"),
        (F.col("date") >= F.lit(first)).alias("in_range"),
    )


SLOT_STEPS = (1, 2, 3, 6, 12, 24)


def _slot_target(width: int) -> int:
    return max(24, min(72, width // 24))


def fixed_slot_hours(days: int, width: int = 1000) -> int:
    """Hours per time slot: one for a single day, whole days beyond two weeks.

    Between, the smallest divisor of a day whose slots fit the drawing width.
    """
    if days == 1:
        return 1
    fitting = [step for step in SLOT_STEPS if days * 24 / step <= _slot_target(width)]
    return fitting[0] if 0 < days <= 14 and fitting else 24


def slot_hours(days: Column, width: int = 1000) -> Column:
    """The same for a number of days taken from the data."""
    hours = F.when(days == 1, F.lit(1))
    for step in SLOT_STEPS:
        hours = hours.when(days.between(1, 14) & (days * 24 / step <= _slot_target(width)), F.lit(step))
    return hours.otherwise(F.lit(24))


def slot_label(date: Column, hour: Column, hours: Column, days: Column) -> Column:
    """The slot a date and hour label fall into."""
    number = hour.try_cast("int")
    start = F.concat(F.lpad((F.floor(number / hours) * hours).cast("string"), 2, "0"), F.lit(":00"))
    intraday = F.when(days == 1, start).otherwise(F.concat(date.cast("string"), F.lit("T"), start))
    return F.when(hours == 24, date.cast("string")).otherwise(F.coalesce(intraday, F.lit(UNKNOWN_HOUR)))
