"""Minute history of rates, usage and receipts, and its resampling to 120 buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.prefix import previous_within

# History ranges in seconds, the longest being the retention.
RANGES = (600, 3600, 10800, 21600, 43200, 86400, 259200, 604800, 1209600, 2419200)
RETENTION = RANGES[-1]
BUCKETS = 120
# A longer pause between readings, or clocks that moved apart, is a gap.
MAX_PAUSE_S = 2.5
MAX_SKEW_S = 1.0


def _usable(rate: Column) -> Column:
    return F.when((rate >= 0) & ~F.isnan(rate) & (rate < float("inf")), rate)


def integrate_rates(readings: DataFrame, cell_s: int = 60, chunk_s: int = 3600) -> DataFrame:
    """Time-weighted integrals of rate readings per series and cell.

    A reading holds until the next one; a pause or a clock jump is a gap and adds
    nothing.
    """
    fields = ["monotonic", "total_tps", "average_tps", "status"]
    pairs = previous_within(readings, ["series"], "wall", ["reading_id"], fields, MAX_PAUSE_S + MAX_SKEW_S, chunk_s)
    elapsed = F.col("monotonic") - F.col("previous.monotonic")
    pairs = pairs.withColumn("_elapsed", elapsed).where(
        (F.col("_elapsed") > 0)
        & (F.col("_elapsed") <= MAX_PAUSE_S)
        & (F.abs(F.col("wall") - F.col("previous._time") - F.col("_elapsed")) <= MAX_SKEW_S)
    )
    spans = pairs.select(
        "series",
        (F.col("wall") - F.col("_elapsed")).alias("_start"),
        F.col("wall").alias("_stop"),
        _usable(F.col("previous.total_tps")).alias("_total"),
        _usable(F.col("previous.average_tps")).alias("_average"),
        (F.coalesce(F.col("previous.status"), F.lit("")) != "complete").alias("_partial"),
    )
    cells = spans.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_start") / cell_s), F.ceil(F.col("_stop") / cell_s) - 1))
    )
    span = F.least(F.col("_stop"), (F.col("_cell") + 1) * cell_s) - F.greatest(F.col("_start"), F.col("_cell") * cell_s)
    cells = cells.withColumn("_span", span)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0.0))

    def covered(rate: str) -> Column:
        return F.least(F.lit(float(cell_s)), total(F.when(F.col(rate).isNotNull(), F.col("_span"))))

    return cells.groupBy("series", (F.col("_cell") * cell_s).alias("minute")).agg(
        total(F.col("_total") * F.col("_span")).alias("total_integral"),
        covered("_total").alias("total_covered_s"),
        total(F.col("_average") * F.col("_span")).alias("average_integral"),
        covered("_average").alias("average_covered_s"),
        F.least(F.lit(float(cell_s)), total(F.when(F.col("_partial"), F.col("_span")))).alias("partial_s"),
    )


def upsert_usage(old: DataFrame, new: DataFrame, begin: int, end: int, partial: bool, available: bool = True, step: int = 60) -> DataFrame:
    """Known token counts per slot after an absolute report for [begin, end).

    A full report replaces; slots it does not name are zero. A partial report can
    only raise a known count. A failed one changes nothing.
    """
    if not available:
        return old
    spark = old.sparkSession
    grid = spark.range(begin, end, step).select(F.col("id").alias("slot"))
    reported = grid.join(new.select("slot", F.col("tokens").alias("_new")), "slot", "left").select(
        "slot", F.coalesce("_new", F.lit(0)).alias("_new")
    )
    joined = old.join(reported, "slot", "full")
    inside = F.col("_new").isNotNull()
    known = F.coalesce("known", F.lit(False))
    if partial:
        keeps = known & (F.col("_new") <= F.col("tokens"))
        tokens = F.greatest(F.coalesce("tokens", F.lit(0)), F.col("_new"))
        now_partial = F.when(keeps, F.col("partial")).otherwise(F.lit(True))
    else:
        tokens, now_partial = F.col("_new"), F.lit(False)
    return joined.select(
        "slot",
        F.when(inside, tokens).otherwise(F.col("tokens")).alias("tokens"),
        F.when(inside, F.lit(True)).otherwise(known).alias("known"),
        F.when(inside, now_partial).otherwise(F.col("partial")).alias("partial"),
    )


def upsert_days(old: DataFrame, new: DataFrame, begin_day: Column, end_day: Column, partial: bool) -> DataFrame:
    """Day-only counts: a full report zeroes days it now has in detail; a partial one only raises."""
    joined = old.join(new.withColumnRenamed("tokens", "_new"), "date", "full")
    tokens, fresh = F.col("tokens"), F.col("_new")
    if partial:
        value = F.greatest(tokens, fresh)
    else:
        inside = (F.col("date") >= begin_day) & (F.col("date") < end_day)
        value = F.coalesce(fresh, F.when(inside, F.lit(0)).otherwise(tokens))
    return joined.select("date", value.cast("bigint").alias("tokens"))


def latest_per_key(journal: DataFrame, keys: list[str], sequence: str, cutoff: int | None = None) -> DataFrame:
    """The last record per key of an append-only journal, within the retention."""
    rows = journal if cutoff is None else journal.where(F.col("minute") >= cutoff)
    fields = [c for c in journal.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *[c for c in fields if c != sequence])).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in fields])


def retention_cutoff(now: float) -> int:
    return int((now - RETENTION) // 60) * 60


def bucket_bounds(period: int, now: float) -> tuple[int, int, int]:
    """First second, end and width of the 120 buckets of a range."""
    if period not in RANGES:
        raise ValueError("No such history range")
    step = period // BUCKETS
    alignment = min(60, step)
    end = math.floor(now / alignment) * alignment + alignment
    return end - period, end, step


def _grid(rows: DataFrame, begin: int, end: int, step: int) -> DataFrame:
    starts = F.sequence(F.lit(begin).cast("bigint"), F.lit(end - step).cast("bigint"), F.lit(step).cast("bigint"))
    return rows.select("series").distinct().withColumn("bucket", F.explode(starts))


def _overlapping(stamp: Column, span: Column, begin: int, end: int, step: int) -> Column:
    """Starts of the buckets that [stamp, stamp + span) overlaps."""
    first = F.greatest(F.lit(0), F.floor((stamp - begin) / step))
    last = F.least(F.lit((end - begin) // step), F.ceil((stamp + span - begin) / step)) - 1
    return F.transform(F.when(last >= first, F.sequence(first, last)), lambda i: i * step + begin)


def history_buckets(
    minutes: DataFrame, period: int, now: float, fine_rates: DataFrame | None = None, fine_usage: DataFrame | None = None
) -> DataFrame:
    """120 buckets per series: rates are split in proportion, counts stay whole.

    Finer rates replace minute means up to one-minute buckets. Five-second counts
    replace a minute's count only when they add up to it.
    """
    begin, end, step = bucket_bounds(period, now)
    rows = minutes.where((F.col("minute") + 60 > begin) & (F.col("minute") < end))
    nothing = F.lit(None)
    use_fine = fine_rates is not None and step <= 60
    if use_fine:
        fine_minutes = fine_rates.select("series", (F.floor(F.col("minute") / 60) * 60).alias("minute"), F.lit(True).alias("_has_fine")).distinct()
        rows = rows.join(fine_minutes, ["series", "minute"], "left")
    else:
        rows = rows.withColumn("_has_fine", nothing.cast("boolean"))
    spread = rows.withColumn("bucket", F.explode(_overlapping(F.col("minute"), F.lit(60), begin, end, step)))
    share = (F.least(F.col("minute") + 60, F.col("bucket") + step) - F.greatest("minute", "bucket")) / 60
    coarse = F.col("_has_fine").isNull()
    fields = ("total_integral", "total_covered_s", "average_integral", "average_covered_s")
    rates = spread.groupBy("series", "bucket").agg(
        *[F.sum(F.when(coarse, F.col(c) * share)).alias(c) for c in fields],
        F.bool_or(coarse & (F.col("total_covered_s") > 0) & F.lit(step < 60)).alias("coarse_rate"),
        F.bool_or((F.col("partial_s") > 0) | F.coalesce("usage_partial", F.lit(False))).alias("_partial"),
    )

    known = rows.where("usage_known").select("series", "minute", "tokens")
    own = F.floor((F.col("minute") - begin) / step) * step + begin
    whole = known.where(F.col("minute") >= begin).select(
        "series", own.alias("bucket"), "tokens", F.lit(step < 60).alias("coarse_tokens"), F.lit(False).alias("_late"), "minute"
    )
    if fine_usage is not None:
        detail = fine_usage.withColumn("minute", F.floor(F.col("slot") / 60) * 60)
        sums = detail.groupBy("series", "minute").agg(F.sum("tokens").alias("_sum"))
        agreed = known.join(sums, ["series", "minute"]).where("tokens = _sum").select("series", "minute")
        fine_rows = detail.join(agreed, ["series", "minute"], "left_semi").where((F.col("slot") >= begin) & (F.col("slot") < end))
        fine_own = F.floor((F.col("slot") - begin) / step) * step + begin
        whole = whole.join(agreed, ["series", "minute"], "left_anti").unionByName(
            fine_rows.select("series", fine_own.alias("bucket"), "tokens", F.lit(False).alias("coarse_tokens"),
                             F.coalesce("partial", F.lit(False)).alias("_late"), "minute")
        )
    counts = whole.groupBy("series", "bucket").agg(
        F.sum("tokens").alias("tokens"), F.bool_or("coarse_tokens").alias("coarse_tokens"), F.bool_or("_late").alias("_late")
    )
    out = _grid(minutes, begin, end, step).join(rates, ["series", "bucket"], "left").join(counts, ["series", "bucket"], "left")
    false = F.lit(False)
    values = {c: F.coalesce(c, F.lit(0.0)) for c in fields}
    partial = F.coalesce("_partial", false) | F.coalesce("_late", false)
    coarse_rate = F.coalesce("coarse_rate", false)
    if use_fine:
        finer = fine_rates.where((F.col("minute") >= begin) & (F.col("minute") < end)).groupBy(
            "series", (F.floor((F.col("minute") - begin) / step) * step + begin).alias("bucket")
        ).agg(*[F.sum(c).alias(f"_f_{c}") for c in fields], F.bool_or(F.col("partial_s") > 0).alias("_f_partial"))
        out = out.join(finer, ["series", "bucket"], "left")
        values = {c: F.coalesce(F.col(f"_f_{c}"), v) for c, v in values.items()}
        partial = partial | F.coalesce("_f_partial", false)
        coarse_rate = coarse_rate & F.col("_f_total_integral").isNull()
    observed = values["total_covered_s"]
    expected = F.least(F.lit(float(step)), F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("bucket")))
    return out.select(
        "series", F.col("bucket").alias("start"),
        (values["total_integral"] / F.nullif(observed, F.lit(0.0))).alias("total_tps"),
        (values["average_integral"] / F.nullif(values["average_covered_s"], F.lit(0.0))).alias("average_tps"),
        "tokens", observed.alias("observed_seconds"), coarse_rate.alias("coarse_rate"),
        F.coalesce("coarse_tokens", false).alias("coarse_tokens"),
        (partial | (observed < expected - 1)).alias("partial"),
    )


def untimed_tokens(days: DataFrame, period: int, now: float) -> DataFrame:
    """Tokens of whole days inside a range that have no time of day."""
    begin, _, _ = bucket_bounds(period, now)
    stamp = F.unix_date("date") * 86400
    return days.where((stamp >= begin) & (stamp + 86400 <= now)).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("day_only_tokens")
    )


def receipt_minutes(seconds: DataFrame) -> DataFrame:
    """Minute rows from one-second receipt bins."""
    return seconds.groupBy("series", (F.floor(F.col("second") / 60) * 60).alias("minute")).agg(
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("observed").cast("double")).alias("observed_s"),
        F.sum(F.col("partial").cast("double")).alias("partial_s"),
    )


def receipt_buckets(minutes: DataFrame, seconds: DataFrame, period: int, now: float) -> DataFrame:
    """120 buckets of received output; the divisor is always the whole bucket.

    Seconds are used where they add up to their minute. Otherwise the minute is
    spread evenly, the current one only over the time that has passed.
    """
    begin, end, step = bucket_bounds(period, now)
    rows = minutes.where((F.col("minute") + 60 > begin) & (F.col("minute") < end))
    sums = receipt_minutes(seconds).select(
        "series", "minute", *[F.col(c).alias(f"_{c}") for c in ("output_tokens", "observed_s", "partial_s")]
    )
    agreed = rows.join(sums, ["series", "minute"]).where(
        "output_tokens = _output_tokens AND observed_s = _observed_s AND partial_s = _partial_s"
    ).select("series", "minute")
    detail = seconds.withColumn("minute", F.floor(F.col("second") / 60) * 60).join(agreed, ["series", "minute"], "left_semi")
    passed = F.greatest(F.lit(1.0), F.floor(F.lit(float(now)) - F.col("minute")).cast("double"), F.col("observed_s"), F.col("partial_s"))
    parts = detail.select(
        "series", F.col("second").alias("stamp"), F.lit(1.0).alias("span"), "output_tokens",
        F.col("observed").cast("double").alias("observed_s"), F.col("partial").cast("double").alias("partial_s"),
        F.lit(False).alias("coarse"),
    ).unionByName(
        rows.join(agreed, ["series", "minute"], "left_anti").select(
            "series", F.col("minute").alias("stamp"), F.least(F.lit(60.0), passed).alias("span"), "output_tokens",
            "observed_s", "partial_s", F.lit(step < 60).alias("coarse"),
        )
    )
    spread = parts.withColumn("bucket", F.explode(_overlapping(F.col("stamp"), F.col("span"), begin, end, step)))
    share = (F.least(F.col("stamp") + F.col("span"), F.col("bucket") + step) - F.greatest("stamp", "bucket")) / F.col("span")
    seen = (F.col("output_tokens") > 0) | (F.col("observed_s") > 0)
    grouped = spread.groupBy("series", "bucket").agg(
        F.sum(F.when(seen, F.col("output_tokens") * share)).alias("output_tokens"),
        F.sum(F.col("observed_s") * share).alias("observed_seconds"),
        F.bool_or("coarse").alias("coarse"),
        F.bool_or(F.col("partial_s") > 0).alias("_partial"),
    )
    out = _grid(minutes, begin, end, step).join(grouped, ["series", "bucket"], "left")
    observed = F.coalesce("observed_seconds", F.lit(0.0))
    return out.select(
        "series", F.col("bucket").alias("start"), "output_tokens", (F.col("output_tokens") / step).alias("receipt_tps"),
        observed.alias("observed_seconds"), F.coalesce("coarse", F.lit(False)).alias("coarse_receipts"),
        (F.coalesce("_partial", F.lit(False)) | (observed < step)).alias("partial"),
    )
