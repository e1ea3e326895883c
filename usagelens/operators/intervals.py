"""Response intervals from ordered conversation-log events, as window expressions.

Events: ``reset``, ``start`` (a task start), ``input``, ``output``, ``call``
(output that opens a tool call), ``result`` (input that closes one), ``usage``
(a usage record) and ``count`` (a token count, which may mirror the record
before it). A response runs from the last input before its first output to its
last output, and a usage event ends it.

A session may hold a large share of all rows. It is first cut into turns at the
resets by chunked running counts; every window then stays within one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.operators.prefix import previous_value, running_sums

CHUNK = 100_000
CALL_EVENTS = ("call", "result")


def turns(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Number the turns of each session, and its usage records so far."""
    starts = F.col("event").isin("reset", "start").cast("bigint")
    records = (F.col("event") == "usage").cast("bigint")
    return running_sums(
        events, ["session_id"], F.floor(F.col("ordinal") / chunk), [F.col("ordinal")], {"turn": starts, "record": records}
    )


def open_calls(events: DataFrame) -> DataFrame:
    """Open tool calls after and before each event.

    A call counts when it is not open yet and a result when it is, so repeats of
    one call id change nothing.
    """
    same_call = Window.partitionBy("session_id", "turn", "call_id", F.col("event").isin(*CALL_EVENTS)).orderBy("ordinal")
    previous = F.lag("event").over(same_call)
    opens = (F.col("event") == "call") & ~F.coalesce(previous == "call", F.lit(False))
    closes = (F.col("event") == "result") & F.coalesce(previous == "call", F.lit(False))
    changed = events.withColumn("_change", F.when(opens, 1).when(closes, -1).otherwise(0))
    along = Window.partitionBy("session_id", "turn").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return changed.withColumn("_open", F.sum("_change").over(along)).withColumn(
        "_open_before", F.col("_open") - F.col("_change")
    )


def _same_usage() -> Column:
    return F.struct("input_tokens", "output_tokens", F.coalesce("cached_input_tokens", F.lit(0).cast("bigint")).alias("cached"))


def live_mirrors(rows: DataFrame) -> DataFrame:
    """Live reading: the first count after a record that repeats its usage is its mirror."""
    since = Window.partitionBy("session_id", "record").orderBy("ordinal")
    recorded = F.first(F.when(F.col("event") == "usage", _same_usage()), ignorenulls=True).over(
        since.rowsBetween(Window.unboundedPreceding, 0)
    )
    repeats = (F.col("event") == "count") & F.coalesce(recorded == _same_usage(), F.lit(False))
    counted = F.sum(repeats.cast("int")).over(since.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_mirror", repeats & (counted == 1))


def response_intervals(events: DataFrame, live: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row per reported usage with its response interval, null where none is reliable.

    In live reading a task start is an input of its own, and only a count that
    repeats a record's usage is its mirror. In history a task start only resets
    and any count after a record mirrors it.
    """
    turn = Window.partitionBy("session_id", "turn").orderBy("ordinal")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    is_input = F.col("event").isin("input", "result")
    if live:
        is_input = is_input | (F.col("event") == "start")
    is_output = F.col("event").isin("output", "call")
    reports = F.col("event").isin("usage", "count")
    numbered = turns(events, chunk)
    # A count that mirrors a record closes nothing itself.
    if live:
        rows = open_calls(live_mirrors(numbered))
    else:
        last_report = F.last(F.when(reports, F.col("event")), ignorenulls=True).over(before)
        mirror = (F.col("event") == "count") & F.coalesce(last_report == "usage", F.lit(False))
        rows = open_calls(numbered).withColumn("_mirror", mirror)
    rows = rows.withColumn("_closes", reports & ~F.col("_mirror"))
    rows = rows.withColumns(
        {
            "_segment": F.coalesce(F.sum(F.col("_closes").cast("int")).over(before), F.lit(0)),
            "_island": F.sum(is_input.cast("int")).over(so_far),
        }
    )
    segment = Window.partitionBy("session_id", "turn", "_segment").orderBy("ordinal").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = rows.withColumn("_end", F.last(F.when(is_output, F.col("stamp")), ignorenulls=True).over(segment))
    # The last input is null while calls are open; a usage event clears it unless it came after the output.
    island = Window.partitionBy("session_id", "turn", "_island").orderBy("ordinal")
    entered = F.first(F.when(is_input & (F.col("_open") == 0), F.col("stamp"))).over(
        island.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_input", entered)
    spent = F.col("_closes") & (F.col("_end").isNull() | (F.col("_input") <= F.col("_end")))
    cleared = F.coalesce(F.max(spent).over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    ready = is_output & (F.col("_open_before") == 0) & ~cleared
    rows = rows.withColumn("_boundary", F.when(ready, F.col("_input")))
    rows = rows.withColumn("_start", F.first("_boundary", ignorenulls=True).over(segment))
    valid = F.col("_closes") & (F.col("_end") > F.col("_start"))
    rows = rows.withColumns({"_from": F.when(valid, F.col("_start")), "_to": F.when(valid, F.col("_end"))})
    # A mirror reports its record's interval when both name the same usage.
    use = _same_usage()
    recorded = F.last(F.when(F.col("event") == "usage", F.struct(use.alias("use"), "_from", "_to")), ignorenulls=True).over(before)
    rows = rows.withColumns({"_use": use, "_record": recorded})
    agrees = F.col("_record.use").eqNullSafe(F.col("_use"))
    start = F.when(F.col("_mirror"), F.when(agrees, F.col("_record._from"))).otherwise(F.col("_from"))
    end = F.when(F.col("_mirror"), F.when(agrees, F.col("_record._to"))).otherwise(F.col("_to"))
    return rows.where(reports).select(
        "session_id", "turn", "ordinal", "event", F.col("_mirror").alias("mirror"),
        F.floor("stamp").alias("second"), "stamp", "input_tokens", "output_tokens",
        F.coalesce("cached_input_tokens", F.lit(0).cast("bigint")).alias("cached_input_tokens"),
        "model", "response_id", start.alias("start"), end.alias("end"),
        ((end - start) * 1000).alias("duration_ms"),
    )


def counted_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals as history joins them: token counts only, which every log has."""
    return intervals.where("event = 'count'")


def drop_repeats(events: DataFrame, total: Column, order: str, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Drop counter events whose cumulative total equals the one before in the group."""
    found = previous_value(events, keys, F.floor(F.col(order) / chunk), [order], total, "_previous")
    return found.where(~F.coalesce(total == F.col("_previous"), F.lit(False))).drop("_previous")


def message_intervals(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Response intervals of logs of kind B, one row per session and message.

    Events are ``input`` (a user line), ``result`` and ``call`` (tool blocks of a
    line, with ``part`` as their place in it), ``output`` (an assistant line),
    ``failed`` (an error line) and ``stop``. Several lines of one message keep the
    first line's input boundary and the largest token count.
    """
    order = [F.col("ordinal"), F.col("part")]
    # Events without a call need no previous one; their part of the key only spreads them.
    place = F.when(F.col("event").isin(*CALL_EVENTS), F.lit(-1)).otherwise(F.floor(F.col("ordinal") / chunk))
    same_call = Window.partitionBy("session_id", "call_id", place).orderBy(*order)
    previous = F.lag("event").over(same_call)
    opens = (F.col("event") == "call") & ~F.coalesce(previous == "call", F.lit(False))
    closes = (F.col("event") == "result") & F.coalesce(previous == "call", F.lit(False))
    rows = events.withColumn("_change", F.when(opens, 1).when(closes, -1).otherwise(0).cast("bigint"))
    is_input = F.col("event") == "input"
    rows = running_sums(
        rows, ["session_id"], F.floor(F.col("ordinal") / chunk), order,
        {"_open": F.col("_change"), "_island": is_input.cast("bigint")},
    )
    island = Window.partitionBy("session_id", "_island").orderBy(*order)
    entered = F.first(F.when(is_input & (F.col("_open") == 0), F.col("stamp"))).over(
        island.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_input", entered)
    reported = (F.col("event") == "output") & (F.col("output_tokens") > 0)
    spent = (reported & (F.col("_input") <= F.col("stamp"))) | F.col("event").isin("failed", "stop")
    cleared = F.coalesce(F.max(spent).over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    boundary = F.when(~cleared & (F.col("_open") == 0), F.col("_input"))
    lines = rows.withColumn("_boundary", boundary).where(
        (F.col("event") == "output") & U.usable_identity(F.col("message_id")).isNotNull()
    )
    position = F.struct(*order)
    messages = lines.groupBy("session_id", "message_id").agg(
        F.min(F.struct("ordinal", "part", "_boundary")).alias("_first"),
        F.max(F.when(F.col("output_tokens") > 0, F.struct("output_tokens", "stamp"))).alias("_best"),
        F.max_by("model", position).alias("model"),
        F.max_by("provider", position).alias("provider"),
    )
    start, end = F.col("_first._boundary"), F.col("_best.stamp")
    timed = start < end
    return messages.where("_best IS NOT NULL").select(
        "session_id", "message_id", "model", "provider", F.col("_best.output_tokens").alias("output_tokens"),
        end.alias("stamp"), F.when(timed, start).alias("start"), F.when(timed, end).alias("end"),
        F.when(timed, (end - start) * 1000).alias("duration_ms"),
    )
