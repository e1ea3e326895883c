"""Pairing of response boundaries into intervals, by response id or by session order.

Boundaries with one response id belong together. What has no partner of its id
pairs in the order of its session if that session has boundaries without ids.

Within one pair key, completions cut the events into groups: the starts since the
last completion belong to the next one. An open start is forgotten after half an
hour, so a longer pause cuts, too. A group has one reliable start when it holds a
single start, or a request followed only by response starts. Group numbers are
chunked running counts and groups are plain aggregates, so no session is held in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.enrich import spread_nulls
from usagelens.operators.prefix import previous_within, running_sums

# Fixed values, in seconds: late output, and how long an open start is kept.
LATE_S = 5
MAX_AGE_S = 1800
CREATED, COMPLETED = "response.created", "response.completed"


def sort_events(events: DataFrame) -> DataFrame:
    """An order in which starts come before ends of the same moment."""
    return events.withColumn("_done", (F.col("kind") == COMPLETED).cast("int"))


def _with_pair_key(events: DataFrame) -> DataFrame:
    """Adds ``pair_key``: the response id where it has a start and an end, else the session if it has events without id."""
    done = F.col("kind") == COMPLETED
    whole = events.where("response_key IS NOT NULL").groupBy("response_key").agg(
        F.bool_or(done).alias("_ended"), F.bool_or(~done).alias("_begun")
    )
    whole = whole.where("_ended AND _begun").select("response_key", F.lit(True).alias("_whole"))
    loose = events.where("response_key IS NULL AND session_key IS NOT NULL").select("session_key", F.lit(True).alias("_loose")).distinct()
    by_id, by_session = F.concat(F.lit("r:"), F.col("response_key")), F.concat(F.lit("s:"), F.col("session_key"))
    # Boundaries without an id spread over all partitions of both joins.
    spread = F.struct("stamp", "kind", "received_at", "output_tokens", "session_key", "response_key")
    keyed = events.withColumns({f"_{k}": spread_nulls(F.col(k), spread) for k in ("response_key", "session_key")})
    marked = keyed.join(whole.withColumnRenamed("response_key", "_response_key"), "_response_key", "left")
    marked = marked.join(loose.withColumnRenamed("session_key", "_session_key"), "_session_key", "left")
    key = F.when(F.col("_whole"), by_id).when(F.col("_loose"), by_session).otherwise(by_id)
    return marked.withColumn("pair_key", key).select(*events.columns, "pair_key")


def _without_repeats(events: DataFrame) -> DataFrame:
    """Drop repeated exports: equal starts, later ends of one response, equal ends of a session."""
    keyed = F.col("_done") == 1
    repeat = F.when(keyed & F.col("response_key").isNotNull(), F.lit(None).cast("double")).otherwise(F.col("stamp"))
    tokens = F.when(keyed & F.col("response_key").isNull(), F.coalesce("output_tokens", F.lit(-1)))
    fields = ["stamp", "start_origin", "received_at", "output_tokens", "session_key", "response_key", "provider", "model"]
    return (
        events.groupBy("pair_key", "_done", repeat.alias("_at"), tokens.alias("_tokens"), F.when(keyed, F.col("response_key")).alias("_id"))
        .agg(F.min(F.struct(*fields)).alias("e"))
        .select("pair_key", "_done", "e.*")
    )


def pair_in_order(events: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Pair events under their ``pair_key``."""
    distinct = _without_repeats(sort_events(events))
    near = previous_within(distinct, ["pair_key"], "stamp", ["_done", "output_tokens"], ["_done"], MAX_AGE_S, max(chunk_s, MAX_AGE_S))
    order = [F.col("stamp"), F.col("_done"), F.coalesce("output_tokens", F.lit(-1))]
    steps = {"_ends": F.col("_done").cast("bigint"), "_pauses": F.col("previous").isNull().cast("bigint")}
    counted = running_sums(near, ["pair_key"], F.floor(F.col("stamp") / chunk_s), order, steps)
    group = F.struct((F.col("_ends") - F.col("_done")).alias("ends"), F.col("_pauses").alias("pauses"))
    created = F.col("_done") == 0
    opened = F.when(created, F.struct("stamp", "start_origin", "session_key", "provider", "model", "received_at", "response_key"))
    ended = F.when(
        ~created, F.struct("stamp", "output_tokens", "session_key", "response_key", "provider", "model", "received_at")
    )
    groups = counted.groupBy("pair_key", group.alias("_group")).agg(
        F.min(opened).alias("s"),
        F.count_if(created).alias("_starts"),
        F.count_if(created & (F.col("start_origin") == "request")).alias("_requests"),
        F.max(ended).alias("c"),
    )
    single = (F.col("_starts") == 1) | ((F.col("s.start_origin") == "request") & (F.col("_requests") == 1))
    return _judged(groups.withColumn("_single", F.coalesce(single, F.lit(False))))


def _judged(groups: DataFrame) -> DataFrame:
    done = F.col("c").isNotNull()
    elapsed = F.col("c.stamp") - F.col("s.stamp")
    other = F.coalesce(F.col("s.response_key") != F.col("c.response_key"), F.lit(False))
    timed = F.col("_single") & (elapsed > 0) & (elapsed <= MAX_AGE_S) & ~other
    same = F.col("s.session_key").eqNullSafe(F.col("c.session_key"))
    status = (
        F.when(~done & F.col("_single"), "awaiting_usage")
        .when(~done, "missing_timing")
        .when(F.col("c.output_tokens").isNull(), "awaiting_usage")
        .when(F.col("c.output_tokens") == 0, "empty")
        .when(~F.coalesce(timed, F.lit(False)), "missing_timing")
        .when(~same, "ambiguous_identity")
        .when(F.col("c.stamp") < F.col("c.received_at") - LATE_S, "late")
        .otherwise("measured")
    )
    part = {n: F.coalesce(F.col(f"c.{n}"), F.col(f"s.{n}")) for n in ("session_key", "response_key", "provider", "model", "received_at")}
    kept = status.isin("measured", "late")
    return groups.select(
        *[part[n].alias(n) for n in ("session_key", "response_key", "provider", "model")],
        F.col("c.output_tokens").alias("output_tokens"),
        F.when(kept, F.col("s.stamp")).alias("start"),
        F.coalesce(F.col("c.stamp"), F.col("s.stamp")).alias("end"),
        part["received_at"].alias("received_at"),
        status.alias("status"),
    )


def pair_responses(events: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """One row per completion and per open start, with its interval and status."""
    nobody = F.col("session_key").isNull() & F.col("response_key").isNull()
    lost = events.where(nobody).select(
        "session_key", "response_key", "provider", "model", "output_tokens",
        F.lit(None).cast("double").alias("start"), F.col("stamp").alias("end"), "received_at",
        F.lit("ambiguous_identity").alias("status"),
    )
    return pair_in_order(_with_pair_key(events.where(~nobody)), chunk_s).unionByName(lost)


def measured_samples(paired: DataFrame) -> DataFrame:
    """Samples from measured pairs, in time to count."""
    return paired.where("status = 'measured'").select(
        F.coalesce("response_key", F.sha2(F.concat_ws("|", "session_key", F.col("end").cast("string"), "output_tokens"), 256)).alias("event_key"),
        "session_key", F.lit("codex").alias("runtime"), "provider", "model", "output_tokens", "start", "end",
        F.lit("codex_otel").alias("basis"), "received_at",
    )


def status_counts(paired: DataFrame) -> DataFrame:
    return paired.groupBy("status").agg(F.count(F.lit(1)).alias("responses"), F.sum("output_tokens").alias("output_tokens"))
