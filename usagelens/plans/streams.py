"""Registered streaming queries: the given tables read as streams to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.plans.columns import flat
from usagelens.plans.enrichment_sql import evidence
from usagelens.plans.history_sql import COUNTS
from usagelens.plans.report_sql import BASE, _b
from usagelens.plans.telemetry_sql import telemetry
from usagelens.session import new_path
from usagelens.sources import adapters, otlp
from usagelens.streaming import average_state, follow, growing, jobs, log_state, message_state, pairing_state, receipts_state, usage_state

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: The moment from which streamed rows count, in seconds.
SINCE, TRACED = 820_000_000, 1_704_200_000


def _events(spark: SparkSession, sf: str, max_files: int = 1000) -> DataFrame:
    return follow.follow_files(spark, f"{sf}/events.parquet", EVENTS, max_files=max_files)


def _journal(spark: SparkSession, sf: str, rows: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    return follow.run_available(rows(_events(spark, sf)), name)


def stream_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of paired responses from streamed boundary events."""
    rows = jobs.pairs(_journal(spark, sf, adapters.telemetry_events, "pairs"))
    return rows.groupBy("session_key", "status").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("output_tokens").alias("output_tokens")
    )


def _repeated(events: DataFrame) -> DataFrame:
    """Samples one key a copy, every third twice, every fiftieth ten seconds late."""
    samples = adapters.samples_of(events)
    delay = F.when(F.col("output_tokens") % 50 == 0, 10.0).otherwise(0.0)
    times = F.when(F.col("output_tokens") % 3 == 0, 2).otherwise(1)
    return samples.withColumns(
        {
            "event_key": F.concat("event_key", F.lit("/"), "model"),
            "sampled_at": F.col("sampled_at") + delay,
            "received_at": F.col("received_at") + delay,
            "copy": F.explode(F.sequence(F.lit(1), times)),
        }
    ).drop("copy")


def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per second and session, each sample once."""
    return flat(jobs.rates(_journal(spark, sf, _repeated, "rates"))[0])


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """What arrived too late for the rates."""
    return jobs.rates(_journal(spark, sf, _repeated, "late"))[1]


def stream_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Counted output per arrival second after all corrections."""
    return jobs.receipts(_journal(spark, sf, adapters.samples_of, "receipts"))


def stream_otlp(spark: SparkSession, sf: str) -> DataFrame:
    """Flattened packets of a stream, counted by kind."""

    def flattened(events: DataFrame) -> DataFrame:
        found = otlp.response_events(otlp.flatten_otlp(adapters.packets_of(events)))
        return found.select("session_key", "kind", "start_origin", "output_tokens")

    rows = _journal(spark, sf, flattened, "otlp")
    return rows.groupBy("kind", "start_origin").agg(
        F.count(F.lit(1)).alias("events"), F.sum("output_tokens").alias("output_tokens")
    )


def stream_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Output per day and app of ledger rows that land as files; each request once over all hosts."""
    landed = new_path(spark, "landed-requests")
    adapters.requests(spark, sf).write.parquet(landed)
    rows = jobs.minutes(follow.run_available(follow.follow_requests(spark, landed, SINCE), "minutes"))
    day = (F.floor(F.col("minute") / 86400) * 86400).alias("day")
    return rows.groupBy(day, "app_type").agg(F.sum("output_tokens").alias("output_tokens"), F.sum("requests").alias("requests"))


def stream_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Last traced activity of sessions, from a trace table that lands as files."""
    landed = new_path(spark, "landed-trace")
    adapters.trace(spark, sf).write.parquet(landed)
    rows = follow.run_available(follow.follow_trace(spark, landed, float(TRACED)), "trace")
    return flat(rows.groupBy("session_key").agg(F.max("stamp").alias("stamp"), F.count(F.lit(1)).alias("events")))


def _landed_boundaries(spark: SparkSession, sf: str) -> str:
    """Boundary events as files, and a heartbeat two hours after the last of them."""
    events = adapters.telemetry_events(adapters.table(spark, sf, "events")).drop("event_id")
    events = events.withColumn("response_key", F.when(F.col("session_key").isNotNull(), F.col("response_key")))
    landed = new_path(spark, "landed-boundaries")
    events.write.parquet(landed)
    later = (F.max(F.greatest("stamp", "received_at")) + 7200).alias("received_at")
    beat = events.agg(later).where("received_at IS NOT NULL").withColumn("kind", F.lit(pairing_state.HEARTBEAT))
    rest = {f.name: F.lit(None).cast(f.dataType) for f in events.schema.fields if f.name not in beat.columns}
    beat.withColumns(rest).select(*events.columns).write.mode("append").parquet(landed)
    return landed


def stream_pair_state(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of boundaries paired in state by conversation, open ones reported by timers."""
    kinds = "session_key string, response_key string, kind string, start_origin string, stamp double, received_at double, output_tokens bigint, provider string, model string"
    rows = follow.follow_files(spark, _landed_boundaries(spark, sf), kinds)
    paired = follow.run_available(pairing_state.pair_stream(rows), "pair-state").drop("batch")
    return flat(paired.select("session_key", "response_key", "provider", "model", "output_tokens", "start", "end", "status"))


def _changes(spark: SparkSession, sf: str, samples: DataFrame) -> str:
    """The journal of signed changes of counted output."""
    standing, changes = new_path(spark, "standing"), new_path(spark, "changes")
    stands = receipts_state.follow_authority(samples)
    follow.append_available(stands, standing, new_path(spark, "standing-progress"))
    credited = receipts_state.follow_credits(follow.follow_journal(standing, stands))
    follow.append_available(credited, changes, new_path(spark, "changes-progress"))
    return changes


def stream_credits(spark: SparkSession, sf: str) -> DataFrame:
    """Counted output per arrival second, summed from signed changes."""
    changes = _changes(spark, sf, adapters.samples_of(_events(spark, sf)))
    return receipts_state.second_totals(spark.read.parquet(changes))


def stream_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The newest total of each second, from the feed of corrections."""
    changes = follow.follow_journal(_changes(spark, sf, adapters.samples_of(_events(spark, sf))), spark.createDataFrame([], receipts_state.CHANGE))
    feed = follow.run_available(receipts_state.follow_seconds(changes), "corrections", "update")
    return follow.corrected(feed, ["second"]).where("arrivals > 0").select("second", "output_tokens", "excluded")


def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    """Output per app of streamed ledger rows, repeats found in bounded state; what fell behind is counted apart."""
    landed = new_path(spark, "landed-requests")
    adapters.requests(spark, sf).write.parquet(landed)
    keys = ["app_type", "request_id"]
    rows = follow.follow_requests(spark, landed, SINCE).select(*keys, "created_at", "output_tokens")
    journal = follow.run_available(rows, "polled").drop("batch")
    once = follow.run_available(follow.first_within(rows, keys, "created_at", "30 minutes"), "once").drop("batch")
    behind = follow.left_behind(journal, once, keys)
    counted = once.withColumn("behind", F.lit(False)).unionByName(behind.withColumn("behind", F.lit(True)))
    return counted.groupBy("app_type", "behind").agg(F.count(F.lit(1)).alias("requests"))


def stream_log_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Response times of conversation logs whose lines arrive as a stream."""
    events = adapters.conversation_events(spark, sf)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    rest = {"total": text, "thread_id": text, "model_provider": text, "inherited_until": number}
    lines = events.withColumnRenamed("session_id", "file").withColumns({**rest, "session_id": text})
    first = lines.select("file").distinct().withColumns({f.name: F.lit(None).cast(f.dataType) for f in lines.schema.fields if f.name != "file"})
    first = first.withColumns({"ordinal": F.lit(-1).cast(lines.schema["ordinal"].dataType), "event": F.lit("header"), "session_id": F.col("file"), "inherited_until": F.lit(-1).cast("bigint")})
    landed = new_path(spark, "landed-lines")
    numbered = lines.unionByName(first.select(*lines.columns)).withColumn("ordinal", F.col("ordinal").cast("bigint") + 1)
    numbered.write.parquet(landed)
    stream = follow.follow_files(spark, landed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields))
    found = follow.run_available(log_state.follow_responses(stream), "log-intervals")
    return flat(found.select("session_id", F.floor("stamp").alias("second"), "output_tokens", ((F.col("end") - F.col("start")) * 1000).alias("duration_ms")))


def stream_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Response times of messages in conversation logs of kind B whose lines arrive as a stream."""
    turns = adapters.table(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    second = F.col("conv_id") * 86400 + F.col("turn") * 60 + F.length("text") % 50
    message = F.struct(
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), F.lit("c").alias("model"),
        F.when(F.col("role") == "assistant", F.struct(F.length("text").cast("bigint").alias("output_tokens"))).alias("usage"),
    )
    line = F.to_json(
        F.struct(
            F.col("role").alias("type"), F.concat(F.lit("conv"), "conv_id").alias("sessionId"), message.alias("message"),
            F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        )
    )
    records = turns.select(
        F.concat(F.lit("conv"), "conv_id").alias("file"), F.col("turn").cast("bigint").alias("ordinal"), F.from_json(line, schemas.LOG_B).alias("r")
    )
    landed = new_path(spark, "landed-talks")
    records.write.parquet(landed)
    stream = follow.follow_files(spark, landed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields))
    found = follow.run_available(message_state.follow_messages(stream), "messages")
    newest = follow.corrected(found, ["session_id", "message_id"])
    return flat(newest.select("session_id", "output_tokens", ((F.col("end") - F.col("start")) * 1000).alias("duration_ms")))


def stream_growing(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of files that are found half as long at first, counted by kind of event."""
    folder, journal = new_path(spark, "growing"), new_path(spark, "listings")
    events = adapters.table(spark, sf, "events")
    lines = events.select("user_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))
    lines.repartition("user_id").select("value").write.text(folder)
    found = growing.listing(spark, folder, 1e9, pattern="*.txt")
    growing.keep_listing(found.withColumn("size", F.floor(F.col("size") / 2)), journal, 0)
    growing.keep_listing(found.withColumn("scanned_at", F.col("scanned_at") + 5), journal, 1)
    read = follow.run_available(growing.follow_lines(spark, journal), "lines").drop("batch")
    rows = growing.records(read, "event_id bigint, event_type string")
    return rows.groupBy("r.event_type").agg(F.count(F.lit(1)).alias("lines"), F.sum("r.event_id").alias("ids"))


#: Ranges that two later reports of the usage query cover.
RAISED, RESTATED = (2842260, 2844480), (2843400, 2843820)


def stream_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Minute counts after three reports: meter 0 whole, a partial one of meter 1, a whole one of meter 2; the last arrives first."""
    tokens = adapters.minute_tokens(spark, sf).withColumnRenamed("slot", "at")
    ends = tokens.where("series = 'm0'").agg(F.min("at").alias("begin"), (F.max("at") + 60).alias("end"))
    landed = new_path(spark, "landed-reports")
    for meter, partial in ((2, False), (1, True), (0, False)):
        low, high = [(None, None), RAISED, RESTATED][meter]
        span = ends if meter == 0 else spark.range(1).select(F.lit(low).cast("bigint").alias("begin"), F.lit(high).cast("bigint").alias("end"))
        own = tokens.where(F.col("series") == f"m{meter}")
        counts = (own if meter == 0 else own.where(F.col("at").between(low, high - 1))).select(F.lit("slot").alias("kind"), "at", "tokens")
        heads = span.select(F.lit("report").alias("kind"), "begin", "end")
        rows = heads.unionByName(counts, allowMissingColumns=True).withColumns(
            {
                "series": F.lit("all"), "sequence": F.lit(meter).cast("bigint"), "partial": F.lit(partial), "available": F.lit(True),
                "collected_at": F.lit(2845000.0),
            }
        )
        rows.where("kind = 'slot' OR begin IS NOT NULL").write.mode("append").parquet(landed)
    found = follow.run_available(usage_state.follow_usage(follow.follow_files(spark, landed, usage_state.REPORT, max_files=2)), "usage")
    return usage_state.known_usage(found).where("kind = 'slot'").select(F.col("at").alias("slot"), "tokens", "partial")


def stream_average(spark: SparkSession, sf: str) -> DataFrame:
    """Average over the trailing 300 seconds of what each meter received, by second."""
    landed, sums = new_path(spark, "landed-arrivals"), new_path(spark, "sums")
    arrivals = adapters.table(spark, sf, "events").where("event_type = 'purchase'").selectExpr(
        "concat('m', user_id % 3) AS series", "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) / 1000.0D AS received_at",
        "CAST(round(value * 10) AS BIGINT) AS tokens",
    )
    arrivals.write.parquet(landed)
    beat = arrivals.agg((F.max("received_at") + 7200).alias("received_at")).where("received_at IS NOT NULL")
    beat.select(F.lit("").alias("series"), "received_at", F.lit(None).cast("bigint").alias("tokens")).write.mode("append").parquet(landed)
    rows = follow.follow_files(spark, landed, "series string, received_at double, tokens bigint")
    follow.append_available(rows, sums, new_path(spark, "sums-progress"), reduce=average_state.by_second)
    seconds = follow.follow_journal(sums, average_state.by_second(arrivals))
    found = follow.run_available(average_state.follow_average(seconds), "averages")
    return flat(average_state.averages(found).where("output_tokens > 0"))


QUERIES = {
    "stream_average": stream_average,
    "stream_usage": stream_usage,
    "stream_growing": stream_growing,
    "stream_messages": stream_messages,
    "stream_log_intervals": stream_log_intervals,
    "stream_pair_state": stream_pair_state,
    "stream_credits": stream_credits,
    "stream_corrections": stream_corrections,
    "stream_once": stream_once,
    "stream_pairs": stream_pairs,
    "stream_rate": stream_rate,
    "stream_late": stream_late,
    "stream_receipts": stream_receipts,
    "stream_otlp": stream_otlp,
    "stream_minutes": stream_minutes,
    "stream_trace": stream_trace,
}

_ONCE = """single AS (
  SELECT *, start + (received_at - sampled_at) AS a, "end" + (received_at - sampled_at) AS b,
    received_at + CASE WHEN output_tokens % 50 = 0 THEN 10 ELSE 0 END - "end" > 5 AS late FROM samples),
"""

ORACLES = {
    "stream_average": telemetry(
        """SELECT series, second, CAST(sum(tokens) AS BIGINT) AS output_tokens, round(sum(tokens) / 300.0::DOUBLE, 6) AS average_tps FROM (
        SELECT 'm' || (user_id % 3) AS series, CAST(round(value * 10) AS BIGINT) AS tokens,
          unnest(range(CAST(ceil(ms / 1000.0::DOUBLE) AS BIGINT), ms // 1000 + 301)) AS second
        FROM ev WHERE event_type = 'purchase') GROUP BY 1, 2 HAVING sum(tokens) > 0"""
    ),
    "stream_usage": telemetry(
        f"""SELECT slot, CASE WHEN slot >= {RESTATED[0]} AND slot < {RESTATED[1]} THEN c WHEN slot >= {RAISED[0]} AND slot < {RAISED[1]}
          THEN greatest(a, b) ELSE a END AS tokens,
          slot >= {RAISED[0]} AND slot < {RAISED[1]} AND (slot < {RESTATED[0]} OR slot >= {RESTATED[1]}) AND b > a AS partial
        FROM (SELECT g.slot, coalesce(m0.tokens, 0) AS a, coalesce(m1.tokens, 0) AS b, coalesce(m2.tokens, 0) AS c FROM (
            SELECT unnest(range((SELECT min(slot) FROM mtok WHERE series = 'm0'), (SELECT max(slot) + 60 FROM mtok WHERE series = 'm0'), 60)) AS slot
            UNION SELECT unnest(range({RAISED[0]}, {RAISED[1]}, 60)) UNION SELECT unnest(range({RESTATED[0]}, {RESTATED[1]}, 60))) g
          LEFT JOIN mtok m0 ON m0.slot = g.slot AND m0.series = 'm0' LEFT JOIN mtok m1 ON m1.slot = g.slot AND m1.series = 'm1'
          LEFT JOIN mtok m2 ON m2.slot = g.slot AND m2.series = 'm2')""",
        COUNTS,
    ),
    "stream_growing": f"SELECT event_type, {_b('count(*)', 'lines')}, {_b('sum(event_id)', 'ids')} FROM events GROUP BY 1",
    "stream_messages": evidence(
        "SELECT session_id, output_tokens, round(duration_ms, 6) AS duration_ms FROM timing WHERE output_tokens > 0"
    ),
    "stream_log_intervals": evidence(
        "SELECT session_id, second, output_tokens, round(duration_ms, 6) AS duration_ms FROM timing"
    ),
    "stream_pair_state": telemetry(
        """SELECT session_key, response_key, provider, model, output_tokens, round(start, 6) AS start, round("end", 6) AS "end", status FROM paired""",
        ids="NOT (event_type = 'click' AND event_id % 5 = 0)",
    ),
    "stream_credits": telemetry("SELECT second, output_tokens, excluded FROM received"),
    "stream_corrections": telemetry("SELECT second, output_tokens, excluded FROM received"),
    "stream_once": "WITH " + BASE.rstrip().rstrip(",") + f"""
SELECT app_type, false AS behind, {_b('count(DISTINCT request_id)', 'requests')} FROM ledger
WHERE created_at >= {SINCE} AND coalesce(data_source, 'proxy') = 'proxy' AND status_code BETWEEN 200 AND 299 GROUP BY 1""",
    "stream_pairs": telemetry(
        f"""SELECT session_key, status, {_b('count(*)', 'responses')}, {_b('sum(output_tokens)', 'output_tokens')}
        FROM paired GROUP BY ALL"""
    ),
    "stream_rate": telemetry(
        """SELECT second, runtime, session_key, round(sum(output_tokens * (least(b, second) - greatest(a, second - 5)) / (b - a) / 5), 6)
        AS tps FROM (SELECT *, unnest(range(CAST(floor(a) AS BIGINT) + 1, CAST(ceil(b + 5) AS BIGINT))) AS second FROM single WHERE NOT late)
        WHERE least(b, second) - greatest(a, second - 5) > 0 GROUP BY ALL""",
        _ONCE,
    ),
    "stream_late": telemetry(
        f"SELECT runtime, {_b('count(*)', 'responses')}, {_b('sum(output_tokens)', 'output_tokens')} FROM single WHERE late GROUP BY 1", _ONCE
    ),
    "stream_receipts": telemetry("SELECT second, output_tokens, excluded FROM received"),
    "stream_minutes": "WITH " + BASE.rstrip().rstrip(",") + f"""
SELECT CAST(floor(created_at / 86400) * 86400 AS BIGINT) AS day, app_type, {_b('sum(output_tokens)', 'output_tokens')}, {_b('count(*)', 'requests')}
FROM (SELECT app_type, request_id, min(created_at) AS created_at, min(output_tokens) AS output_tokens FROM ledger
  WHERE created_at >= {SINCE} AND coalesce(data_source, 'proxy') = 'proxy' AND status_code BETWEEN 200 AND 299 GROUP BY 1, 2) GROUP BY ALL""",
    "stream_trace": f"""
SELECT sha256('["codex","t' || (user_id % 40) || '"]') AS session_key, round(max(stamp), 6) AS stamp, {_b('count(*)', 'events')}
FROM (SELECT *, epoch_us(ts) // 1000000 + (event_id % 1000) / 1000.0::DOUBLE AS stamp FROM events)
WHERE event_type IN ('view', 'click', 'purchase') AND user_id % 40 <> 0 AND event_id % 23 <> 0 AND stamp >= {TRACED} GROUP BY ALL""",
    "stream_otlp": telemetry(
        f"""SELECT CASE WHEN event_type = 'purchase' THEN 'response.completed' ELSE 'response.created' END AS kind,
        CASE WHEN event_type = 'click' THEN 'request' ELSE 'response' END AS start_origin, {_b('count(*)', 'events')},
        {_b("sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 10) AS BIGINT) END)", 'output_tokens')}
        FROM ev WHERE (event_type IN ('view', 'purchase') AND NOT (user_id % 13 = 0 AND user_id % 2 = 1))
          OR (event_type = 'click' AND event_id % 10 <> 3 AND user_id % 13 <> 0) GROUP BY 1, 2"""
    ),
}
