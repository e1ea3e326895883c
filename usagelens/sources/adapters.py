"""Domain tables derived from the given star-schema tables.

Deterministic integer arithmetic only, so that any SQL engine gets the same
rows from the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.projects import with_project
from usagelens.operators.enrich import spread_nulls
from usagelens.schemas import MONEY


# Keys and ship day together name one line.
LINE_ID = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),"
    " CAST(l_suppkey AS STRING), CAST(unix_date(CAST(l_shipdate AS DATE)) AS STRING))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(cents: str):
    return (F.col(cents).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with copies: session-log copies of a tenth, cross-host copies of a seventeenth.

    One scan: each line explodes into itself and its copies.
    """
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k",
        "l_partkey AS pk",
        "concat('h', l_orderkey % 3) AS host",
        "CAST(l_orderkey % 3 AS INT) AS host_order",
        f"concat(IF(l_suppkey % 4 = 1, 'session:m', ''), {LINE_ID}) AS request_id",
        "IF(l_suppkey % 5 = 0, '_session', concat('p', l_suppkey % 5)) AS provider_id",
        "CASE l_suppkey % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-desktop' ELSE 'gemini' END AS app_type",
        "IF(l_partkey % 9 = 8, 'unknown', concat('model-', l_partkey % 9)) AS model",
        "IF(l_orderkey % 7 = 0, NULL, concat('s', l_orderkey % 500)) AS session_id",
        "CAST(l_quantity AS BIGINT) * 20 AS input_tokens",
        "CAST(l_quantity AS BIGINT) * 7 AS output_tokens",
        "(l_partkey % 5) * 100 AS cache_read_tokens",
        "(l_suppkey % 3) * 10 AS cache_creation_tokens",
        "CAST(l_orderkey % 3 AS INT) AS input_token_semantics",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents",
        "IF(l_partkey % 6 = 0, NULL, CAST(500 + (l_partkey * 37) % 9000 AS DOUBLE)) AS duration_ms",
        "IF(l_partkey % 4 = 0, NULL, CAST(300 + (l_suppkey * 53) % 7000 AS DOUBLE)) AS latency_ms",
        "CAST((l_partkey * 13) % 4000 AS DOUBLE) AS first_token_ms",
        "IF(l_partkey % 24 = 0, CAST(400 + (l_partkey * 17) % 5000 AS DOUBLE), NULL) AS native_response_ms",
        "IF(l_linenumber = 7, 500, 200) AS status_code",
        "unix_date(CAST(l_shipdate AS DATE)) * 86400L"
        " + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 AS created_at",
        "IF(l_orderkey % 4 = 0, NULL, 'proxy') AS data_source",
    )
    variants = F.filter(
        F.array(
            F.lit("line"),
            F.when(F.col("k") % 10 == 0, F.lit("session")),
            F.when(F.col("k") % 17 == 0, F.lit("host")),
        ),
        lambda v: v.isNotNull(),
    )
    copied = base.withColumn("variant", F.explode(variants))
    session, other_host = F.col("variant") == "session", F.col("variant") == "host"
    nothing = F.lit(None)
    return copied.withColumns(
        {
            "host": F.when(other_host, F.lit("h9")).otherwise(F.col("host")),
            "host_order": F.when(other_host, F.lit(9)).otherwise(F.col("host_order")),
            "request_id": F.when(session, F.concat(F.lit("s-"), F.col("request_id"))).otherwise(F.col("request_id")),
            "provider_id": F.when(session, F.lit("_session")).otherwise(F.col("provider_id")),
            "duration_ms": F.when(session, nothing).otherwise(F.col("duration_ms")),
            "latency_ms": F.when(session, nothing).otherwise(F.col("latency_ms")),
            "first_token_ms": F.when(session, nothing).otherwise(F.col("first_token_ms")),
            "status_code": F.when(session, F.lit(200)).otherwise(F.col("status_code")),
            "created_at": F.when(session, F.col("created_at") + F.col("pk") % 1300 - 650).otherwise(F.col("created_at")),
            "data_source": F.when(session, F.lit("codex_session")).otherwise(F.col("data_source")),
            "total_cost_usd": _money("cost_cents"),
        }
    ).drop("variant", "cost_cents", "pk")


def _session_number():
    return F.substring("session_id", 2, 10).cast("bigint")


def session_directory():
    """The working directory of a session: two spellings of a shared folder, a plain one or none."""
    number = _session_number()
    folder = F.concat(F.lit("P"), number % 12)
    return (
        F.when(number % 3 == 0, F.concat(F.lit("/Users/u"), number % 5, F.lit("/Dropbox/"), folder))
        .when(number % 3 == 1, F.concat(F.lit("D:\\Dropbox\\"), folder))
        .when(number % 6 == 2, F.concat(F.lit("/home/u/work/"), folder))
    )


def enriched_requests(spark: SparkSession, sf_dir: str, projects: bool = True) -> DataFrame:
    """The ledger with session provider and, if asked for, session key, title and project."""
    number = _session_number()
    in_log = (F.col("data_source") == "codex_session") & (number % 4 != 0)
    rows = requests(spark, sf_dir).drop("k")
    rows = rows.withColumn("session_provider", F.when(in_log, F.concat(F.lit("prov-"), number % 7)))
    return with_sessions(rows, session_evidence(spark, sf_dir)) if projects else rows


def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and project per session id, as saved logs would give them."""
    number = _session_number()
    sessions = table(spark, sf_dir, "orders").selectExpr("concat('s', o_orderkey % 500) AS session_id").distinct()
    return with_project(sessions.withColumn("cwd", session_directory()), "cwd").withColumn(
        "session_title", F.when(number % 2 == 0, F.concat(F.lit("Title "), number))
    ).drop("cwd")


def with_sessions(rows: DataFrame, evidence: DataFrame, row_id: str = "request_id") -> DataFrame:
    """Adds session key, title and project to rows with a session id; ``row_id`` spreads those without."""
    keyed = rows.withColumn("_key", spread_nulls(F.col("session_id"), F.col(row_id)))
    joined = keyed.join(evidence.withColumnRenamed("session_id", "_key"), "_key", "left").drop("_key")
    return joined.withColumn("session_key", U.session_key(F.col("session_id")))


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rollups per customer class, with some repeated by another host."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('h', o_custkey % 3) AS host",
        "CAST(o_custkey % 3 AS INT) AS host_order",
        "CAST(o_orderdate AS DATE) AS date",
        "IF(o_custkey % 5 = 0, '_session', concat('p', o_custkey % 5)) AS provider_id",
        "CASE o_custkey % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-desktop' ELSE 'gemini' END AS app_type",
        "concat('model-', o_custkey % 9) AS model",
        "CAST(o_custkey % 3 AS INT) AS input_token_semantics",
        "o_custkey % 1000 + 500 AS input_tokens",
        "o_custkey % 90 AS output_tokens",
        "o_custkey % 7 * 100 AS cache_read_tokens",
        "o_custkey % 3 * 10 AS cache_creation_tokens",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cost_cents",
    )
    keys = ["host", "host_order", "date", "provider_id", "app_type", "model", "input_token_semantics"]
    sums = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_cents"]
    daily = orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"), *[F.sum(c).alias(c) for c in sums]
    )
    copies = F.when(F.col("input_tokens") % 11 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return (
        daily.withColumn("copied", F.explode(copies))
        .withColumns(
            {
                "host": F.when(F.col("copied"), F.lit("h9")).otherwise(F.col("host")),
                "host_order": F.when(F.col("copied"), F.lit(9)).otherwise(F.col("host_order")),
                "success_count": F.col("request_count"),
                "total_cost_usd": _money("cost_cents"),
            }
        )
        .drop("copied", "cost_cents")
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named providers p0 to p3 for every host and app; p4 stays unresolved."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.explode(F.array(*[F.lit(h) for h in ("h0", "h1", "h2", "h9")])).alias("host"),
        F.concat(F.lit("p"), F.col("s_suppkey") % 4).alias("id"),
        F.col("n_name").alias("name"),
    ).withColumn("app_type", F.explode(F.array(*[F.lit(a) for a in ("codex", "claude", "claude-desktop", "gemini")])))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per host, collected just after its latest ledger row."""
    return (
        requests(spark, sf_dir)
        .groupBy("host", "host_order")
        .agg(F.max("created_at").alias("latest"))
        .select(
            "host",
            "host_order",
            F.timestamp_seconds(F.col("latest") + 60).alias("collected_at"),
            F.lit("UTC").alias("host_timezone"),
            F.lit("fresh").alias("status"),
        )
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved threads, one row per order: id, name, parent and working directory."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('s', o_orderkey % 500) AS id",
        "IF(o_orderkey % 500 % 4 = 0, ' ', concat('Thread ', o_orderkey % 500)) AS name",
        "IF(o_orderkey % 500 % 9 = 1, concat('s', (o_orderkey % 500 + 3) % 510), NULL) AS parent_id",
        "concat('/Users/u', o_orderkey % 5, '/Dropbox/P', o_orderkey % 500 % 12"
        " + IF(o_orderkey % 500 % 10 = 3 AND o_orderkey % 1000 >= 500, 1, 0)) AS cwd",
        "o_orderkey AS version",
    )


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from an index file, which thread names override."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('s', o_orderkey % 500) AS id",
        "IF(o_orderkey % 500 % 6 = 0, concat('Index ', o_orderkey % 500), NULL) AS thread_name",
        "o_orderkey AS ordinal",
    )


def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header records: the provider and directory a session started with."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('s', o_orderkey % 500) AS session_id",
        "IF(o_orderkey % 500 % 4 = 0, NULL, concat('prov-', o_orderkey % 500 % 7)) AS model_provider",
        "CASE WHEN o_orderkey % 500 % 5 = 0 THEN NULL"
        " WHEN o_orderkey % 500 % 5 < 3 THEN concat('/Users/v/Dropbox/P', o_orderkey % 500 % 12)"
        " ELSE concat('/srv/P', o_orderkey % 500 % 12) END AS cwd",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages with their conversation; some appear in two of them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"concat(IF(l_suppkey % 4 = 1 AND l_partkey % 3 = 0, 'm', 'x'), {LINE_ID}) AS message_id",
        "explode(IF(l_partkey % 6 = 0, array(concat('c', l_orderkey % 700), concat('c', l_orderkey % 700 + 1)),"
        " array(concat('c', l_orderkey % 700)))) AS session_id",
    )


def saved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved titles of conversations; neighbours share one, every seventh has none."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_orderkey % 701) AS session_id",
        "IF(o_orderkey % 701 % 7 = 0, NULL, concat('Talk ', (o_orderkey % 701) div 3)) AS title",
    ).distinct()


def conversation_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories seen in each conversation, some with two."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_orderkey % 701) AS session_id",
        "concat('/work/P', (o_orderkey % 701) div 5 + IF(o_orderkey % 701 % 11 = 0 AND o_orderkey % 2 = 0, 1, 0)) AS cwd",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response boundaries from the event table, compressed to about 72 minutes.

    Views and sign-ups start responses, clicks send requests, purchases and errors
    end them, errors without a count. A third of the sessions carry response ids.
    Every eighth export is late; a tenth of the sessions run on a slower clock, so
    that starts expire; some requests name no session, and a few events nothing.
    """
    return telemetry_events(table(spark, sf_dir, "events"))


def telemetry_events(events: DataFrame) -> DataFrame:
    timed = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) * IF(user_id % 10 = 3, 40, 1) AS stamp_ms",
    )
    return timed.selectExpr(
        "event_id",
        "IF(event_id % 101 = 0 OR (event_type = 'click' AND user_id % 3 = 0 AND event_id % 5 = 0), NULL, concat('u', user_id)) AS session_key",
        "IF(event_id % 101 <> 0 AND user_id % 3 = 0, concat('r', user_id, '-', stamp_ms div 60000), NULL) AS response_key",
        "IF(event_type IN ('purchase', 'error'), 'response.completed', 'response.created') AS kind",
        "IF(event_type = 'click', 'request', 'response') AS start_origin",
        "stamp_ms / 1000D AS stamp",
        "stamp_ms / 1000D + event_id % 8 AS received_at",
        "IF(event_type = 'purchase', CAST(round(value * 10) AS BIGINT), NULL) AS output_tokens",
        "concat('prov-', user_id % 4) AS provider",
        "concat('model-', user_id % 9) AS model",
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace table: which sessions were read from, with other targets, unnamed threads and broken fractions."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS ts",
        "IF(event_id % 23 = 0, 2000000000L, event_id % 1000 * 1000000L) AS ts_nanos",
        "IF(event_type IN ('view', 'click', 'purchase'), 'codex_core::stream_events_utils', 'other') AS target",
        "IF(user_id % 40 = 0, 'none', concat('t', user_id % 40)) AS thread_id",
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events of kind A from conversation turns: user is input, assistant output.

    Every assistant turn is followed by a token count one second later.
    """
    turns = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").selectExpr(
        "concat('conv', conv_id) AS session_id",
        "turn",
        "role",
        "length(text) AS chars",
        "conv_id * 86400 + turn * 60 + length(text) % 50 AS second",
    )
    return turns.selectExpr(
        "session_id",
        "explode(IF(role = 'user', array(named_struct('ordinal', turn * 2, 'second', second, 'event', 'input', 'tokens', NULL)),"
        " array(named_struct('ordinal', turn * 2, 'second', second, 'event', 'output', 'tokens', NULL),"
        " named_struct('ordinal', turn * 2 + 1, 'second', second + 1, 'event', 'count', 'tokens', CAST(chars AS BIGINT))))) AS e",
    ).selectExpr(
        "session_id",
        "e.ordinal AS ordinal",
        "CAST(e.second AS DOUBLE) AS stamp",
        "e.event AS event",
        "CAST(NULL AS STRING) AS call_id",
        "CAST(NULL AS STRING) AS model",
        "CAST(NULL AS STRING) AS response_id",
        "IF(e.event = 'count', 7L, NULL) AS input_tokens",
        "e.tokens AS output_tokens",
        "IF(e.event = 'count', 0L, NULL) AS cached_input_tokens",
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the same turns, as a session log would record them."""
    counted = conversation_events(spark, sf_dir).where("event = 'count'")
    return counted.selectExpr(
        "concat('q-', session_id, '-', ordinal) AS request_id",
        "'codex' AS app_type",
        "session_id",
        "CAST(stamp AS BIGINT) AS created_at",
        "input_tokens",
        "output_tokens",
        "cached_input_tokens AS cache_read_tokens",
        "IF(ordinal % 4 = 1, 'proxy', 'codex_session') AS data_source",
    )


def otlp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log packet: session on the resource, model on the scope.

    Views and purchases are response boundaries, clicks are requests with a
    duration (every tenth failed), sign-ups other records, and errors have a
    count that is no number.
    """
    return packets_of(table(spark, sf_dir, "events"))


def packets_of(table_events: DataFrame) -> DataFrame:
    events = table_events.selectExpr(
        "event_id", "user_id", "event_type", "value", "unix_millis(CAST(ts AS TIMESTAMP)) div 600 AS ms"
    )

    def attribute(key: str, s: str = "NULL", i: str = "NULL", b: str = "NULL") -> str:
        value = f"'stringValue', CAST({s} AS STRING), 'intValue', CAST({i} AS STRING)"
        value += f", 'doubleValue', CAST(NULL AS DOUBLE), 'boolValue', CAST({b} AS BOOLEAN)"
        return f"named_struct('key', '{key}', 'value', named_struct({value}))"

    session = attribute("conversation.id", s="concat('u', user_id)")
    outer_model = attribute("model", s="'m-outer'")
    resource = f"IF(user_id % 13 = 0, array({outer_model}), array({session}))"
    scope = "array(" + attribute("model", s="concat('m', user_id % 9)") + ")"
    kind = (
        "CASE event_type WHEN 'view' THEN 'response.created' WHEN 'purchase' THEN 'response.completed'"
        " WHEN 'error' THEN 'response.completed' ELSE 'tool' END"
    )
    name = (
        "CASE WHEN event_type = 'click' THEN 'codex.websocket_request' WHEN user_id % 2 = 0 THEN 'codex.sse_event'"
        " ELSE 'callsite' END"
    )
    count = "IF(event_type = 'error', '-1', CAST(CAST(round(value * 10) AS BIGINT) AS STRING))"
    parts = [
        attribute("event.kind", s=kind),
        attribute("event.name", s=name),
        attribute("output_token_count", i=count),
        attribute("duration_ms", i="event_id % 900"),
        attribute("success", b="event_id % 10 <> 3"),
    ]
    record = f"array({', '.join(parts)})"
    return events.selectExpr(
        "ms / 1000D + event_id % 8 AS received_at",
        f"array(named_struct('resource', named_struct('attributes', {resource}), 'scopeLogs',"
        f" array(named_struct('scope', named_struct('attributes', {scope}), 'logRecords',"
        f" array(named_struct('timeUnixNano', CAST(ms * 1000000 AS STRING), 'attributes', {record})))))) AS resourceLogs",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate readings of three meters from the event table."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('m', user_id % 3) AS series",
        "event_id AS reading_id",
        "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) / 1000D AS wall",
        "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) / 1000D + IF(event_id % 97 = 0, 5, 0) AS monotonic",
        "value AS total_tps",
        "IF(event_type = 'error', NULL, value / (1 + user_id % 4)) AS average_tps",
        "IF(event_type = 'signup', 'partial', 'complete') AS status",
    )


def response_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response samples as three sources report them, some copied and some in conflict."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    events = events.where("event_type IN ('purchase', 'click')").selectExpr(
        "event_id", "user_id", "value", "unix_millis(CAST(ts AS TIMESTAMP)) div 600 AS ms"
    )
    copies = F.when(F.col("event_id") % 6 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(
        F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return events.withColumn("copy", F.explode(copies)).selectExpr(
        "concat('src', (user_id + copy) % 3) AS source",
        "CAST((user_id + copy) % 3 AS INT) AS source_order",
        "concat('e', event_id) AS event_key",
        "IF(user_id % 17 = 0 OR copy = 2, NULL, concat('s', user_id % 60)) AS session_key",
        "IF(user_id % 2 = 0, 'codex', 'claude') AS runtime",
        "concat('prov-', user_id % 4) AS provider",
        "concat('model-', copy) AS model",
        "CAST(round(value * 10) AS BIGINT) + 5 + IF(copy = 1 AND event_id % 5 = 0, 1, 0) AS output_tokens",
        "ms / 1000D - 1 - event_id % 9 AS `start`",
        "ms / 1000D AS `end`",
        "CASE WHEN user_id % 2 = 0 AND user_id % 60 < 20 AND event_id % 4 = 0 THEN 'codex_otel'"
        " WHEN copy = 1 THEN 'proxy_elapsed' ELSE 'native_log' END AS basis",
        "ms / 1000D + 0.25D AS sampled_at",
        "ms / 1000D + 0.5D + copy AS received_at",
    )


def minute_tokens(spark: SparkSession, sf_dir: str, step_s: int = 60) -> DataFrame:
    """Completed output per meter and time step."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "concat('m', user_id % 3) AS series",
        f"(unix_millis(CAST(ts AS TIMESTAMP)) div 600) div {1000 * step_s} * {step_s} AS slot",
        "CAST(round(value * 10) AS BIGINT) AS tokens",
    ).groupBy("series", "slot").agg(F.sum("tokens").alias("tokens"))
