"""Registered queries over what sources read and sinks wrote, and over small rules.

The given tables are landed in the shared folder in the form a source expects, read
back through it and compared with SQL over the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas, sinks
from usagelens.functions import usage as U
from usagelens.operators import live, reports
from usagelens.plans import history, telemetry
from usagelens.plans.columns import flat
from usagelens.plans.history_sql import ARCHIVE
from usagelens.plans.report_sql import BASE, _b, usage
from usagelens.plans.telemetry_sql import LAST, NOW
from usagelens.plans.telemetry_sql import telemetry as telemetry_sql
from usagelens.plans.usage import Usage
from usagelens.session import new_path
from usagelens.sources import adapters, logs, otlp, saved
from usagelens.sources.usage import Source, read_usage

HOSTS = ("h0", "h1", "h2", "h9")


def machines_read(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers of all machines, each landed in its own folder and read together."""
    folder = new_path(spark, "machines")
    tables = {
        "proxy_request_logs": adapters.requests(spark, sf).select(*schemas.columns(schemas.REQUESTS), "host"),
        # Optional columns stay away.
        "usage_daily_rollups": adapters.rollups(spark, sf).select(
            *(c for c in schemas.columns(schemas.ROLLUPS) if c not in schemas.OPTIONAL or c == "input_token_semantics"), "host"
        ),
        "providers": adapters.providers(spark, sf).select(*schemas.columns(schemas.PROVIDERS), "host"),
    }
    for name, rows in tables.items():
        for host in HOSTS:
            rows.where(F.col("host") == host).drop("host").write.parquet(f"{folder}/{host}/{name}")
    read = read_usage(spark, [Source(h, f"{folder}/{h}", collected_at="2002-01-01") for h in HOSTS])
    return read.requests.groupBy("host", "host_order").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("output_tokens").alias("output_tokens"), F.max("created_at").alias("latest")
    )


def export_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily usage as CSV and back."""
    folder = new_path(spark, "exports")
    sinks.write_exports({"daily_usage": Usage(spark, sf).daily.select(*schemas.columns(schemas.DAILY))}, folder)
    return flat(saved.read_export(spark, folder, "daily_usage"))


def public_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a public view shows of daily usage."""
    return flat(sinks.public_view(Usage(spark, sf).daily, "rows"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary document, read back: its totals and how long its lists are."""
    path, daily = new_path(spark, "summary"), Usage(spark, sf).daily
    audit = daily.groupBy("host").agg(F.sum("requests").alias("requests"))
    sinks.write_summary(reports.grand_total(daily), audit, reports.by_model(daily), reports.by_host_app(daily), path)
    read = spark.read.json(path)
    return read.select("requests", "tokens", *(F.size(c).cast("bigint").alias(c) for c in ("sources", "by_model", "by_host_app")))


def archive_files(spark: SparkSession, sf: str) -> DataFrame:
    """Changed days as archive files, read back and checked."""
    fresh, covered, hosts, old = history._collection(spark, sf)
    path = new_path(spark, "archive")
    # A source's identity is a hash; the history's placeholder for a former one is none.
    sinks.write_archive(fresh, covered, hosts.where("host <> 'h2'"), old.where("source_identity <> 'old'"), path)
    return flat(saved.read_archive(spark, path).drop("collected_at", "timezone"))


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    known = adapters.minute_tokens(spark, sf).select("series", F.col("slot").alias("minute"), "tokens")
    zero = {c: F.lit(0.0) for c in ("total_integral", "total_covered_s", "average_integral", "average_covered_s", "partial_s")}
    flags = {"day_only": F.lit(False), "usage_known": F.lit(True), "usage_partial": F.lit(False)}
    return known.withColumns({**zero, **flags}).select(*schemas.columns(schemas.MINUTES))


def minute_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Minute records appended, corrected by a later sequence, compacted and read back."""
    rows, journal, compact = _minutes(spark, sf), new_path(spark, "minutes"), new_path(spark, "compact")
    sinks.append_minutes(rows, 1, journal)
    sinks.append_minutes(rows.where("minute % 120 = 0").withColumn("tokens", F.col("tokens") + 1), 2, journal)
    written = spark.read.schema(schemas.MINUTES + ", sequence bigint, day date").parquet(journal)
    sinks.compact_minutes(written, compact, float(LAST))
    return saved.read_minutes(spark, compact, float(LAST)).select("series", "minute", "tokens", "sequence")


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as log lines, read back with their place in the file."""
    folder = new_path(spark, "logs")
    payload = F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("cwd"))
    line = F.to_json(F.struct(F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    adapters.table(spark, sf, "conversations").select(line.alias("value")).write.text(folder)
    records = logs.read_records(spark, folder, schema=schemas.LOG_A, pattern="*.txt")
    numbered = records.groupBy("file").agg(F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("lines")).where("last + 1 <> lines")
    roles = records.groupBy(F.col("r.payload.role").alias("role")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.char_length("r.payload.cwd")).alias("chars")
    )
    return roles.join(numbered.agg(F.count(F.lit(1)).alias("misnumbered_files")), F.lit(True))


def telemetry_since(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary events from the start of reading on."""
    events = otlp.after_start(adapters.telemetry(spark, sf), F.lit(float(NOW)))
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


def overall_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of all sources at three moments."""
    beats = telemetry._heartbeats(spark, sf)
    known = beats.select("source").distinct()
    out = None
    for name, moment in (("before", 0.0), ("end", float(LAST)), ("after", float(LAST + 100))):
        seen = beats.where(F.col("received_at") <= moment)
        state = live.overall_status(live.source_status(seen, known, F.lit(moment))).select(F.lit(name).alias("moment"), "status")
        out = state if out is None else out.unionByName(state)
    return out


def observed_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rates on watched seconds: zero where nothing ran, null where coverage was partial."""
    totals = live.live_totals(live.session_rates(telemetry._cells(spark, sf)))
    seconds = live.watched_seconds(telemetry._ticks(spark, sf)).select("second", F.col("observed").alias("fresh"), "partial")
    return flat(live.observed_totals(totals, seconds).select("second", "total_tps"))


def session_models(spark: SparkSession, sf: str) -> DataFrame:
    """The models of each session as shown, without the internal one."""
    model = F.when(F.col("model") == "model-0", U.HIDDEN_MODEL).otherwise(F.col("model"))
    rows = adapters.requests(spark, sf).where("session_id IS NOT NULL")
    return rows.groupBy("session_id").agg(U.model_list(F.collect_set(model)).alias("models"))


def source_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of a source's settings; the interpreter and a port leave it alone."""
    nations = adapters.table(spark, sf, "nation")
    settings = F.create_map(F.lit("path"), "n_name", F.lit("python"), F.col("n_nationkey").cast("string"), F.lit("zone"), F.lit("UTC"))
    return nations.select("n_nationkey", U.source_fingerprint(settings).alias("identity"))


def source_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct issues of each source in the order they were first seen."""
    events = adapters.table(spark, sf, "events").selectExpr("concat('m', user_id % 7) AS source", "event_type AS issue", "event_id")
    return flat(live.ordered_issues(events, ["source"], "event_id"))


QUERIES = {
    "machines_read": machines_read,
    "export_daily": export_daily,
    "public_rows": public_rows,
    "summary": summary,
    "archive_files": archive_files,
    "minute_journal": minute_journal,
    "log_records": log_records,
    "telemetry_since": telemetry_since,
    "overall_state": overall_state,
    "observed_rate": observed_rate,
    "session_models": session_models,
    "source_identities": source_identities,
    "source_issues": source_issues,
}

ORACLES = {
    "machines_read": "WITH " + BASE.rstrip().rstrip(",") + f"""
SELECT host, CAST(CASE host WHEN 'h9' THEN 3 ELSE host_order END AS INT) AS host_order, {_b('count(*)', 'requests')},
  {_b('sum(output_tokens)', 'output_tokens')}, max(created_at) AS latest FROM ledger GROUP BY ALL""",
    "export_daily": usage("SELECT * FROM daily"),
    "public_rows": usage("SELECT date, host, app, model, cost_cents, total_tokens AS tokens, requests FROM daily"),
    "summary": usage(
        f"""SELECT {_b('sum(requests)', 'requests')}, {_b('sum(total_tokens)', 'tokens')}, {_b('count(DISTINCT host)', 'sources')},
        {_b('count(DISTINCT model)', 'by_model')}, {_b('count(DISTINCT (host, app))', 'by_host_app')} FROM daily"""
    ),
    "archive_files": usage(
        """SELECT * FROM kept WHERE date IN (
        SELECT date FROM (SELECT * FROM kept EXCEPT SELECT * FROM before)
        UNION ALL (SELECT date FROM (SELECT * FROM before EXCEPT SELECT * FROM kept))
        UNION ALL (SELECT max(date) FROM kept GROUP BY host, source_identity))""",
        ARCHIVE + """
kept AS (SELECT * FROM entries WHERE source_identity <> 'old'),
before AS (SELECT date, host, source_identity, app, model, tokens, requests, cost_cents FROM saved WHERE source_identity <> 'old'),
""",
    ),
    "minute_journal": telemetry_sql(
        f"""SELECT series, minute, CAST(tokens + CASE WHEN minute % 120 = 0 THEN 1 ELSE 0 END AS BIGINT) AS tokens,
        CAST(CASE WHEN minute % 120 = 0 THEN 2 ELSE 1 END AS BIGINT) AS sequence
        FROM (SELECT 'm' || (user_id % 3) AS series, CAST(ms // 60000 * 60 AS BIGINT) AS minute, {_b('sum(CAST(round(value * 10) AS BIGINT))', 'tokens')}
          FROM ev WHERE event_type = 'purchase' GROUP BY ALL)"""
    ),
    "log_records": f"""SELECT role, {_b('count(*)', 'turns')}, {_b('sum(length(text))', 'chars')}, CAST(0 AS BIGINT) AS misnumbered_files
FROM conversations GROUP BY 1""",
    "telemetry_since": telemetry_sql(
        f"""SELECT CASE WHEN done = 1 THEN 'response.completed' ELSE 'response.created' END AS kind, {_b('count(*)', 'events')}
        FROM tele WHERE stamp >= {NOW} GROUP BY 1"""
    ),
    "overall_state": telemetry_sql(
        f"""SELECT 'before' AS moment, 'initializing' AS status UNION ALL SELECT 'after', 'unavailable' UNION ALL
        SELECT 'end', CASE WHEN count(*) FILTER (WHERE fresh) = 0 THEN 'unavailable' WHEN bool_and(fresh AND c <> 'model-2') THEN 'complete' ELSE 'partial' END
        FROM (SELECT source, {LAST} - max(received_at) < 3 AS fresh, arg_max(model, received_at) AS c FROM samples WHERE received_at <= {LAST} GROUP BY 1)"""
    ),
    "observed_rate": telemetry_sql(
        """SELECT second, CASE WHEN t IS NOT NULL THEN round(t, 6) WHEN NOT partial THEN 0.0 END AS total_tps
        FROM watched LEFT JOIN (SELECT second, sum(tps) AS t FROM rates GROUP BY 1) USING (second)"""
    ),
    "session_models": "WITH " + BASE.rstrip().rstrip(",") + """
SELECT session_id, coalesce(string_agg(DISTINCT model, ', ' ORDER BY model) FILTER (WHERE model <> 'model-0'), '—') AS models
FROM ledger WHERE session_id IS NOT NULL GROUP BY 1""",
    "source_identities": """SELECT n_nationkey,
  sha256('[{"key":"path","value":"' || n_name || '"},{"key":"zone","value":"UTC"}]') AS identity FROM nation""",
    "source_issues": """SELECT source, string_agg(issue, ',' ORDER BY first) AS issues FROM (
  SELECT 'm' || (user_id % 7) AS source, event_type AS issue, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""",
}
