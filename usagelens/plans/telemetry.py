"""Registered queries over packets, pairing, live rates and receipts (batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.operators import live, pairing, quality
from usagelens.plans.columns import flat
from usagelens.sources import adapters, otlp

# Seconds of the compressed event clock: its first second, its end and a moment in between.
FIRST, LAST, NOW = 2840112, 2844432, 2842000


def otlp_flatten(spark: SparkSession, sf: str) -> DataFrame:
    rows = otlp.response_events(otlp.flatten_otlp(adapters.otlp_packets(spark, sf)))
    return flat(rows.select("session_key", "response_key", "kind", "start_origin", "stamp", "output_tokens", "model"))


def otlp_counts(spark: SparkSession, sf: str) -> DataFrame:
    return otlp.ingest_counts(otlp.flatten_otlp(adapters.otlp_packets(spark, sf)))


def otlp_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairing.pair_responses(adapters.telemetry(spark, sf))
    return flat(rows.select("session_key", "response_key", "model", "output_tokens", "start", "end", "status"))


def otlp_samples(spark: SparkSession, sf: str) -> DataFrame:
    """What measured pairs give to the live rate."""
    rows = pairing.measured_samples(pairing.pair_responses(adapters.telemetry(spark, sf)))
    return rows.groupBy("session_key", "basis").agg(F.count(F.lit(1)).alias("responses"), F.sum("output_tokens").alias("output_tokens"))


def late_output(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.status_counts(pairing.pair_responses(adapters.telemetry(spark, sf)))


def mixed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same events where only odd ones keep their response id."""
    events = adapters.telemetry(spark, sf).withColumn(
        "response_key", F.when(F.col("event_id") % 2 == 1, F.col("response_key"))
    )
    return pairing.status_counts(pairing.pair_responses(events))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    responses = live.canonical_responses(adapters.response_samples(spark, sf)).where("NOT conflict")
    return live.rate_cells(live.rebased(responses))


def live_rate(spark: SparkSession, sf: str) -> DataFrame:
    return flat(live.live_totals(live.session_rates(_cells(spark, sf))))


def live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return flat(live.session_rates(_cells(spark, sf)))


def busiest_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.session_rates(_cells(spark, sf)).withColumn("tps", F.round("tps", 6))
    return live.ranked_sessions(rows)


def canonical_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.canonical_responses(adapters.response_samples(spark, sf))
    return rows.select("event_key", "source", "session_key", "basis", "model", "output_tokens", "conflict")


def receipt_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return flat(live.receipt_deltas(adapters.response_samples(spark, sf)))


def receipt_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return live.receipt_seconds(live.receipt_deltas(adapters.response_samples(spark, sf)))


def receipt_average(spark: SparkSession, sf: str) -> DataFrame:
    return flat(live.receipt_average(live.receipt_deltas(adapters.response_samples(spark, sf))))


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapters.readings(spark, sf)
    return rows.select(F.lit("all").alias("series"), F.col("wall").alias("tick"), F.lit(True).alias("fresh"), "status")


def finished_bins(spark: SparkSession, sf: str) -> DataFrame:
    seconds = live.receipt_seconds(live.receipt_deltas(adapters.response_samples(spark, sf)))
    return live.finished_bins(seconds, live.watched_seconds(_ticks(spark, sf)).drop("series"))


def _heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.response_samples(spark, sf).select(
        "source", "received_at",
        F.when(F.col("model") == "model-2", F.lit("partial")).otherwise(F.lit("complete")).alias("coverage"),
        F.lit(None).cast("string").alias("error"),
    )


def source_status(spark: SparkSession, sf: str) -> DataFrame:
    beats = _heartbeats(spark, sf)
    known = beats.select("source").distinct()
    return flat(live.source_status(beats, known, F.lit(float(LAST))))


def activity_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions active at a moment whose usage had not been read by then; sign-ups stand for telemetry."""
    events = adapters.table(spark, sf, "events").selectExpr(
        "event_type", "concat('s', user_id % 60) AS session_key", "(unix_millis(CAST(ts AS TIMESTAMP)) div 600) / 1000D AS stamp"
    )
    trace, telemetry = events.where("event_type <> 'signup'"), events.where("event_type = 'signup'")
    return flat(live.activity_gaps(trace, adapters.response_samples(spark, sf), float(NOW), telemetry))


def proxy_link(spark: SparkSession, sf: str) -> DataFrame:
    """Proxy rows joined to native responses of the messages they answer."""
    proxy = live.proxy_samples(adapters.requests(spark, sf), adapters.providers(spark, sf))
    logged = proxy.where((F.col("runtime") == "claude") & F.col("request_id").startswith("session:"))
    native = logged.groupBy("event_key").agg(
        F.min("output_tokens").alias("output_tokens"), F.min("end").alias("end"), F.max("session_id").alias("session_id")
    ).select(
        "event_key", F.when(F.col("session_id").isNotNull(), U.opaque_identity(F.lit("claude"), F.col("session_id"))).alias("session_key"),
        F.lit("claude").alias("runtime"),
        F.lit("Provider unreported").alias("provider"), F.lit("native").alias("model"), "output_tokens",
        F.when(F.col("output_tokens") % 2 == 0, F.col("end") - 2).alias("start"), "end", F.lit("native_log").alias("basis"),
    )
    linked = live.link_proxy(native, proxy)
    return linked.groupBy("runtime", "provider", "basis", "status").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("output_tokens").alias("output_tokens"), F.count("session_key").alias("with_session")
    )


def pending_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose responses are not measured, once per status."""
    paired = pairing.pair_responses(adapters.telemetry(spark, sf))
    pending = paired.where("status IN ('awaiting_usage', 'missing_timing', 'ambiguous_identity')").select(
        F.lit("codex").alias("runtime"), "session_key", "provider", "model", "status"
    )
    return live.distinct_pending(quality.strict(pending, quality.pending_rules(), "pending session"))


def broken_samples(spark: SparkSession, sf: str) -> DataFrame:
    """How many samples break each rule, with some times and counts spoiled."""
    rows = adapters.response_samples(spark, sf).withColumns(
        {
            "output_tokens": F.when(F.col("model") == "model-2", F.lit(0).cast("bigint")).otherwise(F.col("output_tokens")),
            "end": F.when(F.col("provider") == "prov-3", F.col("end") + 2).otherwise(F.col("end")),
        }
    )
    return quality.broken_counts(rows, quality.sample_rules())


QUERIES = {
    "otlp_flatten": otlp_flatten,
    "otlp_counts": otlp_counts,
    "otlp_pairs": otlp_pairs,
    "otlp_samples": otlp_samples,
    "late_output": late_output,
    "mixed_pairs": mixed_pairs,
    "live_rate": live_rate,
    "live_sessions": live_sessions,
    "busiest_sessions": busiest_sessions,
    "canonical_responses": canonical_responses,
    "receipt_deltas": receipt_deltas,
    "receipt_seconds": receipt_seconds,
    "receipt_average": receipt_average,
    "finished_bins": finished_bins,
    "source_status": source_status,
    "activity_gaps": activity_gaps,
    "proxy_link": proxy_link,
    "pending_sessions": pending_sessions,
    "broken_samples": broken_samples,
}
