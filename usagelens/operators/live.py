"""Live token rates, receipts and coverage from response samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.operators.prefix import previous_within

# Fixed values, in seconds: rate window, heartbeat expiry, receipt average, export age.
WINDOW_S = 5
HEARTBEAT_S = 3
AVERAGE_S = 300
EXPORT_S = 30
MAX_PAUSE_S = 2.5
OTLP_BASIS = "codex_otel"


def _other_codex() -> Column:
    return (F.col("runtime") == "codex") & (F.col("basis") != OTLP_BASIS)


def drop_superseded(samples: DataFrame) -> DataFrame:
    """Once a session has telemetry samples, its other Codex samples do not count."""
    authority = (
        samples.where((F.col("runtime") == "codex") & (F.col("basis") == OTLP_BASIS) & F.col("session_key").isNotNull())
        .select(F.col("session_key").alias("_session"))
        .distinct()
    )
    return samples.join(authority, _other_codex() & (F.col("session_key") == F.col("_session")), "left_anti")


def canonical_responses(samples: DataFrame) -> DataFrame:
    """One row per response from all its copies; ``conflict`` marks those that disagree.

    Each source's last report counts. Telemetry comes before native logs and those
    before proxies, then copies with a session, then the order of the sources.
    """
    basis = F.when(F.col("basis") == OTLP_BASIS, 0).when(F.lower("basis").contains("proxy"), 2).otherwise(1)
    payload = ["source", "session_key", "runtime", "provider", "model", "output_tokens", "start", "end", "basis", "sampled_at", "received_at"]
    last = drop_superseded(samples).groupBy("event_key", "source", "source_order").agg(
        F.max(F.struct("received_at", "output_tokens", *[c for c in payload if c not in ("source", "received_at", "output_tokens")])).alias("_r")
    ).select("event_key", "source", "source_order", "_r.*")
    report = F.struct("runtime", "output_tokens")
    grouped = last.groupBy("event_key").agg(
        F.min(F.struct(basis.alias("rank"), F.col("session_key").isNull().alias("no_session"), "source_order", *payload)).alias("_r"),
        F.min(report).alias("_a"), F.max(report).alias("_b"),
        F.min("session_key").alias("_s"), F.max("session_key").alias("_t"),
    )
    conflict = (F.col("_a") != F.col("_b")) | F.coalesce(F.col("_s") != F.col("_t"), F.lit(False))
    return grouped.select("event_key", *[F.col(f"_r.{c}").alias(c) for c in payload], conflict.alias("conflict"))


def rebased(samples: DataFrame) -> DataFrame:
    """Times relative to arrival, so that a source's clock offset cancels."""
    shift = F.col("received_at") - F.col("sampled_at")
    return samples.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift})


def rate_cells(samples: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Share of each response in the trailing window of every second it touches.

    Output is spread evenly over the response. A response reaches as many seconds
    as it and the window last; pairing refuses anything older than 30 minutes.
    """
    first, last = F.floor("start") + 1, F.ceil(F.col("end") + window_s) - 1
    cells = samples.where("end > start").withColumn("second", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("end"), F.col("second")) - F.greatest(F.col("start"), F.col("second") - window_s)
    tps = F.col("output_tokens") * overlap / (F.col("end") - F.col("start")) / window_s
    return cells.where(overlap > 0).withColumn("tps", tps)


def session_rates(cells: DataFrame) -> DataFrame:
    """Rate per second and session; output without a session stays apart per response."""
    own = F.coalesce("session_key", F.concat(F.lit("event:"), F.col("event_key")))
    return (
        cells.groupBy("second", "runtime", own.alias("contributor"), "session_key")
        .agg(F.sum("tps").alias("tps"))
    )


def live_totals(sessions: DataFrame) -> DataFrame:
    """Total per second, and the mean per session where all output has one."""
    grouped = sessions.groupBy("second").agg(
        F.sum("tps").alias("total_tps"),
        F.count("session_key").alias("contributing_sessions"),
        F.bool_or(F.col("session_key").isNull()).alias("unattributed"),
    )
    average = F.when(
        ~F.col("unattributed"), F.try_divide(F.col("total_tps"), F.col("contributing_sessions"))
    )
    return grouped.withColumn("average_tps", average)


def observed_totals(totals: DataFrame, seconds: DataFrame) -> DataFrame:
    """Totals on watched seconds: zero when nothing ran under full coverage, null when unknown."""
    joined = seconds.select("second", "fresh", "partial").join(totals, "second", "left")
    seen = F.col("fresh") & (F.col("total_tps").isNotNull() | ~F.col("partial"))
    return joined.withColumn("total_tps", F.when(seen, F.coalesce("total_tps", F.lit(0.0))))


def ranked_sessions(sessions: DataFrame) -> DataFrame:
    """Every session rate with its place within the second; ties by runtime and contributor."""
    order = Window.partitionBy("second").orderBy(F.col("tps").desc(), "runtime", "contributor")
    return sessions.withColumn("place", F.row_number().over(order))


def source_status(heartbeats: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Each source by its last packet: fresh, error, stale or initializing."""
    last = heartbeats.groupBy("source").agg(
        F.max("received_at").alias("received_at"),
        F.max_by("coverage", "received_at").alias("coverage"),
        F.max_by("error", "received_at").alias("error"),
    )
    joined = sources.select("source").join(last, "source", "left")
    age = now - F.col("received_at")
    state = (
        F.when(F.col("received_at").isNull(), F.when(F.col("error").isNotNull(), "error").otherwise("initializing"))
        .when(age >= HEARTBEAT_S, "stale")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("fresh")
    )
    complete = (state == "fresh") & (F.col("coverage") == "complete")
    return joined.select("source", F.greatest(F.lit(0.0), age).alias("age_seconds"), state.alias("status"), complete.alias("complete"))


def overall_status(statuses: DataFrame) -> DataFrame:
    watched = F.count_if(F.col("status").isin("fresh", "error"))
    state = (
        F.when(F.count_if(F.col("status") != "initializing") == 0, "initializing")
        .when(watched == 0, "unavailable")
        .when(F.bool_and("complete"), "complete")
        .otherwise("partial")
    )
    return statuses.agg(state.alias("status"))


def receipt_deltas(samples: DataFrame) -> DataFrame:
    """New output per response at the time it was first reported.

    Reports are cumulative, so repeats and copies add nothing. Equal reports
    collapse before the window, which then holds a response's distinct counts.
    Responses whose copies finally disagree are marked and do not count.
    """
    kept = drop_superseded(samples)
    arrivals = kept.groupBy("event_key", "output_tokens").agg(F.min("received_at").alias("received_at"))
    earlier = Window.partitionBy("event_key").orderBy("received_at", "output_tokens").rowsBetween(
        Window.unboundedPreceding, -1
    )
    known = F.coalesce(F.max("output_tokens").over(earlier), F.lit(0))
    deltas = arrivals.withColumn("delta", F.col("output_tokens") - known).where("delta > 0")
    verdict = canonical_responses(samples).select("event_key", "session_key", "runtime", "conflict")
    return deltas.join(verdict, "event_key").select(
        "event_key", "session_key", "runtime", "received_at", "delta", F.col("conflict").alias("excluded")
    )


def receipt_seconds(deltas: DataFrame) -> DataFrame:
    """Counted output per arrival second; excluded output leaves the second partial."""
    return deltas.groupBy(F.floor("received_at").alias("second")).agg(
        F.sum(F.when(F.col("excluded"), 0).otherwise(F.col("delta"))).cast("bigint").alias("output_tokens"),
        F.bool_or("excluded").alias("excluded"),
    )


def watched_seconds(ticks: DataFrame) -> DataFrame:
    """Whole seconds between consecutive readings; after a stall they are a gap."""
    pairs = previous_within(ticks, ["series"], "tick", [], ["fresh"], MAX_PAUSE_S).where("previous IS NOT NULL")
    first, last = F.floor("previous._time"), F.floor("tick") - 1
    seconds = pairs.withColumn("second", F.explode(F.when(last >= first, F.sequence(first, last))))
    return seconds.groupBy("series", "second").agg(
        F.bool_and("fresh").alias("observed"), F.bool_or(F.col("status") != "complete").alias("partial")
    )


def finished_bins(seconds: DataFrame, watched: DataFrame) -> DataFrame:
    """Receipt bins: a watched second without output is zero, an unwatched one unknown."""
    joined = watched.join(seconds, "second", "full")
    observed = F.coalesce("observed", F.lit(False))
    tokens = F.coalesce("output_tokens", F.lit(0).cast("bigint"))
    return joined.select(
        "second",
        F.when((tokens > 0) | observed, tokens).alias("output_tokens"),
        observed.alias("observed"),
        (F.coalesce("partial", F.lit(True)) | F.coalesce("excluded", F.lit(False))).alias("partial"),
    )


def receipt_average(deltas: DataFrame, window_s: int = AVERAGE_S) -> DataFrame:
    """Output that arrived in the window up to each second, over its whole length.

    Arrivals are summed per second before each second is spread over the window.
    """
    exact = F.col("received_at") == F.floor("received_at")
    due = deltas.where("NOT excluded").groupBy(F.ceil("received_at").alias("_first"), exact.alias("_exact")).agg(
        F.sum("delta").alias("_tokens")
    )
    # An arrival right on a second is still inside the window that starts there.
    last = F.col("_first") + window_s - F.when(F.col("_exact"), 0).otherwise(1)
    cells = due.withColumn("second", F.explode(F.sequence(F.col("_first"), last)))
    return cells.groupBy("second").agg(F.sum("_tokens").alias("output_tokens")).withColumn(
        "average_tps", F.col("output_tokens") / window_s
    )


def activity_gaps(
    trace: DataFrame, samples: DataFrame, now: float, telemetry: DataFrame | None = None, window_s: int = WINDOW_S
) -> DataFrame:
    """Sessions with traced activity up to ``now`` whose output nothing has read at or after it.

    Reading means a sample from the log or from telemetry, not a proxy's elapsed
    time, or a telemetry event of the session.
    """
    active = trace.where((F.col("stamp") >= now - 120) & (F.col("stamp") <= now)).groupBy("session_key").agg(
        F.max("stamp").alias("stamp")
    )
    recent = (F.col("runtime") == "codex") & F.col("basis").isin("native_log", "codex_otel")
    read = samples.where(recent & F.col("end").between(now - window_s, now)).select("session_key", F.col("end").alias("read"))
    if telemetry is not None:
        read = read.unionByName(telemetry.where(F.col("stamp") <= now).select("session_key", F.col("stamp").alias("read")))
    last = read.groupBy(F.col("session_key").alias("_session")).agg(F.max("read").alias("_read"))
    unread = active.join(last, (F.col("session_key") == F.col("_session")) & (F.col("_read") >= F.col("stamp")), "left_anti")
    return unread.select("session_key", "stamp", F.lit("awaiting_usage").alias("status"))


def proxy_samples(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Successful proxy rows as samples; without a duration there is no interval."""
    rows = requests.where((F.coalesce("data_source", F.lit("proxy")) == "proxy") & U.success() & (F.col("output_tokens") > 0))
    runtime = F.when(F.col("app_type").isin(*U.CLAUDE_APPS), F.lit("claude")).otherwise(F.lower("app_type"))
    native = F.col("request_id").startswith("session:")
    key = U.opaque_identity(
        runtime, F.when(native, F.lit("response")).otherwise(F.lit("proxy")), U.native_response_id(F.col("request_id"))
    )
    elapsed = U.response_duration() / 1000
    names = providers.groupBy("host", F.col("id").alias("provider_id"), "app_type").agg(F.min("name").alias("_name"))
    end = F.col("created_at").cast("double")
    return rows.join(names, ["host", "provider_id", "app_type"], "left").select(
        F.col("host").alias("source"), "request_id", key.alias("event_key"), runtime.alias("runtime"),
        F.coalesce("_name", F.lit("Unresolved provider")).alias("provider"),
        U.clean_label(F.col("model"), 120).alias("model"), "output_tokens",
        (end - elapsed).alias("start"), end.alias("end"), F.lit("proxy_elapsed").alias("basis"), "session_id",
    )


# Runtimes whose proxy marks session ids that the client gave, and the shortest such id behind the mark.
MARKED_RUNTIMES, LEAST_MARKED = ("codex", "grokbuild"), 11


def trusted_session(proxy: DataFrame, native: DataFrame) -> DataFrame:
    """Adds ``session_key`` to proxy rows: only of sessions that logs know, or that the client is known to have named."""
    own = F.col("session_id")
    usable = U.usable_identity(own).isNotNull() & ~own.eqNullSafe(F.col("request_id")) & ~own.eqNullSafe(F.concat(F.lit("session:"), "request_id"))
    plain = proxy.withColumn("_candidate", F.when(usable, U.opaque_identity(F.col("runtime"), own)))
    known = native.where("session_key IS NOT NULL").select("runtime", F.col("session_key").alias("_candidate")).distinct()
    marked = usable & F.col("runtime").isin(*MARKED_RUNTIMES) & own.startswith(F.concat("runtime", F.lit("_")))
    marked &= F.length(own) > F.length("runtime") + LEAST_MARKED
    bare = F.substring(own, F.length("runtime") + 2, F.length(own))
    seen = plain.join(known.withColumn("_known", F.lit(True)), ["runtime", "_candidate"], "left")
    key = F.when(F.col("_known"), F.col("_candidate")).when(marked, U.opaque_identity(F.col("runtime"), bare))
    return seen.withColumn("session_key", key).drop("_candidate", "_known")


def link_proxy(native: DataFrame, proxy: DataFrame, codex_native: bool = True) -> DataFrame:
    """Native responses and the proxy rows that add to them, one row per response.

    A proxy names the provider of the same native response and supplies an
    interval only where the log had none. Its own session counts only where it can
    be trusted. Codex proxies give way to native logs.
    """
    others = proxy.where(F.col("runtime") != "codex") if codex_native else proxy
    fields = ["output_tokens", "runtime", "provider", "model", "start", "end", "basis", "session_key"]
    best = trusted_session(others, native).groupBy("event_key").agg(F.max(F.struct(*fields)).alias("p"))
    joined = native.join(best, "event_key", "full")
    logged = F.col("runtime").isNotNull()
    untimed = F.col("start").isNull()
    provider = F.when(logged & (F.col("provider") != "Provider unreported"), F.col("provider"))
    return joined.select(
        "event_key",
        F.when(logged, F.col("session_key")).otherwise(F.col("p.session_key")).alias("session_key"),
        F.coalesce("runtime", "p.runtime").alias("runtime"),
        F.coalesce(provider, F.col("p.provider"), F.col("provider")).alias("provider"),
        F.when(logged, F.col("model")).otherwise(F.col("p.model")).alias("model"),
        F.when(logged & ~untimed, F.col("output_tokens")).otherwise(F.coalesce("p.output_tokens", "output_tokens")).alias("output_tokens"),
        F.coalesce("start", "p.start").alias("start"),
        F.when(~untimed, F.col("end")).otherwise(F.col("p.end")).alias("end"),
        F.when(~untimed, F.col("basis")).otherwise(F.coalesce("p.basis", "basis")).alias("basis"),
    ).withColumn("status", F.when(F.col("start").isNull(), "missing_timing").otherwise("measured"))


def distinct_pending(pending: DataFrame) -> DataFrame:
    """One row per runtime, session and status."""
    rest = [c for c in pending.columns if c not in ("runtime", "session_key", "status")]
    return pending.groupBy("runtime", "session_key", "status").agg(*[F.max(c).alias(c) for c in rest])


def ordered_issues(issues: DataFrame, by: list[str], order: str) -> DataFrame:
    """Distinct issue texts per group, in the order they were first seen."""
    first = issues.groupBy(*by, "issue").agg(F.min(order).alias("_seen"))
    listed = F.array_sort(F.collect_list(F.struct("_seen", "issue")))
    return first.groupBy(*by).agg(F.transform(listed, lambda x: x["issue"]).alias("issues"))
