"""Log packets of nested attributes flattened to response events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.projects import let

# The attributes that are read, and nothing else.
KINDS = ("response.created", "response.completed")
SESSION = ("conversation.id", "thread.id", "thread_id")
RESPONSE = ("response.id", "response_id", "gen_ai.response.id")
TOKENS = ("output_token_count", "usage.output_tokens", "gen_ai.usage.output_tokens", "output_tokens")
MODEL = ("model", "model.name", "gen_ai.request.model")
PROVIDER = ("model_provider", "model.provider", "gen_ai.provider.name", "gen_ai.system")
OTHER = ("event.name", "event.kind", "event.timestamp", "duration_ms", "success", "error")
FIELDS = (*SESSION, *RESPONSE, *TOKENS, *MODEL, *PROVIDER, *OTHER)
REQUEST_EVENT = "codex.websocket_request"
STREAM_EVENT = "codex.sse_event"
MAX_AGE_S = 1800


def attribute_map(items: Column) -> Column:
    """Allowed attributes of one level as text; null when a key repeats or has no single value."""
    known = F.filter(F.coalesce(items, F.array().cast(_ITEMS)), lambda a: a["key"].isin(*FIELDS))

    def text(a: Column) -> Column:
        v = a["value"]
        return F.coalesce(
            v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string")
        )

    def mapped(keys: Column, values: Column) -> Column:
        sound = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(values, lambda v: v.isNull())
        return F.when(sound, F.map_from_arrays(keys, values))

    def read(items: Column) -> Column:
        keys, values = F.transform(items, lambda a: a["key"]), F.transform(items, text)
        return let(keys, lambda k: let(values, lambda v: mapped(k, v)))

    return let(known, read)


_ITEMS = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"


def merged(outer: Column, inner: Column) -> Column:
    """Attributes of two levels; the inner one wins."""
    return F.map_concat(F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k)), inner)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns as rows of a generator.

    A filter above is not pushed below a generator and a projection not merged into it,
    so an expression is not written out again for each use of its column.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(F.inline(F.array(row)))


def log_records(packets: DataFrame) -> DataFrame:
    """One row per log record with its attributes, record over scope over resource."""
    resources = packets.select("received_at", F.explode("resourceLogs").alias("r"))
    scopes = resources.select(
        "received_at", attribute_map(F.col("r.resource.attributes")).alias("_shared"), F.explode("r.scopeLogs").alias("s")
    )
    records = scopes.select(
        "received_at", "_shared", attribute_map(F.col("s.scope.attributes")).alias("_scope"), F.explode("s.logRecords").alias("l")
    )
    own = records.withColumn("_own", attribute_map(F.col("l.attributes")))
    outer = own.withColumn("_outer", merged(F.col("_shared"), F.col("_scope")))
    return computed_once(
        outer, received_at=F.col("received_at"), nano=F.col("l.timeUnixNano"), a=merged(F.col("_outer"), F.col("_own"))
    )


def _first(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col("a")[n] for n in names])


def _count(text: Column) -> Column:
    """A non-negative whole number, else null."""
    return F.when(text.rlike(r"^[0-9]{1,19}$"), text.try_cast("bigint"))


def identity(value: Column, *prefix: str) -> Column:
    usable = F.when(F.length(value) <= 256, U.usable_identity(value))
    return F.when(usable.isNotNull(), U.opaque_identity(*[F.lit(p) for p in prefix], F.trim(usable)))


def flatten_otlp(packets: DataFrame) -> DataFrame:
    """Response events with a ``reason``: event, other, missing_identity, failed or invalid.

    A request event is a start, moved back by its duration. Times come from the
    record, or from a timestamp attribute that names its offset.
    """
    name, kind = F.col("a")["event.name"], F.col("a")["event.kind"]
    nano = _count(F.col("nano"))
    zoned = F.when(
        F.col("a")["event.timestamp"].rlike(r"(Z|[+-]\d{2}:?\d{2})$"),
        F.unix_micros(F.try_to_timestamp(F.col("a")["event.timestamp"])) / 1e6,
    )
    rows = computed_once(
        log_records(packets),
        received_at=F.col("received_at"),
        a=F.col("a"),
        _request=F.coalesce(name == REQUEST_EVENT, F.lit(False)),
        _kind=kind,
        _name=name,
        session_key=identity(_first(SESSION), "codex"),
        response_key=identity(_first(RESPONSE), "codex", "response"),
        source_at=F.coalesce(F.when(nano > 0, nano / 1e9), zoned),
        _duration=_count(F.col("a")["duration_ms"]),
        _tokens=_first(TOKENS),
        _success=F.lower(F.col("a")["success"]),
        _sound=(F.coalesce(F.col("a")["error"], F.lit("")).isin("", "false", "0", "0.0")),
        provider=U.safe_label(_first(PROVIDER), "Provider unreported"),
        model=U.safe_label(_first(MODEL), "Unknown"),
    )
    request = F.col("_request")
    stamp = F.when(request, F.col("source_at") - F.col("_duration") / 1000).otherwise(F.col("source_at"))
    completed = ~request & (F.col("_kind") == "response.completed")
    tokens = F.when(completed, _count(F.col("_tokens")))
    bad_time = F.col("source_at").isNull() | (F.col("source_at") <= 0) | (F.col("source_at") > F.col("received_at") + 1)
    bad_request = request & (
        F.col("_duration").isNull() | (F.col("_duration") > MAX_AGE_S * 1000) | F.coalesce(stamp <= 0, F.lit(False))
    )
    failed = request & ((F.coalesce(F.col("_success"), F.lit("true")) == "false") | ~F.col("_sound"))
    reason = (
        F.when(F.col("a").isNull(), "invalid")
        .when(~request & ~F.coalesce(F.col("_kind").isin(*KINDS), F.lit(False)), "other")
        .when(F.col("session_key").isNull() & ~F.coalesce(F.col("_name") == STREAM_EVENT, F.lit(False)), "missing_identity")
        .when(bad_time, "invalid")
        .when(request & F.col("_success").isNotNull() & ~F.col("_success").isin("true", "false"), "invalid")
        .when(failed, "failed")
        .when(bad_request, "invalid")
        .when(completed & F.col("_tokens").isNotNull() & tokens.isNull(), "invalid")
        .otherwise("event")
    )
    return rows.select(
        "session_key", "response_key",
        F.when(request, F.lit("response.created")).otherwise(F.col("_kind")).alias("kind"),
        F.when(request, F.lit("request")).otherwise(F.lit("response")).alias("start_origin"),
        stamp.alias("stamp"), "source_at", "received_at", tokens.alias("output_tokens"), "provider", "model",
        reason.alias("reason"),
    )


def response_events(flattened: DataFrame) -> DataFrame:
    return flattened.where("reason = 'event'").drop("reason")


def ingest_counts(flattened: DataFrame) -> DataFrame:
    """Records per reason, with how many carried a start, an end or a count."""
    event = F.col("reason") == "event"
    return flattened.groupBy("reason").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(event & (F.col("kind") == "response.created") & (F.col("start_origin") == "response")).alias("created_events"),
        F.count_if(event & (F.col("start_origin") == "request")).alias("websocket_request_events"),
        F.count_if(event & (F.col("kind") == "response.completed")).alias("completed_events"),
        F.count_if(event & F.col("output_tokens").isNotNull()).alias("output_counts_received"),
    )


def after_start(events: DataFrame, started_at: Column) -> DataFrame:
    """Only events from the start of reading on; what was exported before is not replayed."""
    return events.where(F.col("stamp") >= started_at)
