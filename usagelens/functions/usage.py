"""Token, label and timing expressions over ledger columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The apps whose input count includes cached tokens, the sources
# that copy what a proxy also recorded, and placeholder identifiers.
CACHED_INPUT_APPS = ("codex", "gemini", "grokbuild")
SESSION_SOURCES = ("session_log", "codex_session", "gemini_session", "opencode_session")
CLAUDE_APPS = ("claude", "claude-desktop")
EMPTY_IDENTITIES = ("unknown", "none", "null", "default")
COMPONENTS = ("fresh_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
UNKNOWN_HOUR = "Unknown hour"
HIDDEN_MODEL = "codex-auto-review"
NO_VALUE = "—"


def fail(message: Column | str, kind: str = "boolean") -> Column:
    """An expression that stops the job when it is reached."""
    return F.raise_error(F.lit(message) if isinstance(message, str) else message).cast(kind)


def require(ok: Column, message: Column | str) -> Column:
    """A filter that passes every row and stops the job at the first bad one."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(fail(message))


def finite_positive(value: Column) -> Column:
    """Null unless the value is a finite number above zero."""
    number = value.cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number < F.lit(float("inf"))), number)


def fresh_input() -> Column:
    """Input tokens without the cached part, for apps that count it in.

    Semantics 0 counts cache reads in the input, 1 counts reads and writes, 2
    neither. An input smaller than its cached part is left as recorded.
    """
    semantics = F.coalesce(F.col("input_token_semantics"), F.lit(0))
    tokens = F.col("input_tokens")
    cached = F.col("cache_read_tokens") + F.when(semantics == 1, F.col("cache_creation_tokens")).otherwise(F.lit(0))
    included = (semantics != 2) & F.col("app_type").isin(*CACHED_INPUT_APPS) & (tokens >= cached)
    return (
        F.when(
            ~semantics.isin(0, 1, 2),
            fail(F.concat(F.lit("Unknown meaning of input tokens: "), semantics.cast("string")), "bigint"),
        )
        .when(included, tokens - cached)
        .otherwise(tokens)
    )


def total_tokens() -> Column:
    return F.col("fresh_input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")


def model_label(model: Column) -> Column:
    return F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown"))


def app_label(app_type: Column) -> Column:
    """One label for both Claude apps; others in title case, each letter run alone."""
    runs = F.regexp_extract_all(F.lower(app_type), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    return (
        F.when(app_type.isin(*CLAUDE_APPS), F.lit("Claude Code"))
        .when(app_type.rlike("^[a-z]+$"), F.initcap(app_type))
        .otherwise(titled)
    )


def provider_label(session_provider: Column, known_name: Column, provider_id: Column) -> Column:
    unknown = F.when(provider_id.startswith("_"), F.lit("Session / provider unknown")).otherwise(
        F.lit("Unresolved provider")
    )
    return F.coalesce(F.nullif(session_provider, F.lit("")), known_name, unknown)


def wall_clock(epoch_s: Column, timezone: str) -> Column:
    """Local date and time of an epoch second in a named zone.

    Built on TIMESTAMP_NTZ, so the session time zone has no part in it.
    """
    utc = F.timestamp_add("SECOND", epoch_s.cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return utc if timezone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)


def local_date(epoch_s: Column, timezone: str) -> Column:
    """Local day of an epoch second; plain arithmetic where the zone is UTC."""
    if timezone == "UTC":
        return F.date_from_unix_date(F.floor(epoch_s / 86400).cast("int"))
    return wall_clock(epoch_s, timezone).cast("date")


def local_hour(epoch_s: Column, timezone: str) -> Column:
    """Local hour as two digits."""
    if timezone == "UTC":
        hour = F.floor(F.pmod(epoch_s, F.lit(86400)) / 3600)
    else:
        hour = F.hour(wall_clock(epoch_s, timezone))
    return F.lpad(hour.cast("string"), 2, "0")


def response_duration() -> Column:
    """Recorded elapsed time: duration first, then latency; null when neither is usable."""
    return F.coalesce(finite_positive(F.col("duration_ms")), finite_positive(F.col("latency_ms")))


def recorded_timing_source() -> Column:
    return F.when(finite_positive(F.col("duration_ms")).isNotNull(), F.lit("duration_ms")).when(
        finite_positive(F.col("latency_ms")).isNotNull(), F.lit("latency_ms")
    )


def first_token_latency(duration: Column) -> Column:
    """A first-token time longer than the recorded response is not usable."""
    latency = finite_positive(F.col("first_token_ms"))
    return F.when(duration.isNull() | (latency <= duration), latency)


def success() -> Column:
    return F.col("status_code").between(200, 299)


def usable_identity(value: Column) -> Column:
    """Null for blank and placeholder identifiers."""
    trimmed = F.lower(F.trim(value))
    return F.when((trimmed != "") & ~trimmed.isin(*EMPTY_IDENTITIES), value)


def session_key(session_id: Column) -> Column:
    return F.sha2(usable_identity(session_id), 256)


def opaque_identity(*parts: Column) -> Column:
    """One hashed identity from several parts; nulls keep their place."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def native_response_id(request_id: Column) -> Column:
    """The client's own response id inside a ledger id."""
    return F.regexp_replace(request_id, "^session:", "")


def clean_label(value: Column, limit: int = 200, default: str = "Unknown") -> Column:
    """Printable characters only, shortened; the default when nothing is left."""
    printable = F.substring(F.regexp_replace(F.trim(value), r"[\p{C}\p{Zl}\p{Zp}]", ""), 1, limit)
    return F.coalesce(F.nullif(printable, F.lit("")), F.lit(default))


def safe_label(value: Column, default: str) -> Column:
    """A label from telemetry; paths, URLs and odd characters give the default."""
    # Accepted label pattern and the rejected drive and URL forms.
    accepted = value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.:/+ -]{0,119}\z")
    refused = value.rlike(r"^[A-Za-z]:[/\\]") | value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when(accepted & ~refused, value).otherwise(F.lit(default))


def model_list(models: Column) -> Column:
    """Display text of a model set without the internal review label."""
    shown = F.array_join(F.array_sort(F.filter(models, lambda m: m != HIDDEN_MODEL)), ", ")
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit(NO_VALUE))


def claude_like(model: Column) -> Column:
    return model.rlike(r"(?i)^claude(-|$)")


def source_fingerprint(settings: Column) -> Column:
    """Hash of a settings map without the keys that do not change what is read."""
    # Settings that leave the history unchanged.
    kept = F.map_filter(settings, lambda k, _: ~k.isin("python", "codex_otel_port"))
    return F.sha2(F.to_json(F.array_sort(F.map_entries(kept))), 256)
