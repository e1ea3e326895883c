"""Table schemas as DDL text; a missing measurement is null, never zero."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 18)


def _struct(spec: str) -> str:
    return " ".join(spec.split())


def columns(schema: str) -> list[str]:
    """Column names of a flat schema."""
    depth, names = 0, []
    for part in schema.replace("`", "").split(", "):
        if depth == 0:
            names.append(part.split()[0])
        depth += part.count("<") - part.count(">") + part.count("(") - part.count(")")
    return names


REQUESTS = _struct(
    """request_id string, provider_id string, app_type string, model string, session_id string,
    input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint,
    input_token_semantics int, total_cost_usd decimal(38,18), latency_ms double, first_token_ms double,
    duration_ms double, status_code int, created_at bigint, data_source string"""
)
ROLLUPS = _struct(
    """date date, provider_id string, app_type string, model string, request_model string,
    pricing_model string, request_count bigint, success_count bigint, input_tokens bigint,
    output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint,
    input_token_semantics int, total_cost_usd decimal(38,18)"""
)
PROVIDERS = _struct("id string, app_type string, name string")
SOURCES = _struct("host string, host_order int, collected_at timestamp, host_timezone string, status string")

# Columns a source table may lack, with the value used instead.
OPTIONAL = {
    "session_id": None,
    "input_token_semantics": 0,
    "duration_ms": None,
    "first_token_ms": None,
    "request_model": None,
    "pricing_model": None,
}

# Columns added to requests by enrichment.
ENRICHED = _struct(
    """session_key string, session_title string, project_key string, project_name string,
    session_provider string, native_response_ms double"""
)

DAILY = _struct(
    """date date, host string, app string, provider string, model string, grain string, requests bigint,
    fresh_input_tokens bigint, output_tokens bigint, cache_read_tokens bigint,
    cache_creation_tokens bigint, total_tokens bigint, cost_usd decimal(38,18)"""
)
HOURLY = "hour string, " + DAILY
SESSION_DAILY = _struct(
    """date date, host string, app string, session_key string, model string, project_key string,
    project_name string, session_title string, requests bigint, fresh_input_tokens bigint,
    output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, total_tokens bigint,
    cost_usd decimal(38,18), tps_count bigint, tps_sum double, tps_max double, native_tps_count bigint,
    native_tps_sum double, native_tps_max double, hours map<string,bigint>"""
)
RESPONSES = _struct(
    """date date, hour string, host string, app string, model string, output_tokens bigint,
    duration_ms double, duration_source string, tps double, first_token_ms double"""
)
REQUEST_TPS = _struct(
    """date date, local_datetime string, host string, app string, provider string, model string,
    created_at bigint, output_tokens bigint, duration_ms double, duration_source string, tps double"""
)
ARCHIVE = _struct(
    """date date, host string, source_identity string, collected_at timestamp, timezone string, app string,
    model string, tokens bigint, requests bigint, cost_usd decimal(38,18)"""
)

SAMPLES = _struct(
    """source string, source_order int, event_key string, session_key string, runtime string,
    provider string, model string, output_tokens bigint, `start` double, `end` double, basis string,
    sampled_at double, received_at double"""
)
PENDING = _struct("source string, runtime string, session_key string, provider string, model string, status string")
MINUTES = _struct(
    """series string, day_only boolean, minute bigint, total_integral double, total_covered_s double,
    average_integral double, average_covered_s double, partial_s double, tokens bigint,
    usage_known boolean, usage_partial boolean"""
)
RECEIPTS = _struct("series string, minute bigint, output_tokens bigint, observed_s double, partial_s double")

_ATTRIBUTES = (
    "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
)
OTLP = _struct(
    f"""resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,
    scopeLogs:array<struct<scope:struct<attributes:{_ATTRIBUTES}>,
    logRecords:array<struct<timeUnixNano:string,attributes:{_ATTRIBUTES}>>>>>>"""
)

# One line of a conversation log of kind A, with its position in the file.
LOG_A = _struct(
    """timestamp string, type string, payload struct<id:string,type:string,role:string,call_id:string,
    model:string,model_provider:string,cwd:string,thread_id:string,response_id:string,
    subagent_history_start_ordinal:bigint,
    usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>,
    info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>,
                total_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,
                                         total_tokens:bigint>>>"""
)
LOG_B = _struct(
    """timestamp string, type string, sessionId string, agentId string, cwd string, customTitle string,
    model_provider string, provider string, isApiErrorMessage boolean,
    message struct<id:string,role:string,model:string,content:string,stop_reason:string,
                   usage:struct<output_tokens:bigint>>"""
)
LOG_B_BLOCKS = "array<struct<type:string,id:string,tool_use_id:string>>"
