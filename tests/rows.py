"""Small tables for tests."""

import datetime as dt
from decimal import Decimal

REQUEST = (
    "host string, host_order int, request_id string, provider_id string, app_type string, model string,"
    " session_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long,"
    " input_token_semantics int, total_cost_usd decimal(38,18), latency_ms double, first_token_ms double,"
    " duration_ms double, status_code int, created_at long, data_source string, session_key string,"
    " session_title string, project_key string, project_name string, session_provider string, native_response_ms double"
)
NAMES = [part.split()[0] for part in REQUEST.replace("(38,18)", "").split(",")]
DEFAULT = dict(
    host="one", host_order=0, request_id="r", provider_id="_session", app_type="codex", model="model",
    input_tokens=870, output_tokens=31, cache_read_tokens=430, cache_creation_tokens=70, input_token_semantics=0,
    total_cost_usd=Decimal("0.17"), status_code=200, created_at=5200, data_source="codex_session",
)
ROLLUP = (
    "host string, host_order int, date date, provider_id string, app_type string, model string, request_count long,"
    " input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long,"
    " input_token_semantics int, total_cost_usd decimal(38,18)"
)


def requests(spark, *rows):
    full = [{**dict.fromkeys(NAMES), **DEFAULT, **row} for row in rows]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], REQUEST)


def rollups(spark, *hosts):
    day = dt.date(2025, 5, 20)
    return spark.createDataFrame(
        [(h, i, day, "_session", "codex", "model", 4, 870, 31, 430, 70, 0, Decimal(0)) for i, h in enumerate(hosts)], ROLLUP
    )


def providers(spark, *rows):
    return spark.createDataFrame(list(rows), "host string, id string, app_type string, name string")


SESSION = (
    "date date, host string, app string, session_key string, model string, project_key string, project_name string,"
    " session_title string, requests long, fresh_input_tokens long, output_tokens long, cache_read_tokens long,"
    " cache_creation_tokens long, total_tokens long, cost_usd decimal(38,18), tps_count long, tps_sum double,"
    " tps_max double, native_tps_count long, native_tps_sum double, native_tps_max double, hours map<string,long>"
)
SESSION_NAMES = [part.split()[0] for part in SESSION.replace("(38,18)", "").replace("map<string,long>", "map").split(",")]
SESSION_DEFAULT = dict(
    date="2026-01-01", host="fictional", app="Codex", session_key="s1", model="a", project_key="one",
    project_name="Shared name", session_title="", requests=2, fresh_input_tokens=10, output_tokens=20,
    cache_read_tokens=60, cache_creation_tokens=10, total_tokens=100, cost_usd="0.5", tps_count=2, tps_sum=60.0,
    tps_max=40.0, native_tps_count=0, native_tps_sum=0.0, native_tps_max=0.0, hours={},
)


def sessions(spark, *rows):
    out = []
    for row in rows:
        full = {**SESSION_DEFAULT, **row}
        full["date"] = dt.date.fromisoformat(full["date"])
        full["cost_usd"] = Decimal(full["cost_usd"])
        out.append(tuple(full[n] for n in SESSION_NAMES))
    return spark.createDataFrame(out, SESSION)


DAILY = (
    "date date, hour string, host string, app string, provider string, model string, grain string, requests long,"
    " total_tokens long, cost_usd decimal(38,18)"
)


def usage(spark, *rows):
    """Rows of (date, model, tokens, cost) with optional hour."""
    return spark.createDataFrame(
        [
            (dt.date.fromisoformat(r[0]), r[4] if len(r) > 4 else "Unknown hour", "h", "Codex", "p", r[1], "request", 1, r[2], Decimal(r[3]))
            for r in rows
        ],
        DAILY,
    )
