"""The report queries as plain SQL over the given tables, for checking."""

from __future__ import annotations

BASE = """
base AS (
  SELECT l_orderkey AS k, l_partkey AS pk,
    'h' || (l_orderkey % 3) AS host, CAST(l_orderkey % 3 AS INT) AS host_order,
    (CASE WHEN l_suppkey % 4 = 1 THEN 'session:m' ELSE '' END)
      || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
      || '-' || (CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS request_id,
    CASE WHEN l_suppkey % 5 = 0 THEN '_session' ELSE 'p' || (l_suppkey % 5) END AS provider_id,
    CASE l_suppkey % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-desktop' ELSE 'gemini' END AS app_type,
    CASE WHEN l_partkey % 9 = 8 THEN 'unknown' ELSE 'model-' || (l_partkey % 9) END AS model,
    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 's' || (l_orderkey % 500) END AS session_id,
    CAST(l_quantity AS BIGINT) * 20 AS input_tokens, CAST(l_quantity AS BIGINT) * 7 AS output_tokens,
    (l_partkey % 5) * 100 AS cache_read_tokens, (l_suppkey % 3) * 10 AS cache_creation_tokens,
    CAST(l_orderkey % 3 AS INT) AS input_token_semantics,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents,
    CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(500 + (l_partkey * 37) % 9000 AS DOUBLE) END AS duration_ms,
    CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(300 + (l_suppkey * 53) % 7000 AS DOUBLE) END AS latency_ms,
    CAST((l_partkey * 13) % 4000 AS DOUBLE) AS first_token_ms,
    CASE WHEN l_partkey % 24 = 0 THEN CAST(400 + (l_partkey * 17) % 5000 AS DOUBLE) END AS native_response_ms,
    CASE WHEN l_linenumber = 7 THEN 500 ELSE 200 END AS status_code,
    CAST(epoch(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS BIGINT)
      + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 AS created_at,
    CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'proxy' END AS data_source
  FROM lineitem),
ledger AS (
  SELECT * FROM base
  UNION ALL
  SELECT * REPLACE ('s-' || request_id AS request_id, '_session' AS provider_id, NULL AS duration_ms,
    NULL AS latency_ms, NULL AS first_token_ms, 200 AS status_code,
    created_at + pk % 1300 - 650 AS created_at, 'codex_session' AS data_source)
  FROM base WHERE k % 10 = 0
  UNION ALL
  SELECT * REPLACE ('h9' AS host, 9 AS host_order) FROM base WHERE k % 17 = 0),
numbered AS (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS n FROM ledger),
requests AS (
  SELECT * EXCLUDE (n), sha256(session_id) AS session_key,
    CASE WHEN n % 2 = 0 THEN 'Title ' || n END AS session_title,
    CASE WHEN n % 3 < 2 THEN sha256('["dropbox",["P' || (n % 12) || '"]]')
         WHEN n % 6 = 2 THEN sha256('/home/u/work/P' || (n % 12)) END AS project_key,
    CASE WHEN n % 3 < 2 OR n % 6 = 2 THEN 'P' || (n % 12) END AS project_name,
    CASE WHEN data_source = 'codex_session' AND n % 4 <> 0 THEN 'prov-' || (n % 7) END AS session_provider
  FROM numbered),
effective AS (
  SELECT r.* FROM requests r
  WHERE NOT (coalesce(r.data_source, 'proxy') = 'codex_session' AND EXISTS (
    SELECT 1 FROM requests p
    WHERE p.host = r.host AND p.input_tokens = r.input_tokens AND p.output_tokens = r.output_tokens
      AND p.cache_read_tokens = r.cache_read_tokens
      AND coalesce(p.data_source, 'proxy') = 'proxy' AND p.status_code BETWEEN 200 AND 299
      AND (p.app_type = r.app_type OR (r.app_type = 'claude' AND p.app_type = 'claude-desktop'))
      AND (p.cache_creation_tokens = r.cache_creation_tokens OR r.cache_creation_tokens = 0)
      AND (p.model = r.model OR p.model = 'unknown' OR r.model = 'unknown')
      AND abs(p.created_at - r.created_at) <= 600))),
uniq AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY app_type, request_id ORDER BY host_order, created_at) AS rn
    FROM effective) WHERE rn = 1),
rb AS (
  SELECT 'h' || (o_custkey % 3) AS host, CAST(o_custkey % 3 AS INT) AS host_order, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_custkey % 5 = 0 THEN '_session' ELSE 'p' || (o_custkey % 5) END AS provider_id,
    CASE o_custkey % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-desktop' ELSE 'gemini' END AS app_type,
    'model-' || (o_custkey % 9) AS model, CAST(o_custkey % 3 AS INT) AS input_token_semantics,
    CAST(count(*) AS BIGINT) AS request_count,
    CAST(sum(o_custkey % 1000 + 500) AS BIGINT) AS input_tokens, CAST(sum(o_custkey % 90) AS BIGINT) AS output_tokens,
    CAST(sum(o_custkey % 7 * 100) AS BIGINT) AS cache_read_tokens,
    CAST(sum(o_custkey % 3 * 10) AS BIGINT) AS cache_creation_tokens,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost_cents
  FROM orders GROUP BY 1, 2, 3, 4, 5, 6, 7),
rollups AS (
  SELECT * FROM rb UNION ALL
  SELECT * REPLACE ('h9' AS host, 9 AS host_order) FROM rb WHERE input_tokens % 11 = 0),
provs AS (
  SELECT 'p' || (s_suppkey % 4) AS provider_id, min(n_name) AS provider_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
usage_in AS (
  SELECT host, app_type, provider_id, session_provider, model, 'request' AS grain, 1 AS n,
    CAST(make_timestamp(created_at * 1000000) AS DATE) AS date,
    lpad(CAST(created_at % 86400 // 3600 AS VARCHAR), 2, '0') AS hour,
    input_token_semantics, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, cost_cents
  FROM uniq
  UNION ALL
  SELECT host, app_type, provider_id, NULL, model, 'rollup', request_count, date, 'Unknown hour',
    input_token_semantics, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, cost_cents
  FROM rollups),
"""

LABELS = """
    CASE WHEN app_type IN ('claude', 'claude-desktop') THEN 'Claude Code'
         ELSE upper(app_type[1]) || substr(app_type, 2) END"""
FRESH = """
    CASE WHEN input_token_semantics <> 2 AND app_type IN ('codex', 'gemini')
      AND input_tokens >= cache_read_tokens + CASE WHEN input_token_semantics = 1 THEN cache_creation_tokens ELSE 0 END
      THEN input_tokens - cache_read_tokens - CASE WHEN input_token_semantics = 1 THEN cache_creation_tokens ELSE 0 END
      ELSE input_tokens END"""

USAGE = (
    BASE
    + f"""
usage AS (
  SELECT u.* EXCLUDE (provider_id), {LABELS} AS app, {FRESH} AS fresh_input_tokens,
    coalesce(session_provider, provider_name,
      CASE WHEN starts_with(u.provider_id, '_') THEN 'Session / provider unknown' ELSE 'Unresolved provider' END) AS provider
  FROM usage_in u LEFT JOIN provs ON provs.provider_id = u.provider_id),
hourly AS (
  SELECT date, hour, host, app, provider, model, grain, CAST(sum(n) AS BIGINT) AS requests,
    CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
    CAST(sum(fresh_input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cost_cents) AS BIGINT) AS cost_cents
  FROM usage GROUP BY ALL),
daily AS (
  SELECT date, host, app, provider, model, grain, CAST(sum(requests) AS BIGINT) AS requests,
    CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents
  FROM hourly GROUP BY ALL),
timed AS (
  SELECT *, {LABELS} AS app, {FRESH} AS fresh,
    CAST(make_timestamp(created_at * 1000000) AS DATE) AS date,
    lpad(CAST(created_at % 86400 // 3600 AS VARCHAR), 2, '0') AS hour,
    output_tokens > 0 AND status_code BETWEEN 200 AND 299 AS answered,
    coalesce(CASE WHEN duration_ms > 0 THEN duration_ms END, CASE WHEN latency_ms > 0 THEN latency_ms END) AS recorded_ms
  FROM uniq),
rated AS (
  SELECT *, CASE WHEN answered THEN output_tokens * 1000.0::DOUBLE / recorded_ms END AS recorded_tps,
    CASE WHEN answered AND recorded_ms IS NULL THEN output_tokens * 1000.0::DOUBLE / native_response_ms END AS native_tps
  FROM timed),
responses AS (
  SELECT date, hour, host, app, model, output_tokens,
    coalesce(recorded_ms, native_response_ms) AS duration_ms,
    CASE WHEN duration_ms > 0 THEN 'duration_ms' WHEN latency_ms > 0 THEN 'latency_ms'
         WHEN native_response_ms > 0 THEN 'native_log' ELSE '' END AS duration_source,
    coalesce(recorded_tps, native_tps) AS tps,
    CASE WHEN first_token_ms > 0 AND (recorded_ms IS NULL OR first_token_ms <= recorded_ms) THEN first_token_ms END AS first_token_ms
  FROM rated WHERE answered),
session_in AS (
  SELECT *, coalesce(project_key, '') AS pkey,
    fresh + output_tokens + cache_read_tokens + cache_creation_tokens AS tokens FROM rated WHERE session_key IS NOT NULL),
session_hours AS (
  SELECT date, host, app, session_key, model, pkey AS project_key, hour, CAST(sum(tokens) AS BIGINT) AS tokens
  FROM session_in GROUP BY ALL),
sessions AS (
  SELECT date, host, app, session_key, model, pkey AS project_key,
    max(coalesce(session_title, '')) AS session_title, max(coalesce(project_name, '')) AS project_name,
    CAST(count(*) AS BIGINT) AS requests, CAST(sum(fresh) AS BIGINT) AS fresh_input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cost_cents) AS BIGINT) AS cost_cents,
    CAST(count(recorded_tps) AS BIGINT) AS tps_count, coalesce(sum(recorded_tps), 0) AS tps_sum,
    coalesce(max(recorded_tps), 0) AS tps_max, CAST(count(native_tps) AS BIGINT) AS native_tps_count,
    coalesce(sum(native_tps), 0) AS native_tps_sum, coalesce(max(native_tps), 0) AS native_tps_max
  FROM session_in GROUP BY ALL),
native AS (
  SELECT * REPLACE (tps_count + native_tps_count AS tps_count, tps_sum + native_tps_sum AS tps_sum,
    greatest(tps_max, native_tps_max) AS tps_max) FROM sessions),
"""
)


def usage(tail: str, ctes: str = "") -> str:
    return "WITH " + (USAGE + ctes).rstrip().rstrip(",") + "\n" + tail


def ledger(tail: str, ctes: str = "") -> str:
    return "WITH " + (BASE + ctes).rstrip().rstrip(",") + "\n" + tail


def _b(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


TOTALS = ", ".join(
    [
        *[
            _b(f"sum({c})", c)
            for c in (
                "total_tokens", "requests", "fresh_input_tokens", "output_tokens", "cache_read_tokens",
                "cache_creation_tokens", "cost_cents", "tps_count", "native_tps_count",
            )
        ],
        "round(CASE WHEN sum(tps_count) > 0 THEN sum(tps_sum) / sum(tps_count) END, 6) AS tps_avg",
        "round(max(tps_max), 6) AS tps_max",
    ]
)
MEASURES = ", ".join([_b("sum(total_tokens)", "tokens"), _b("sum(requests)", "requests"), _b("sum(cost_cents)", "cost_cents")])
YEAR = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
WEEK = "date BETWEEN DATE '1998-03-02' AND DATE '1998-03-08'"
DAY = "date BETWEEN DATE '1998-03-04' AND DATE '1998-03-04'"
FORTNIGHT = "date BETWEEN DATE '1998-03-02' AND DATE '1998-03-15'"


def _stats(keys: str, source: str = "responses", native: bool = True) -> str:
    tps = "tps" if native else "CASE WHEN duration_source <> 'native_log' THEN tps END"
    lead = f"{keys}, " if keys else ""
    tail = " GROUP BY ALL" if keys else ""
    return usage(
        f"""SELECT {lead}CAST(count(*) AS BIGINT) AS responses,
        CAST(count(*) FILTER (WHERE duration_source = 'native_log' AND t IS NOT NULL) AS BIGINT) AS native,
        CAST(count(t) AS BIGINT) AS tps_count, round(avg(t), 6) AS tps_avg, round(max(t), 6) AS tps_max,
        round(quantile_cont(t, 0.5), 6) AS tps_median, round(quantile_cont(t, 0.95), 6) AS tps_p95,
        CAST(count(f) AS BIGINT) AS latency_count, round(avg(f) / 1000, 9) AS latency_avg,
        round(max(f) / 1000, 9) AS latency_max, round(quantile_cont(f, 0.5) / 1000, 9) AS latency_median,
        round(quantile_cont(f, 0.95) / 1000, 9) AS latency_p95
        FROM (SELECT *, {tps} AS t, first_token_ms AS f FROM {source}){tail}"""
    )


def _leaders(where: str, period: str, unit: str) -> str:
    return usage(
        f"""SELECT period, '{unit}' AS unit, model, cost_cents, tokens,
        round(CAST(cost_cents AS DOUBLE) / total, 6) AS share
        FROM (SELECT *, rank() OVER (PARTITION BY period ORDER BY cost_cents DESC) AS rk,
                CAST(sum(cost_cents) OVER (PARTITION BY period) AS DOUBLE) AS total
              FROM (SELECT {period} AS period, model, {MEASURES} FROM daily WHERE {where} GROUP BY ALL))
        WHERE rk = 1 AND cost_cents > 0"""
    )


REVIEW_CTES = (
    USAGE.replace(
        "\nuniq AS (\n  SELECT * EXCLUDE (rn) FROM (\n    SELECT *,",
        """
emptied AS (
  SELECT * REPLACE (
    CASE WHEN e THEN 'Claude-review' ELSE model END AS model, CASE WHEN e THEN 0 ELSE cost_cents END AS cost_cents,
    CASE WHEN e THEN 'x' || request_id ELSE session_key END AS session_key,
    CASE WHEN e THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN e THEN 0 ELSE output_tokens END AS output_tokens,
    CASE WHEN e THEN 0 ELSE cache_read_tokens END AS cache_read_tokens,
    CASE WHEN e THEN 0 ELSE cache_creation_tokens END AS cache_creation_tokens)
  FROM (SELECT *, model = 'model-0' AND output_tokens = 7 AS e FROM effective)),
uniq AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *,""",
    ).replace("    FROM effective) WHERE rn = 1)", "    FROM emptied) WHERE rn = 1)")
    + """
hidden AS (
  SELECT host, app, session_key FROM sessions GROUP BY ALL
  HAVING sum(requests) = 1 AND sum(total_tokens) = 0 AND sum(cost_cents) = 0
    AND bool_and(regexp_matches(model, '^claude(-|$)', 'i'))),
visible AS (SELECT s.* FROM sessions s ANTI JOIN hidden h USING (host, app, session_key)),
"""
)


def review(tail: str) -> str:
    return "WITH " + REVIEW_CTES.rstrip().rstrip(",") + "\n" + tail


def _slot(hours: int, days: int, hour: str = "hour") -> str:
    if hours == 24:
        return "CAST(date AS VARCHAR)"
    start = f"lpad(CAST(CAST({hour} AS INT) // {hours} * {hours} AS VARCHAR), 2, '0') || ':00'"
    label = start if days == 1 else f"CAST(date AS VARCHAR) || 'T' || {start}"
    return f"CASE WHEN {hour} = 'Unknown hour' THEN 'Unknown hour' ELSE {label} END"


def _calendar(first: str, last: str, hours: int, days: int) -> str:
    start = "lpad(CAST(h AS VARCHAR), 2, '0') || ':00'"
    label = start if days == 1 else f"CAST(CAST(d AS DATE) AS VARCHAR) || 'T' || {start}"
    return f"""SELECT {label} AS slot, CAST(row_number() OVER (ORDER BY d, h) - 1 AS INT) AS slot_index
      FROM generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) AS a(d),
           generate_series(0, 23, {hours}) AS b(h)"""


def _buckets(where: str, hours: int, days: int, calendar: str | None) -> str:
    used = f"""used AS (SELECT {_slot(hours, days)} AS slot, model, {_b('sum(total_tokens)', 'tokens')},
      {_b('sum(cost_cents)', 'cost_cents')} FROM hourly WHERE {where} GROUP BY ALL),"""
    if calendar is None:
        return usage("SELECT slot, model, tokens, cost_cents FROM used", used)
    return usage(
        """SELECT slot, model, tokens, cost_cents FROM used UNION ALL
        SELECT slot, NULL, 0, 0 FROM cal WHERE slot NOT IN (SELECT slot FROM used)""",
        used + f"cal AS ({calendar}),",
    )


def _matrix(where: str, hours: int, days: int) -> str:
    if hours == 24:
        return f"""matrix AS (SELECT host, app, session_key, CAST(date AS VARCHAR) AS slot,
          {_b('sum(total_tokens)', 'tokens')} FROM sessions WHERE {where} GROUP BY ALL),"""
    return f"""matrix AS (SELECT host, app, session_key, {_slot(hours, days)} AS slot,
      CAST(sum(tokens) AS BIGINT) AS tokens FROM session_hours WHERE {where} GROUP BY ALL),"""


HEAT = """SELECT host, app, session_key, slot, tokens,
  round(CASE WHEN hi = lo THEN 0.5 ELSE CAST(tokens - lo AS DOUBLE) / (hi - lo) END, 6) AS heat
  FROM matrix, (SELECT min(tokens) AS lo, max(tokens) AS hi FROM matrix)"""

PROJECT_PARTS = " UNION ALL ".join(
    f"SELECT project_key, '{part}' AS part, {value} AS value, {TOTALS} FROM sessions WHERE project_key <> '' GROUP BY ALL"
    for part, value in (
        ("all", "NULL"), ("date", "CAST(date AS VARCHAR)"), ("model", "model"), ("session_key", "session_key"),
    )
)

ORACLES = {
    "daily_usage": usage("SELECT * FROM daily"),
    "hourly_usage": usage("SELECT * FROM hourly"),
    "local_hours": usage(
        f"""SELECT CAST(t AS DATE) AS date, lpad(CAST(hour(t) AS VARCHAR), 2, '0') AS hour,
        {_b('count(*)', 'requests')}, {_b('sum(fresh)', 'fresh_input_tokens')}, {_b('sum(output_tokens)', 'output_tokens')},
        {_b('sum(cache_read_tokens)', 'cache_read_tokens')}, {_b('sum(cache_creation_tokens)', 'cache_creation_tokens')},
        {_b('sum(fresh + output_tokens + cache_read_tokens + cache_creation_tokens)', 'total_tokens')},
        {_b('sum(cost_cents)', 'cost_cents')}
        FROM (SELECT * EXCLUDE (date, hour), make_timestamp((created_at + 9 * 3600) * 1000000) AS t FROM timed) GROUP BY ALL"""
    ),
    "by_model": usage(f"SELECT model, {MEASURES} FROM daily GROUP BY ALL"),
    "by_host_app": usage(
        f"""SELECT host, app, {_b('sum(total_tokens)', 'tokens')}, {_b('sum(requests)', 'requests')},
        min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY ALL"""
    ),
    "grand_total": usage(f"SELECT {MEASURES} FROM daily"),
    "headline": usage(f"SELECT {MEASURES}, CAST(count(DISTINCT model) AS BIGINT) AS models FROM daily WHERE {YEAR}"),
    "date_model_totals": usage(f"SELECT date, model, {MEASURES} FROM daily GROUP BY ALL"),
    "effective_requests": ledger("SELECT host, app_type, request_id, created_at, data_source FROM effective"),
    "cross_host_unique": ledger("SELECT host, app_type, request_id, created_at, model, output_tokens FROM uniq"),
    "rollup_overlap": ledger(
        """SELECT date, app_type, model, host, request_count, input_tokens
        FROM (SELECT *, lag(host) OVER (PARTITION BY date, app_type, model, request_count, input_tokens, output_tokens,
          cache_read_tokens, cache_creation_tokens, input_token_semantics ORDER BY host_order, provider_id) AS previous
          FROM rollups) WHERE previous <> host"""
    ),
    "monthly_leaders": _leaders("true", "strftime(date, '%Y-%m')", "month"),
    "period_leaders_day": _leaders(DAY, "'1998-03-04'", "day"),
    "period_leaders_week": _leaders(WEEK, "'1998-03-02 → 1998-03-08'", "week"),
    "period_leaders_range": _leaders(YEAR, "'1998-01-01 → 1998-12-31'", "range"),
    "chosen_models": usage(
        f"SELECT model, {MEASURES} FROM daily WHERE {YEAR} AND model IN ('model-1', 'model-2', 'unknown') GROUP BY ALL"
    ),
    "model_search": usage(f"SELECT DISTINCT model FROM daily WHERE {YEAR} AND lower(model) LIKE '%model-%'"),
    "preset_totals": usage(
        f"""SELECT preset, {MEASURES} FROM daily JOIN presets ON date BETWEEN first AND last GROUP BY ALL""",
        """a AS (SELECT max(date) AS d, CAST(date_trunc('month', max(date)) AS DATE) AS m,
             CAST(date_trunc('year', max(date)) AS DATE) AS y FROM daily),
        presets AS (
          SELECT 'today' AS preset, d AS first, d AS last FROM a
          UNION ALL SELECT 'past-seven-days', d - 6, d FROM a
          UNION ALL SELECT 'this-month', m, d FROM a
          UNION ALL SELECT 'last-month', CAST(m - INTERVAL 1 MONTH AS DATE), m - 1 FROM a
          UNION ALL SELECT 'this-year', y, d FROM a
          UNION ALL SELECT 'last-year', CAST(y - INTERVAL 1 YEAR AS DATE), y - 1 FROM a),""",
    ),
    "response_fact": usage(
        """SELECT date, hour, host, app, model, output_tokens, round(duration_ms, 6) AS duration_ms, duration_source,
        round(tps, 6) AS tps, round(first_token_ms, 6) AS first_token_ms FROM responses"""
    ),
    "request_tps": usage(
        """SELECT date, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M:%S') AS local_datetime, host, app,
        coalesce(session_provider, provider_name, CASE WHEN starts_with(r.provider_id, '_')
          THEN 'Session / provider unknown' ELSE 'Unresolved provider' END) AS provider, model,
        created_at, output_tokens, recorded_ms AS duration_ms,
        CASE WHEN duration_ms > 0 THEN 'duration_ms' ELSE 'latency_ms' END AS duration_source,
        round(recorded_tps, 6) AS tps
        FROM rated r LEFT JOIN provs ON provs.provider_id = r.provider_id WHERE recorded_tps IS NOT NULL"""
    ),
    "response_stats_all": _stats(""),
    "response_stats_recorded": _stats("", native=False),
    "response_stats_date": _stats("CAST(date AS VARCHAR) AS key"),
    "response_stats_hour": _stats("hour AS key"),
    "response_stats_weekday": _stats("CAST(isodow(date) - 1 AS VARCHAR) AS key"),
    "response_stats_weekday_hour": _stats("CAST(isodow(date) - 1 AS VARCHAR) || '/' || hour AS key"),
    "response_stats_model": _stats("model AS key"),
    "speed_windows": _stats(
        "CAST(window_days AS INT) AS window_days",
        """(SELECT r.*, w.window_days FROM responses r JOIN (VALUES (7), (30), (0)) w(window_days)
        ON date <= DATE '1998-06-30' AND (window_days = 0 OR date >= DATE '1998-06-30' - (window_days - 1)))""",
    ),
    "session_daily": usage(
        """SELECT * REPLACE (round(tps_sum, 6) AS tps_sum, round(tps_max, 6) AS tps_max,
        round(native_tps_sum, 6) AS native_tps_sum, round(native_tps_max, 6) AS native_tps_max) FROM sessions"""
    ),
    "session_hours": usage("SELECT * FROM session_hours"),
    "session_summary": usage(
        f"""SELECT host, app, session_key, max(session_title) AS title, min(date) AS first_date, max(date) AS last_date,
        string_agg(DISTINCT model, ',' ORDER BY model) AS models, {TOTALS} FROM native GROUP BY ALL"""
    ),
    "session_by_model": usage(f"SELECT host, app, session_key, model, {TOTALS} FROM sessions GROUP BY ALL"),
    "session_by_date": usage(f"SELECT host, app, session_key, date, {TOTALS} FROM sessions GROUP BY ALL"),
    "component_share": usage(
        """SELECT host, app, session_key, component, tokens,
        round(CASE WHEN total = 0 THEN 0 ELSE 100.0::DOUBLE * tokens / total END, 6) AS share
        FROM (SELECT host, app, session_key, CAST(sum(total_tokens) AS BIGINT) AS total,
          CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
          CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens FROM sessions GROUP BY ALL)
        UNPIVOT (tokens FOR component IN (fresh_input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens))"""
    ),
    "visible_sessions": review(
        f"SELECT host, app, session_key, {_b('sum(requests)', 'requests')} FROM visible GROUP BY ALL"
    ),
    "available_models": review(
        f"""SELECT model FROM (SELECT model, sum(total_tokens) AS t, sum(cost_cents) AS c, sum(requests) AS n
          FROM daily WHERE {YEAR} GROUP BY ALL) u
        LEFT JOIN (SELECT model, sum(requests) AS recorded FROM sessions WHERE {YEAR} GROUP BY ALL) USING (model)
        WHERE NOT (regexp_matches(model, '^claude(-|$)', 'i') AND t = 0 AND c = 0 AND n > 0
          AND coalesce(recorded = n, false) AND model NOT IN (SELECT model FROM visible WHERE {YEAR}))"""
    ),
    "coverage": review(
        """SELECT all_tokens, session_tokens, session_requests, project_tokens, hidden_requests,
        greatest(0, all_tokens - session_tokens) AS tokens_without_session,
        greatest(0, all_requests - hidden_requests - session_requests) AS requests_without_session,
        greatest(0, all_tokens - project_tokens) AS tokens_without_project
        FROM (SELECT (SELECT CAST(sum(total_tokens) AS BIGINT) FROM daily) AS all_tokens,
          (SELECT CAST(sum(requests) AS BIGINT) FROM daily) AS all_requests,
          (SELECT CAST(sum(total_tokens) AS BIGINT) FROM visible) AS session_tokens,
          (SELECT CAST(sum(requests) AS BIGINT) FROM visible) AS session_requests,
          (SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) FROM visible WHERE project_key <> '') AS project_tokens,
          (SELECT CAST(sum(requests) AS BIGINT) FROM sessions) - (SELECT CAST(sum(requests) AS BIGINT) FROM visible)
            AS hidden_requests)"""
    ),
    "project_summary": usage(
        f"""SELECT project_name, project_key, {TOTALS}, min(date) AS first_date, max(date) AS last_date,
        string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, string_agg(DISTINCT app, ',' ORDER BY app) AS apps,
        string_agg(DISTINCT model, ',' ORDER BY model) AS models,
        CAST(count(DISTINCT host || '/' || app || '/' || session_key) AS BIGINT) AS sessions
        FROM native WHERE project_key <> '' GROUP BY project_name, project_key"""
    ),
    "project_detail": usage(PROJECT_PARTS),
    "project_identity": ledger(
        """SELECT project_key, project_name, CAST(count(*) AS BIGINT) AS requests FROM requests
        WHERE project_key IS NOT NULL GROUP BY ALL"""
    ),
    "top_projects": usage(
        f"""SELECT project_name, project_key, {_b('sum(total_tokens)', 'total_tokens')}, {_b('sum(requests)', 'requests')}
        FROM sessions WHERE project_key <> '' GROUP BY ALL ORDER BY total_tokens DESC, project_name, project_key LIMIT 10"""
    ),
    "time_buckets_day": _buckets(DAY, 1, 1, _calendar("1998-03-04", "1998-03-04", 1, 1)),
    "time_buckets_fortnight": _buckets(FORTNIGHT, 12, 14, _calendar("1998-03-02", "1998-03-15", 12, 14)),
    "time_buckets_year": _buckets(YEAR, 24, 365, None),
    "stack_segments": usage(
        f"""SELECT slot, model, tokens, segment_end - tokens AS segment_base, segment_end FROM (
        SELECT *, CAST(sum(tokens) OVER (PARTITION BY slot ORDER BY tokens, model
          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_end FROM (
        SELECT CAST(date AS VARCHAR) AS slot, model, {_b('sum(total_tokens)', 'tokens')} FROM hourly GROUP BY ALL)
        WHERE tokens > 0)"""
    ),
    "line_breaks": usage(
        f"""SELECT CAST(date AS VARCHAR) AS slot, cost_cents,
        coalesce(date - lag(date) OVER (ORDER BY date) <> 1, true) AS line_break
        FROM (SELECT date, {_b('sum(cost_cents)', 'cost_cents')} FROM daily WHERE model = 'unknown' GROUP BY ALL)"""
    ),
    "session_matrix_fortnight": usage(HEAT, _matrix(FORTNIGHT, 12, 14)),
    "session_matrix_all": usage(HEAT, _matrix("true", 24, 0)),
    "temporal_runs": usage(
        """SELECT host, app, session_key, min(slot_index) AS first_index, max(slot_index) AS last_index,
        CAST(count(*) AS BIGINT) AS slots, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM (SELECT *, slot_index - row_number() OVER (PARTITION BY host, app, session_key ORDER BY slot_index) AS island
              FROM matrix JOIN cal USING (slot))
        GROUP BY host, app, session_key, island""",
        _matrix(FORTNIGHT, 12, 14) + f"cal AS ({_calendar('1998-03-02', '1998-03-15', 12, 14)}),",
    ),
    "calendar_grid": usage(
        """SELECT date, week, weekday, in_range, coalesce(responses, 0) AS responses
        FROM (SELECT CAST(d AS DATE) AS date, CAST((CAST(d AS DATE) - DATE '1997-12-29') // 7 AS INT) AS week,
                CAST(isodow(d) - 1 AS INT) AS weekday, CAST(d AS DATE) >= DATE '1998-01-01' AS in_range
              FROM generate_series(DATE '1997-12-29', DATE '1998-12-31', INTERVAL 1 DAY) AS g(d))
        LEFT JOIN (SELECT date, CAST(count(*) AS BIGINT) AS responses FROM responses GROUP BY ALL) USING (date)"""
    ),
    "table_sort": usage(
        """SELECT model AS key, round(avg(tps), 6) AS tps_avg, CAST(count(*) AS BIGINT) AS responses
        FROM responses GROUP BY ALL ORDER BY tps_avg DESC NULLS LAST, key LIMIT 50"""
    ),
    "text_sort": usage(
        """SELECT host, app, session_key, title FROM (
          SELECT host, app, session_key, max(session_title) AS title FROM sessions GROUP BY ALL)
        ORDER BY title = '', CASE WHEN title = '' THEN 0 ELSE CAST(substr(title, 7) AS BIGINT) END, session_key, host, app
        LIMIT 50 OFFSET 50"""
    ),
    "source_audit": usage(
        """SELECT host, 'UTC' AS host_timezone, raw_requests, raw_requests - kept AS proxy_session_duplicates,
        kept - coalesce(u, 0) AS cross_host_duplicates, coalesce(timed_requests, 0) AS timed_requests, zero_token_requests, latest_request, rollup_rows,
        rollup_first, rollup_last
        FROM (SELECT host, CAST(count(*) AS BIGINT) AS raw_requests, max(created_at) AS latest_request,
          CAST(count(*) FILTER (WHERE input_tokens = 0 AND output_tokens = 0 AND cache_read_tokens = 0
            AND cache_creation_tokens = 0) AS BIGINT) AS zero_token_requests FROM requests GROUP BY ALL)
        JOIN (SELECT host, CAST(count(*) AS BIGINT) AS kept FROM effective GROUP BY ALL) USING (host)
        LEFT JOIN (SELECT host, CAST(count(*) AS BIGINT) AS u, CAST(count(recorded_tps) AS BIGINT) AS timed_requests
              FROM rated GROUP BY ALL) USING (host)
        JOIN (SELECT host, CAST(count(*) AS BIGINT) AS rollup_rows, min(date) AS rollup_first, max(date) AS rollup_last
              FROM rollups GROUP BY ALL) USING (host)"""
    ),
    "status_counts": ledger("SELECT host, status_code, CAST(count(*) AS BIGINT) AS requests FROM requests GROUP BY ALL"),
    "covered_dates": ledger(
        """SELECT DISTINCT host, date FROM (
        SELECT host, CAST(make_timestamp(created_at * 1000000) AS DATE) AS date FROM requests
        UNION ALL SELECT host, date FROM rollups)"""
    ),
}
