"""The telemetry queries as plain SQL, for checking."""

from __future__ import annotations

from usagelens.plans.report_sql import BASE

LAST, NOW = 2844432, 2842000

CTES = """
ev AS (SELECT *, epoch_us(ts) // 600000 AS ms FROM events),
tele AS (
  SELECT *, CAST(sm AS DOUBLE) / 1000 AS stamp, CAST(sm AS DOUBLE) / 1000 + event_id % 8 AS received_at,
    CASE WHEN event_id % 101 = 0 OR (event_type = 'click' AND user_id % 3 = 0 AND event_id % 5 = 0) THEN NULL ELSE 'u' || user_id END AS session_key,
    CASE WHEN event_id % 101 <> 0 AND user_id % 3 = 0 AND {IDS} THEN 'r' || user_id || '-' || (sm // 60000) END AS response_key,
    CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS done,
    CASE WHEN event_type = 'click' THEN 'request' ELSE 'response' END AS start_origin,
    CASE WHEN event_type = 'purchase' THEN CAST(round(value * 10) AS BIGINT) END AS output_tokens,
    'prov-' || (user_id % 4) AS provider, 'model-' || (user_id % 9) AS model
  FROM (SELECT *, ms * CASE WHEN user_id % 10 = 3 THEN 40 ELSE 1 END AS sm FROM ev)),
whole AS (
  SELECT response_key FROM tele WHERE response_key IS NOT NULL GROUP BY 1 HAVING min(done) = 0 AND max(done) = 1),
loose AS (SELECT DISTINCT session_key FROM tele WHERE response_key IS NULL AND session_key IS NOT NULL),
keyed AS (
  SELECT t.*, CASE WHEN w.response_key IS NOT NULL THEN 'r:' || t.response_key WHEN l.session_key IS NOT NULL THEN 's:' || t.session_key
    ELSE 'r:' || t.response_key END AS pair_key
  FROM tele t LEFT JOIN whole w ON w.response_key = t.response_key LEFT JOIN loose l ON l.session_key = t.session_key
  WHERE t.session_key IS NOT NULL OR t.response_key IS NOT NULL),
once AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY pair_key, done, CASE WHEN done = 1 AND response_key IS NOT NULL THEN NULL ELSE stamp END,
      CASE WHEN done = 1 AND response_key IS NULL THEN coalesce(output_tokens, -1) END, CASE WHEN done = 1 THEN response_key END
    ORDER BY stamp, start_origin, received_at, output_tokens NULLS FIRST) AS rn FROM keyed) WHERE rn = 1),
paused AS (
  SELECT *, CASE WHEN stamp - lag(stamp) OVER w <= 1800 THEN 0 ELSE 1 END AS pause FROM once
  WINDOW w AS (PARTITION BY pair_key ORDER BY stamp, done, coalesce(output_tokens, -1))),
grouped AS (
  SELECT *, sum(done) OVER w - done AS g, sum(pause) OVER w AS p FROM paused
  WINDOW w AS (PARTITION BY pair_key ORDER BY stamp, done, coalesce(output_tokens, -1) ROWS UNBOUNDED PRECEDING)),
groups AS (
  SELECT pair_key, min({{'stamp': stamp, 'origin': start_origin, 'session': session_key, 'provider': provider, 'model': model,
      'received': received_at, 'response': response_key}}) FILTER (WHERE done = 0) AS s,
    max({{'stamp': stamp, 'tokens': output_tokens, 'session': session_key, 'response': response_key, 'provider': provider,
      'model': model, 'received': received_at}}) FILTER (WHERE done = 1) AS c,
    count(*) FILTER (WHERE done = 0) AS starts, count(*) FILTER (WHERE done = 0 AND start_origin = 'request') AS requests
  FROM grouped GROUP BY pair_key, g, p),
paired AS (
  SELECT coalesce(c.session, s.session) AS session_key, coalesce(c.response, s.response) AS response_key,
    coalesce(c.provider, s.provider) AS provider, coalesce(c.model, s.model) AS model, c.tokens AS output_tokens,
    CASE WHEN status IN ('measured', 'late') THEN s.stamp END AS start, coalesce(c.stamp, s.stamp) AS "end", status
  FROM (SELECT *, CASE
      WHEN c IS NULL THEN CASE WHEN single THEN 'awaiting_usage' ELSE 'missing_timing' END
      WHEN c.tokens IS NULL THEN 'awaiting_usage' WHEN c.tokens = 0 THEN 'empty'
      WHEN NOT single OR c.stamp <= s.stamp OR c.stamp - s.stamp > 1800 OR coalesce(s.response <> c.response, false) THEN 'missing_timing'
      WHEN s.session IS DISTINCT FROM c.session THEN 'ambiguous_identity'
      WHEN c.stamp < c.received - 5 THEN 'late' ELSE 'measured' END AS status
    FROM (SELECT *, starts = 1 OR (starts > 1 AND s.origin = 'request' AND requests = 1) AS single FROM groups))
  UNION ALL SELECT NULL, NULL, provider, model, output_tokens, NULL, stamp, 'ambiguous_identity' FROM tele
  WHERE session_key IS NULL AND response_key IS NULL),
samples AS (
  SELECT 'src' || ((user_id + copy) % 3) AS source, (user_id + copy) % 3 AS source_order, 'e' || event_id AS event_key,
    CASE WHEN user_id % 17 = 0 OR copy = 2 THEN NULL ELSE 's' || (user_id % 60) END AS session_key,
    CASE WHEN user_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS runtime, 'prov-' || (user_id % 4) AS provider,
    'model-' || copy AS model,
    CAST(round(value * 10) AS BIGINT) + 5 + CASE WHEN copy = 1 AND event_id % 5 = 0 THEN 1 ELSE 0 END AS output_tokens,
    CAST(ms AS DOUBLE) / 1000 - 1 - event_id % 9 AS start, CAST(ms AS DOUBLE) / 1000 AS "end",
    CASE WHEN user_id % 2 = 0 AND user_id % 60 < 20 AND event_id % 4 = 0 THEN 'codex_otel'
         WHEN copy = 1 THEN 'proxy_elapsed' ELSE 'native_log' END AS basis,
    CAST(ms AS DOUBLE) / 1000 + 0.25 AS sampled_at, CAST(ms AS DOUBLE) / 1000 + 0.5 + copy AS received_at
  FROM (SELECT *, unnest(CASE WHEN event_id % 6 = 0 THEN [0, 1, 2] WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy
        FROM ev WHERE event_type IN ('purchase', 'click'))),
kept AS (
  SELECT * FROM samples WHERE NOT coalesce(runtime = 'codex' AND basis <> 'codex_otel' AND session_key IN (
    SELECT session_key FROM samples WHERE runtime = 'codex' AND basis = 'codex_otel' AND session_key IS NOT NULL), false)),
canon AS (
  SELECT * EXCLUDE (rn, lo, hi, sl, sh), lo <> hi OR coalesce(sl <> sh, false) AS conflict FROM (
    SELECT *, min(output_tokens) OVER w AS lo, max(output_tokens) OVER w AS hi, min(session_key) OVER w AS sl,
      max(session_key) OVER w AS sh, row_number() OVER (PARTITION BY event_key ORDER BY
        CASE WHEN basis = 'codex_otel' THEN 0 WHEN basis LIKE '%proxy%' THEN 2 ELSE 1 END, session_key IS NULL, source_order) AS rn
    FROM kept WINDOW w AS (PARTITION BY event_key)) WHERE rn = 1),
cells AS (
  SELECT *, output_tokens * (least(b, second) - greatest(a, second - 5)) / (b - a) / 5 AS tps FROM (
    SELECT *, unnest(range(CAST(floor(a) AS BIGINT) + 1, CAST(ceil(b + 5) AS BIGINT))) AS second FROM (
      SELECT *, start + (received_at - sampled_at) AS a, "end" + (received_at - sampled_at) AS b
      FROM canon WHERE NOT conflict))
  WHERE least(b, second) - greatest(a, second - 5) > 0),
rates AS (
  SELECT second, runtime, coalesce(session_key, 'event:' || event_key) AS contributor, session_key, sum(tps) AS tps
  FROM cells GROUP BY ALL),
arrivals AS (SELECT event_key, output_tokens, min(received_at) AS received_at FROM kept GROUP BY ALL),
deltas AS (
  SELECT a.event_key, c.session_key, c.runtime, a.received_at, a.delta, c.conflict AS excluded FROM (
    SELECT *, output_tokens - coalesce(max(output_tokens) OVER (PARTITION BY event_key ORDER BY received_at, output_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta FROM arrivals) a JOIN canon c USING (event_key)
  WHERE delta > 0),
received AS (
  SELECT CAST(floor(received_at) AS BIGINT) AS second,
    CAST(coalesce(sum(delta) FILTER (WHERE NOT excluded), 0) AS BIGINT) AS output_tokens, bool_or(excluded) AS excluded
  FROM deltas GROUP BY 1),
ticks AS (
  SELECT tick, previous, status FROM (
    SELECT CAST(ms AS DOUBLE) / 1000 AS tick, CASE WHEN event_type = 'signup' THEN 'partial' ELSE 'complete' END AS status,
      lag(CAST(ms AS DOUBLE) / 1000) OVER (ORDER BY ms) AS previous FROM ev)
  WHERE tick - previous <= 2.5),
watched AS (
  SELECT second, bool_or(status <> 'complete') AS partial FROM (
    SELECT status, unnest(range(CAST(floor(previous) AS BIGINT), CAST(floor(tick) AS BIGINT))) AS second FROM ticks)
  GROUP BY 1),
"""


def telemetry(tail: str, ctes: str = "", ids: str = "true") -> str:
    """``tail`` over the shared tables; ``ids`` says which events keep their response id."""
    shared = CTES.replace("{IDS}", ids).replace("{{", "{").replace("}}", "}")
    return "WITH " + (shared + ctes).rstrip().rstrip(",") + "\n" + tail


KIND = "CASE event_type WHEN 'view' THEN 'response.created' WHEN 'purchase' THEN 'response.completed' ELSE 'response.created' END"

ORACLES = {
    "otlp_flatten": telemetry(
        f"""SELECT CASE WHEN user_id % 13 <> 0 THEN sha256('["codex","u' || user_id || '"]') END AS session_key,
        CAST(NULL AS VARCHAR) AS response_key, {KIND} AS kind,
        CASE WHEN event_type = 'click' THEN 'request' ELSE 'response' END AS start_origin,
        round(CASE WHEN event_type = 'click' THEN CAST(ms AS DOUBLE) / 1000 - CAST(event_id % 900 AS DOUBLE) / 1000
          ELSE CAST(ms AS DOUBLE) / 1000 END, 6) AS stamp,
        CASE WHEN event_type = 'purchase' THEN CAST(round(value * 10) AS BIGINT) END AS output_tokens,
        'm' || (user_id % 9) AS model
        FROM ev WHERE (event_type IN ('view', 'purchase') AND NOT (user_id % 13 = 0 AND user_id % 2 = 1))
          OR (event_type = 'click' AND event_id % 10 <> 3 AND user_id % 13 <> 0)"""
    ),
    "otlp_counts": telemetry(
        """SELECT reason, CAST(count(*) AS BIGINT) AS records,
        CAST(count(*) FILTER (WHERE reason = 'event' AND event_type = 'view') AS BIGINT) AS created_events,
        CAST(count(*) FILTER (WHERE reason = 'event' AND event_type = 'click') AS BIGINT) AS websocket_request_events,
        CAST(count(*) FILTER (WHERE reason = 'event' AND event_type = 'purchase') AS BIGINT) AS completed_events,
        CAST(count(*) FILTER (WHERE reason = 'event' AND event_type = 'purchase') AS BIGINT) AS output_counts_received
        FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'other'
          WHEN user_id % 13 = 0 AND (event_type = 'click' OR user_id % 2 = 1) THEN 'missing_identity'
          WHEN event_type = 'click' AND event_id % 10 = 3 THEN 'failed'
          WHEN event_type = 'error' THEN 'invalid' ELSE 'event' END AS reason FROM ev) GROUP BY 1"""
    ),
    "otlp_pairs": telemetry(
        """SELECT session_key, response_key, model, output_tokens, round(start, 6) AS start, round("end", 6) AS "end", status
        FROM paired"""
    ),
    "otlp_samples": telemetry(
        """SELECT session_key, 'codex_otel' AS basis, CAST(count(*) AS BIGINT) AS responses, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
        FROM paired WHERE status = 'measured' GROUP BY 1"""
    ),
    "late_output": telemetry(
        """SELECT status, CAST(count(*) AS BIGINT) AS responses, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
        FROM paired GROUP BY 1"""
    ),
    "mixed_pairs": telemetry(
        """SELECT status, CAST(count(*) AS BIGINT) AS responses, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
        FROM paired GROUP BY 1""",
        ids="event_id % 2 = 1",
    ),
    "live_rate": telemetry(
        """SELECT second, round(sum(tps), 6) AS total_tps, CAST(count(session_key) AS BIGINT) AS contributing_sessions,
        bool_or(session_key IS NULL) AS unattributed,
        round(CASE WHEN NOT bool_or(session_key IS NULL) THEN sum(tps) / count(session_key) END, 6) AS average_tps
        FROM rates GROUP BY 1"""
    ),
    "live_sessions": telemetry("SELECT second, runtime, contributor, session_key, round(tps, 6) AS tps FROM rates"),
    "busiest_sessions": telemetry(
        """SELECT second, runtime, contributor, session_key, round(tps, 6) AS tps,
        CAST(row_number() OVER (PARTITION BY second ORDER BY round(tps, 6) DESC, runtime, contributor) AS INT) AS place FROM rates"""
    ),
    "canonical_responses": telemetry(
        "SELECT event_key, source, session_key, basis, model, output_tokens, conflict FROM canon"
    ),
    "receipt_deltas": telemetry(
        "SELECT event_key, session_key, runtime, round(received_at, 6) AS received_at, delta, excluded FROM deltas"
    ),
    "receipt_seconds": telemetry("SELECT second, output_tokens, excluded FROM received"),
    "receipt_average": telemetry(
        """SELECT second, CAST(sum(delta) AS BIGINT) AS output_tokens, round(sum(delta) / 300.0::DOUBLE, 6) AS average_tps FROM (
        SELECT delta, unnest(range(CAST(ceil(received_at) AS BIGINT), CAST(floor(received_at) AS BIGINT) + 301)) AS second
        FROM deltas WHERE NOT excluded) GROUP BY 1"""
    ),
    "finished_bins": telemetry(
        """SELECT second, CASE WHEN coalesce(output_tokens, 0) > 0 OR w.second IS NOT NULL THEN coalesce(output_tokens, 0) END
        AS output_tokens, w.second IS NOT NULL AS observed, coalesce(partial, true) OR coalesce(excluded, false) AS partial
        FROM watched w FULL JOIN received r USING (second)"""
    ),
    "source_status": telemetry(
        f"""SELECT source, round(greatest(0, {LAST} - r), 6) AS age_seconds,
        CASE WHEN {LAST} - r >= 3 THEN 'stale' ELSE 'fresh' END AS status,
        {LAST} - r < 3 AND c <> 'model-2' AS complete
        FROM (SELECT source, max(received_at) AS r, arg_max(model, received_at) AS c FROM samples GROUP BY 1)"""
    ),
    "activity_gaps": telemetry(
        f"""SELECT session_key, round(stamp, 6) AS stamp, 'awaiting_usage' AS status FROM (
          SELECT 's' || (user_id % 60) AS session_key, max(CAST(ms AS DOUBLE) / 1000) AS stamp FROM ev
          WHERE event_type <> 'signup' AND CAST(ms AS DOUBLE) / 1000 BETWEEN {NOW} - 120 AND {NOW} GROUP BY 1) a
        WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.session_key = a.session_key AND runtime = 'codex'
            AND basis IN ('native_log', 'codex_otel') AND s."end" BETWEEN {NOW} - 5 AND {NOW} AND s."end" >= a.stamp)
          AND NOT EXISTS (SELECT 1 FROM ev WHERE event_type = 'signup' AND 's' || (user_id % 60) = a.session_key
            AND CAST(ms AS DOUBLE) / 1000 BETWEEN a.stamp AND {NOW})"""
    ),
    "proxy_link": "WITH " + BASE + """
px AS (
  SELECT request_id, session_id, CASE WHEN app_type LIKE 'claude%' THEN 'claude' ELSE app_type END AS runtime,
    coalesce(provider_name, 'Unresolved provider') AS provider, output_tokens, CAST(created_at AS DOUBLE) AS e, host,
    coalesce(CASE WHEN duration_ms > 0 THEN duration_ms END, CASE WHEN latency_ms > 0 THEN latency_ms END) AS d
  FROM ledger r LEFT JOIN provs p USING (provider_id)
  WHERE coalesce(data_source, 'proxy') = 'proxy' AND status_code BETWEEN 200 AND 299 AND output_tokens > 0),
one AS (
  SELECT request_id, runtime, starts_with(request_id, 'session:') AND runtime = 'claude' AS native,
    max(output_tokens) AS output_tokens, max(provider) AS provider, max(d) AS d, max(session_id) AS session_id FROM px GROUP BY 1, 2, 3),
known AS (SELECT DISTINCT session_id FROM one WHERE native AND session_id IS NOT NULL)
SELECT runtime, provider, basis, status, CAST(count(*) AS BIGINT) AS responses, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(count(session) AS BIGINT) AS with_session
FROM (SELECT *, CASE WHEN native AND output_tokens % 2 = 0 THEN 'native_log' ELSE 'proxy_elapsed' END AS basis,
    CASE WHEN native OR (runtime = 'claude' AND session_id IN (SELECT session_id FROM known)) THEN session_id END AS session,
    CASE WHEN (native AND output_tokens % 2 = 0) OR d IS NOT NULL THEN 'measured' ELSE 'missing_timing' END AS status
  FROM one WHERE runtime <> 'codex') GROUP BY ALL""",
    "pending_sessions": telemetry(
        """SELECT 'codex' AS runtime, session_key, max(provider) AS provider, max(model) AS model, status FROM paired
        WHERE status IN ('awaiting_usage', 'missing_timing', 'ambiguous_identity') GROUP BY session_key, status"""
    ),
    "broken_samples": telemetry(
        """SELECT 'output_tokens' AS rule, CAST(count(*) AS BIGINT) AS rows FROM samples WHERE model = 'model-2'
        UNION ALL SELECT 'end', CAST(count(*) AS BIGINT) FROM samples WHERE provider = 'prov-3'"""
    ),
}
