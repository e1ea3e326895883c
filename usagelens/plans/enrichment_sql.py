"""The enrichment queries as plain SQL, for checking."""

from __future__ import annotations

from usagelens.plans.report_sql import ledger

EVIDENCE = """
ord AS (SELECT o_orderkey AS v, o_orderkey % 500 AS n, o_orderkey % 701 AS c FROM orders),
thr AS (
  SELECT * EXCLUDE (rn) FROM (SELECT 's' || n AS id, CASE WHEN n % 4 = 0 THEN NULL ELSE 'Thread ' || n END AS name,
    CASE WHEN n % 9 = 1 THEN 's' || ((n + 3) % 510) END AS parent_id,
    row_number() OVER (PARTITION BY n ORDER BY v DESC) AS rn FROM ord) WHERE rn = 1),
own AS (SELECT id, parent_id, coalesce(name,
    CASE WHEN CAST(substr(id, 2) AS INT) % 6 = 0 THEN 'Index ' || substr(id, 2) END) AS own_title FROM thr),
titles AS (
  SELECT o.id AS session_id, CASE WHEN o.parent_id IS NOT NULL
    THEN 'Subagent of: ' || coalesce(p.own_title, 'Parent title unavailable') ELSE o.own_title END AS title
  FROM own o LEFT JOIN own p ON p.id = o.parent_id
  WHERE o.parent_id IS NOT NULL OR o.own_title IS NOT NULL),
talk AS (SELECT DISTINCT 'c' || c AS session_id, CASE WHEN c % 7 = 0 THEN NULL ELSE 'Talk ' || (c // 3) END AS title FROM ord),
thread_dir AS (
  SELECT 's' || n AS session_id, min(p) AS p, count(DISTINCT p) AS np FROM (
    SELECT n, n % 12 + CASE WHEN n % 10 = 3 AND v % 1000 >= 500 THEN 1 ELSE 0 END AS p FROM ord) GROUP BY 1),
talk_dir AS (
  SELECT 'c' || c AS session_id, min(p) AS p, count(DISTINCT p) AS np FROM (
    SELECT c, c // 5 + CASE WHEN c % 11 = 0 AND v % 2 = 0 THEN 1 ELSE 0 END AS p FROM ord) GROUP BY 1),
msg AS (
  SELECT 'session:m' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
    || '-' || (CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS request_id,
    unnest(CASE WHEN l_partkey % 6 = 0 THEN ['c' || (l_orderkey % 700), 'c' || (l_orderkey % 700 + 1)]
      ELSE ['c' || (l_orderkey % 700)] END) AS session_id
  FROM lineitem WHERE l_suppkey % 4 = 1 AND l_partkey % 3 = 0),
ev AS (
  SELECT request_id, CASE WHEN count(DISTINCT m.session_id) = 1 THEN min(m.session_id) END AS linked,
    CASE WHEN count(DISTINCT m.session_id) > 1 AND count(DISTINCT title) = 1
      AND count(*) FILTER (WHERE title IS NULL) = 0 THEN min(title) END AS message_title,
    CASE WHEN count(DISTINCT d.p) = 1 AND count(*) FILTER (WHERE d.p IS NULL OR np > 1) = 0 THEN min(d.p) END AS mp
  FROM (SELECT DISTINCT * FROM msg) m LEFT JOIN talk t USING (session_id) LEFT JOIN talk_dir d USING (session_id)
  GROUP BY 1),
linked AS (
  SELECT r.* REPLACE (coalesce(linked, session_id) AS session_id),
    CASE WHEN linked IS NOT NULL AND linked IS DISTINCT FROM session_id THEN 'linked'
         WHEN e.request_id IS NOT NULL AND linked IS NULL AND message_title IS NOT NULL THEN 'same_title'
         WHEN e.request_id IS NOT NULL AND linked IS NULL THEN 'ambiguous' END AS link,
    message_title, e.request_id IS NOT NULL AS in_messages, mp
  FROM ledger r LEFT JOIN ev e USING (request_id)),
attached AS (
  SELECT l.* EXCLUDE (mp),
    coalesce(message_title, CASE WHEN app_type = 'codex' THEN t.title WHEN app_type LIKE 'claude%' THEN k.title END) AS session_title,
    CASE WHEN in_messages THEN sha256('/work/P' || mp)
         WHEN app_type = 'codex' AND td.np = 1 THEN sha256('["dropbox",["P' || td.p || '"]]')
         WHEN app_type LIKE 'claude%' AND kd.np = 1 THEN sha256('/work/P' || kd.p) END AS project_key,
    CASE WHEN in_messages THEN 'P' || mp
         WHEN app_type = 'codex' AND td.np = 1 THEN 'P' || td.p
         WHEN app_type LIKE 'claude%' AND kd.np = 1 THEN 'P' || kd.p END AS project_name
  FROM linked l LEFT JOIN titles t ON t.session_id = l.session_id LEFT JOIN talk k ON k.session_id = l.session_id
    LEFT JOIN thread_dir td ON td.session_id = l.session_id LEFT JOIN talk_dir kd ON kd.session_id = l.session_id),
hdr AS (
  SELECT DISTINCT 's' || n AS session_id, CASE WHEN n % 4 = 0 THEN NULL ELSE 'prov-' || (n % 7) END AS provider,
    CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 < 3 THEN sha256('["dropbox",["P' || (n % 12) || '"]]')
         ELSE sha256('/srv/P' || (n % 12)) END AS hkey,
    CASE WHEN n % 5 > 0 THEN 'P' || (n % 12) END AS hname FROM ord),
enriched AS (
  SELECT a.* REPLACE (
    CASE WHEN hkey IS NULL THEN project_name WHEN project_key IS NULL OR project_key = hkey THEN hname END AS project_name,
    CASE WHEN hkey IS NULL THEN project_key WHEN project_key IS NULL OR project_key = hkey THEN hkey END AS project_key),
    CASE WHEN data_source = 'codex_session' THEN provider END AS session_provider
  FROM attached a LEFT JOIN hdr h USING (session_id)),
conv AS (
  SELECT 'conv' || conv_id AS session_id, turn, role, length(text) AS chars,
    conv_id * 86400 + turn * 60 + length(text) % 50 AS second
  FROM conversations WHERE role IN ('user', 'assistant')),
conv_before AS (
  SELECT *, lag(role) OVER w AS previous, lag(second) OVER w AS asked FROM conv
  WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
timing AS (
  SELECT session_id, turn, CAST(second + 1 AS BIGINT) AS second, CAST(chars AS BIGINT) AS output_tokens,
    CASE WHEN previous = 'user' AND second > asked THEN CAST((second - asked) * 1000 AS DOUBLE) END AS duration_ms
  FROM conv_before WHERE role = 'assistant'),
"""


def evidence(tail: str) -> str:
    return ledger(tail, EVIDENCE)


ORACLES = {
    "title_join": evidence("SELECT session_id, title FROM titles"),
    "message_link": evidence("SELECT host, app_type, request_id, session_id, link, message_title FROM linked"),
    "session_title_join": evidence(
        "SELECT app_type, session_title, CAST(count(*) AS BIGINT) AS requests FROM attached GROUP BY ALL"
    ),
    "project_agreement": evidence("SELECT host, app_type, request_id, project_key, project_name FROM enriched"),
    "provider_header": evidence(
        """SELECT host, request_id, sha256(session_id) AS session_key, session_provider FROM enriched
        WHERE session_provider IS NOT NULL"""
    ),
    "unmatched_sessions": evidence(
        """SELECT DISTINCT session_id FROM ledger WHERE data_source = 'codex_session' AND session_id IS NOT NULL
        AND session_id NOT IN (SELECT session_id FROM hdr WHERE provider IS NOT NULL)"""
    ),
    "enrichment_audit": evidence(
        """SELECT CAST(count(session_title) AS BIGINT) AS requests_with_saved_title,
        CAST(count(*) FILTER (WHERE link = 'linked') AS BIGINT) AS requests_linked_by_message_id,
        CAST(count(*) FILTER (WHERE link = 'ambiguous') AS BIGINT) AS ambiguous_message_id_requests,
        CAST(count(*) FILTER (WHERE link = 'same_title') AS BIGINT) AS message_id_requests_resolved_by_same_title,
        CAST(count(session_provider) AS BIGINT) AS requests_matched,
        CAST(count(project_key) AS BIGINT) AS requests_with_project FROM enriched"""
    ),
    "response_intervals": evidence(
        "SELECT session_id, second, output_tokens, round(duration_ms, 6) AS duration_ms FROM timing"
    ),
    "exact_timing_join": evidence(
        """SELECT 'q-' || session_id || '-' || (turn * 2 + 1) AS request_id, session_id, second AS created_at, output_tokens,
        CASE WHEN (turn * 2 + 1) % 4 <> 1 THEN duration_ms END AS native_response_ms FROM timing"""
    ),
    "counter_repeats": """SELECT user_id, event_id, total FROM (
        SELECT user_id, event_id, CAST(round(value) AS BIGINT) AS total,
          lag(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
        WHERE previous IS NULL OR previous <> total""",
}
