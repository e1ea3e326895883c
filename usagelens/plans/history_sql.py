"""The archive and history queries as plain SQL, for checking."""

from __future__ import annotations

from usagelens.operators.history import RANGES
from usagelens.plans.history import LONGER
from usagelens.plans.report_sql import _b, usage
from usagelens.plans.telemetry_sql import telemetry

NOW = 899208000
START = (NOW - 2419200) // 60 * 60
DAY = "(date - DATE '1970-01-01')"

ARCHIVE = f"""
arch AS (SELECT date, host, app, model, {_b('sum(total_tokens)', 'tokens')}, {_b('sum(requests)', 'requests')},
  {_b('sum(cost_cents)', 'cost_cents')} FROM daily GROUP BY ALL),
fresh AS (SELECT * FROM arch WHERE host IN ('h0', 'h1') AND {DAY} % 5 <> 0),
covered AS (SELECT DISTINCT date, host FROM arch WHERE host IN ('h0', 'h1') AND ({DAY} % 5 <> 0 OR {DAY} % 10 = 0)),
saved AS (SELECT * REPLACE (tokens + CASE WHEN {DAY} % 4 = 0 THEN 1 ELSE 0 END AS tokens),
  CASE WHEN host = 'h2' AND {DAY} % 3 = 0 THEN 'old' ELSE sha256('settings-' || host) END AS source_identity
  FROM arch WHERE host <> 'h9'),
entries AS (
  SELECT c.date, c.host, sha256('settings-' || c.host) AS source_identity, app, model, coalesce(tokens, 0) AS tokens,
    coalesce(requests, 0) AS requests, coalesce(cost_cents, 0) AS cost_cents
  FROM covered c LEFT JOIN fresh USING (date, host)
  UNION ALL
  SELECT date, host, source_identity, app, model, tokens, requests, cost_cents FROM saved s ANTI JOIN covered USING (date, host)),
"""

TOKENS = "fresh + output_tokens + cache_read_tokens + cache_creation_tokens"

MINUTES = """
read AS (
  SELECT 'm' || (user_id % 3) AS series, CAST(ms AS DOUBLE) / 1000 AS wall, event_id,
    CAST(ms AS DOUBLE) / 1000 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS mono, value AS total_tps,
    CASE WHEN event_type = 'error' THEN NULL ELSE value / (1 + user_id % 4) END AS average_tps,
    event_type = 'signup' AS part FROM ev),
pairs AS (
  SELECT series, wall, lag(wall) OVER w AS pw, mono - lag(mono) OVER w AS el, lag(total_tps) OVER w AS t,
    lag(average_tps) OVER w AS a, lag(part) OVER w AS part
  FROM read WINDOW w AS (PARTITION BY series ORDER BY wall, event_id)),
span AS (SELECT series, wall - el AS b, wall AS e, t, a, part FROM pairs
  WHERE el > 0 AND el <= 2.5 AND abs(wall - pw - el) <= 1),
"""


def _integral(cell: int, name: str) -> str:
    return f"""{name} AS (
  SELECT series, c * {cell} AS minute, coalesce(sum(t * s), 0) AS total_integral,
    least({cell}.0::DOUBLE, coalesce(sum(s) FILTER (WHERE t IS NOT NULL), 0)) AS total_covered_s,
    coalesce(sum(a * s), 0) AS average_integral,
    least({cell}.0::DOUBLE, coalesce(sum(s) FILTER (WHERE a IS NOT NULL), 0)) AS average_covered_s,
    least({cell}.0::DOUBLE, coalesce(sum(s) FILTER (WHERE part), 0)) AS partial_s
  FROM (SELECT *, least(e, (c + 1) * {cell}) - greatest(b, c * {cell}) AS s FROM (
    SELECT *, unnest(range(CAST(floor(b / {cell}) AS BIGINT), CAST(ceil(e / {cell}) AS BIGINT))) AS c FROM span))
  GROUP BY series, c),
"""


COUNTS = """
mtok AS (SELECT 'm' || (user_id % 3) AS series, ms // 60000 * 60 AS slot,
  CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS tokens FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
ftok AS (SELECT 'm' || (user_id % 3) AS series, ms // 5000 * 5 AS slot,
  CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS tokens FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
"""
FIELDS = ("total_integral", "total_covered_s", "average_integral", "average_covered_s")


def _upsert(tokens: str, partial: str) -> str:
    return telemetry(
        f"""SELECT coalesce(o.slot, g.slot) AS slot,
        CASE WHEN g.slot IS NULL THEN o.tokens ELSE {tokens} END AS tokens, true AS known,
        CASE WHEN g.slot IS NULL THEN false ELSE {partial} END AS partial
        FROM (SELECT * FROM mtok WHERE series = 'm0') o FULL JOIN (
          SELECT s AS slot, coalesce(tokens, 0) AS n FROM range(2842260, 2844480, 60) AS r(s)
          LEFT JOIN (SELECT slot, tokens FROM mtok WHERE series = 'm1') t ON t.slot = r.s) g ON g.slot = o.slot""",
        COUNTS,
    )


def _upsert_days(tokens: str) -> str:
    days = f"SELECT date, {_b('sum(total_tokens)', 'tokens')} FROM daily WHERE grain = 'rollup'"
    return usage(
        f"""SELECT coalesce(o.date, n.date) AS date, CAST({tokens} AS BIGINT) AS tokens
        FROM ({days} AND host = 'h0' GROUP BY 1) o FULL JOIN ({days} AND host = 'h1' AND date >= DATE '1995-01-01' GROUP BY 1) n ON n.date = o.date"""
    )


def _untimed() -> str:
    # A range begins 120 buckets before the first whole minute, or bucket, after the moment.
    parts = []
    for period in RANGES:
        align = min(60, period // 120)
        begin = NOW // align * align + align - period
        parts.append(
            f"""SELECT CAST({period} AS BIGINT) AS period, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS day_only_tokens FROM daily
            WHERE grain = 'rollup' AND {DAY} * 86400 >= {begin} AND {DAY} * 86400 + 86400 <= {NOW}"""
        )
    return usage(" UNION ALL ".join(parts))


def _history(begin: int, end: int, step: int, now: int, fine: bool) -> str:
    hasfine = "EXISTS (SELECT 1 FROM fine f WHERE f.series = m.series AND f.minute // 60 * 60 = m.minute)" if fine else "false"
    share = f"(least(minute + 60, g + {step}) - greatest(minute, g)) / 60.0::DOUBLE"
    ctes = (
        MINUTES + _integral(60, "mins") + _integral(5, "fine") + COUNTS
        + f"""grid AS (SELECT 'm' || s AS series, g FROM range(0, 3) AS a(s), range({begin}, {end}, {step}) AS b(g)),
m AS (SELECT m.*, {hasfine} AS has_fine FROM mins m),
spread AS (SELECT m.*, g, {share} AS share FROM grid JOIN m USING (series)
  WHERE m.minute + 60 > g AND m.minute < g + {step} AND m.minute + 60 > {begin} AND m.minute < {end}),
rate AS (SELECT series, g, {', '.join(f'coalesce(sum({f} * share) FILTER (WHERE NOT has_fine), 0) AS {f}' for f in FIELDS)},
  bool_or(NOT has_fine AND total_covered_s > 0 AND {str(step < 60).lower()}) AS coarse, bool_or(partial_s > 0) AS part
  FROM spread GROUP BY ALL),
finer AS (SELECT series, (CAST(minute AS BIGINT) - {begin}) // {step} * {step} + {begin} AS g,
  {', '.join(f'sum({f}) AS {f}' for f in FIELDS)}, bool_or(partial_s > 0) AS part
  FROM fine WHERE {str(fine).lower()} AND minute >= {begin} AND minute < {end} GROUP BY ALL),
cnt AS (SELECT series, (slot - {begin}) // {step} * {step} + {begin} AS g, CAST(sum(tokens) AS BIGINT) AS tokens,
  bool_or({str(step < 60).lower()} AND whole) AS coarse FROM (
    SELECT series, slot, tokens, true AS whole FROM mtok WHERE slot >= {begin} AND slot < {end}
      AND ({str(not fine).lower()} OR series = 'm2')
    UNION ALL SELECT series, slot, tokens, false FROM ftok WHERE {str(fine).lower()} AND series <> 'm2'
      AND slot >= {begin} AND slot < {end}) GROUP BY ALL),"""
    )
    pick = {f: f"coalesce(x.{f}, r.{f}, 0)" for f in FIELDS}
    return telemetry(
        f"""SELECT series, g AS start,
        round(CASE WHEN {pick['total_covered_s']} > 0 THEN {pick['total_integral']} / {pick['total_covered_s']} END, 6) AS total_tps,
        round(CASE WHEN {pick['average_covered_s']} > 0 THEN {pick['average_integral']} / {pick['average_covered_s']} END, 6)
          AS average_tps, c.tokens, round({pick['total_covered_s']}, 6) AS observed_seconds,
        coalesce(r.coarse, false) AND x.g IS NULL AS coarse_rate, coalesce(c.coarse, false) AS coarse_tokens,
        coalesce(r.part, false) OR coalesce(x.part, false)
          OR {pick['total_covered_s']} < least({step}, greatest(0, {now} - g)) - 1 AS partial
        FROM grid LEFT JOIN rate r USING (series, g) LEFT JOIN finer x USING (series, g) LEFT JOIN cnt c USING (series, g)""",
        ctes,
    )


ORACLES = {
    "archive_rows": usage("SELECT * FROM arch", ARCHIVE),
    "archive_merge": usage(
        """SELECT *, false AS archived FROM fresh UNION ALL
        SELECT date, host, app, model, tokens, requests, cost_cents, true FROM saved s ANTI JOIN covered USING (date, host)
        WHERE source_identity <> 'old'""",
        ARCHIVE,
    ),
    "archive_hours": usage(
        """SELECT date, 'Unknown hour' AS hour, host, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM saved s ANTI JOIN covered USING (date, host) WHERE source_identity <> 'old' GROUP BY ALL""",
        ARCHIVE,
    ),
    "archive_next": usage("SELECT * FROM entries", ARCHIVE),
    "archive_changed_days": usage(
        """SELECT DISTINCT date FROM ((SELECT * FROM entries EXCEPT SELECT date, host, source_identity, app, model, tokens,
          requests, cost_cents FROM saved)
        UNION ALL (SELECT date, host, source_identity, app, model, tokens, requests, cost_cents FROM saved EXCEPT SELECT * FROM entries)
        UNION ALL (SELECT max(date), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM entries GROUP BY host, source_identity))""",
        ARCHIVE,
    ),
    "stale_fallback": usage(
        f"""SELECT host, status, tokens, requests FROM
        (VALUES ('h0', 'fresh'), ('h1', 'stale'), ('h2', 'fresh'), ('h3', 'unavailable')) AS v(host, status) LEFT JOIN (
        SELECT host, {_b('sum(total_tokens)', 'tokens')}, {_b('sum(requests)', 'requests')} FROM daily
        WHERE host IN ('h0', 'h2') OR (host = 'h1' AND date < DATE '2001-01-01') GROUP BY 1) USING (host)"""
    ),
    "minute_usage": usage(
        f"""SELECT created_at // 60 * 60 AS slot, {_b(f'sum({TOKENS})', 'tokens')} FROM timed
        WHERE created_at BETWEEN {START} AND {NOW} GROUP BY ALL"""
    ),
    "fine_usage": usage(
        f"""SELECT host, created_at // 5 * 5 AS slot, {_b(f'sum({TOKENS})', 'tokens')} FROM timed
        WHERE created_at BETWEEN {NOW - 86400} AND {NOW} GROUP BY ALL"""
    ),
    "day_only_usage": usage(
        f"""SELECT date, {_b('sum(total_tokens)', 'tokens')} FROM daily WHERE grain = 'rollup' AND date >= DATE '1998-06-02'
        GROUP BY ALL"""
    ),
    "usage_upsert_full": _upsert("g.n", "false"),
    "usage_upsert_partial": _upsert(
        "greatest(coalesce(o.tokens, 0), g.n)", "CASE WHEN o.slot IS NOT NULL AND g.n <= o.tokens THEN false ELSE true END"
    ),
    "days_upsert_full": _upsert_days(
        "coalesce(n.tokens, CASE WHEN o.date >= DATE '1995-01-01' AND o.date < DATE '1998-06-30' THEN 0 ELSE o.tokens END)"
    ),
    "days_upsert_partial": _upsert_days("greatest(o.tokens, n.tokens)"),
    "history_untimed": _untimed(),
    "rate_integral": telemetry(
        """SELECT series, minute, round(total_integral, 6) AS total_integral, round(total_covered_s, 6) AS total_covered_s,
        round(average_integral, 6) AS average_integral, round(average_covered_s, 6) AS average_covered_s,
        round(partial_s, 6) AS partial_s FROM mins""",
        MINUTES + _integral(60, "mins"),
    ),
    "history_10_minutes": _history(2841425, 2842025, 5, 2842020, True),
    # Ends lie on the bucket's width, at most a minute; the 120 buckets reach back from there.
    **{
        f"history_{name}": _history(2842020 + min(60, period // 120) - period, 2842020 + min(60, period // 120), period // 120, 2842020, False)
        for name, period in LONGER.items()
    },
    "receipts_120": telemetry(
        """SELECT 'all' AS series, g AS start, round(tokens, 6) AS output_tokens, round(tokens / 5, 6) AS receipt_tps,
        round(coalesce(observed, 0), 6) AS observed_seconds, coalesce(coarse, false) AS coarse_receipts,
        coalesce(part, false) OR coalesce(observed, 0) < 5 AS partial
        FROM grid LEFT JOIN (
          SELECT g, sum(tokens * share) AS tokens, sum(observed * share) AS observed, bool_or(coarse) AS coarse,
            bool_or(part > 0) AS part
          FROM (SELECT *, CAST(least(stamp + span, g + 5) - greatest(stamp, g) AS DOUBLE) / span AS share
                FROM grid JOIN parts ON stamp + span > g AND stamp < g + 5) GROUP BY g) USING (g)""",
        """mins AS (SELECT second // 60 * 60 AS stamp, sum(output_tokens) AS tokens, count(*) AS observed,
          count(*) FILTER (WHERE excluded) AS part FROM received GROUP BY 1),
        parts AS (
          SELECT second AS stamp, 1 AS span, output_tokens AS tokens, 1 AS observed, CAST(excluded AS INT) AS part, false AS coarse
          FROM received WHERE second // 60 % 4 <> 0
          UNION ALL SELECT stamp, least(60, greatest(1, 2842020 - stamp, observed, part)), tokens, observed, part, true
          FROM mins WHERE stamp // 60 % 4 = 0),
        grid AS (SELECT g FROM range(2841425, 2842025, 5) AS r(g)),""",
    ),
    "journal_latest": telemetry(
        """SELECT 'm' || (user_id % 3) AS series, ms // 60000 * 60 AS minute, max(event_id) AS sequence,
        arg_max(CAST(round(value * 10) AS BIGINT), event_id) AS tokens FROM ev WHERE ms // 60000 * 60 >= 2841000 GROUP BY 1, 2"""
    ),
}
