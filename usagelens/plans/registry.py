"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from usagelens.plans import (
    enrichment, enrichment_sql, history, history_sql, landed, report_sql, reports, streams, telemetry,
    telemetry_sql, titles,
)

QUERIES = {
    **reports.QUERIES, **enrichment.QUERIES, **telemetry.QUERIES, **history.QUERIES, **streams.QUERIES, **landed.QUERIES, **titles.QUERIES,
}
ORACLES = {
    **report_sql.ORACLES, **enrichment_sql.ORACLES, **telemetry_sql.ORACLES, **history_sql.ORACLES, **streams.ORACLES, **landed.ORACLES,
    **titles.ORACLES,
}
