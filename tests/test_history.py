import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from usagelens.operators import archive, history

NOW = 1791396000
MINUTE = ("series string, minute long, total_integral double, total_covered_s double, average_integral double,"
          " average_covered_s double, partial_s double, tokens long, usage_known boolean, usage_partial boolean")


def minutes(spark, *rows):
    return spark.createDataFrame([("m", *r) for r in rows], MINUTE)


def usage_minute(minute, tokens):
    return (minute, 0.0, 0.0, 0.0, 0.0, 0.0, tokens, True, False)


def readings(spark, *rows):
    return spark.createDataFrame(
        [("m", i, float(w), float(mono), rate, rate, status) for i, (w, mono, rate, status) in enumerate(rows)],
        "series string, reading_id long, wall double, monotonic double, total_tps double, average_tps double, status string")


def test_integration_splits_at_minutes_and_skips_gaps(spark):
    df = readings(spark, (59, 59, 10.0, "complete"), (61, 61, 20.0, "partial"), (62, 62, None, "complete"), (70, 70, 5.0, "complete"),
                  (71, 71, 5.0, "complete"), (74, 72, 5.0, "complete"), (72.5, 0, 5.0, "complete"))
    got = {r.minute: r for r in history.integrate_rates(df).collect()}
    assert got[0].total_integral == 10.0 and got[0].total_covered_s == 1.0
    assert got[60].total_integral == pytest.approx(10 + 20 + 5) and got[60].total_covered_s == pytest.approx(3)
    assert got[60].partial_s == pytest.approx(1)


def test_integration_crosses_chunks(spark):
    df = readings(spark, *[(3590 + i, 3590 + i, 2.0, "complete") for i in range(20)])
    total = history.integrate_rates(df).agg(F.sum("total_integral")).first()[0]
    assert total == pytest.approx(19 * 2.0)


def test_every_range_conserves_counts_and_receipts(spark):
    seconds = spark.createDataFrame([("m", NOW + s, 1200 if s == 30 else 0, True, False) for s in range(60)],
                                    "series string, second long, output_tokens long, observed boolean, partial boolean")
    bins = history.receipt_minutes(seconds)
    kept = minutes(spark, usage_minute(NOW, 1200))
    none = seconds.where("false")
    for period in (600, 3600, 86400, 2419200):
        step = period // 120
        rows = history.history_buckets(kept, period, NOW + 59).collect()
        assert len(rows) == 120 and sum(r.tokens or 0 for r in rows) == 1200
        for detail in (seconds, none):
            got = history.receipt_buckets(bins, detail, period, NOW + 59).collect()
            assert len(got) == 120
            assert sum((r.receipt_tps or 0) * step for r in got) == pytest.approx(1200)


def test_fine_counts_need_to_add_up(spark):
    fine = spark.createDataFrame([("m", NOW + 5, 1000, False), ("m", NOW + 35, 100, False)], "series string, slot long, tokens long, partial boolean")

    def halves(tokens, period=3600):
        rows = history.history_buckets(minutes(spark, usage_minute(NOW, tokens)), period, NOW + 59, fine_usage=fine).orderBy("start").collect()
        return [(r.start - NOW, r.tokens, r.coarse_tokens) for r in rows if NOW <= r.start < NOW + 60]

    assert halves(1100) == [(0, 1000, False), (30, 100, False)]
    assert halves(1200) == [(0, 1200, True), (30, None, False)]
    assert [h for h in halves(1100, 600) if h[1]] == [(5, 1000, False), (35, 100, False)]


def test_fine_rates_replace_minute_means(spark):
    coarse = minutes(spark, (NOW, 600.0, 60.0, 600.0, 60.0, 0.0, None, False, False))
    fine = spark.createDataFrame([("m", NOW + 30, 50.0, 5.0, 50.0, 5.0, 0.0)],
                                 "series string, minute long, total_integral double, total_covered_s double, average_integral double, average_covered_s double, partial_s double")
    rows = {r.start - NOW: r for r in history.history_buckets(coarse, 600, NOW + 59, fine).collect()}
    assert rows[30].total_tps == 10.0 and not rows[30].coarse_rate and rows[0].total_tps is None
    plain = {r.start - NOW: r for r in history.history_buckets(coarse, 600, NOW + 59).collect()}
    assert plain[0].total_tps == 10.0 and plain[0].coarse_rate


def test_unknown_range_fails(spark):
    with pytest.raises(ValueError):
        history.bucket_bounds(700, NOW)


def upserted(spark, partial, available=True):
    old = spark.createDataFrame([(0, 10, True, False), (60, 5, True, False), (600, 9, True, False)], "slot long, tokens long, known boolean, partial boolean")
    new = spark.createDataFrame([(0, 7), (120, 3)], "slot long, tokens long")
    rows = history.upsert_usage(old, new, 0, 180, partial, available).collect()
    return {r.slot: (r.tokens, r.partial) for r in rows}


def test_reports_replace_raise_or_change_nothing(spark):
    assert upserted(spark, False) == {0: (7, False), 60: (0, False), 120: (3, False), 600: (9, False)}
    assert upserted(spark, True) == {0: (10, False), 60: (5, False), 120: (3, True), 600: (9, False)}
    assert upserted(spark, True, available=False) == {0: (10, False), 60: (5, False), 600: (9, False)}


def test_day_counts(spark):
    schema = "date date, tokens long"
    day = dt.date(2026, 1, 1)
    old = spark.createDataFrame([(day, 5), (day + dt.timedelta(1), 6)], schema)
    new = spark.createDataFrame([(day, 3)], schema)
    bounds = (F.lit(day), F.lit(day + dt.timedelta(5)))
    assert [r.tokens for r in history.upsert_days(old, new, *bounds, True).orderBy("date").collect()] == [5, 6]
    assert [r.tokens for r in history.upsert_days(old, new, *bounds, False).orderBy("date").collect()] == [3, 0]
    stamp = int(dt.datetime(2026, 1, 3, tzinfo=dt.timezone.utc).timestamp())
    assert history.untimed_tokens(old, 604800, stamp).first()[0] == 11


def test_journal(spark):
    rows = spark.createDataFrame([("m", 0, 1, 5), ("m", 0, 2, 9), ("m", 600, 1, 4)], "series string, minute long, sequence long, tokens long")
    got = {r.minute: r.tokens for r in history.latest_per_key(rows, ["series", "minute"], "sequence").collect()}
    assert got == {0: 9, 600: 4}
    assert history.latest_per_key(rows, ["series", "minute"], "sequence", 60).count() == 1


def day_rows(spark, *rows):
    return spark.createDataFrame(
        [(dt.date.fromisoformat(d), h, "Codex", "m", n, 1, Decimal(1)) for d, h, n in rows],
        "date date, host string, app string, model string, tokens long, requests long, cost_usd decimal(38,18)")


def covered(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), h) for d, h in rows], "date date, host string")


def machines(spark, *hosts):
    return spark.createDataFrame([(h, f"id-{h}", dt.datetime(2026, 1, 9), "UTC") for h in hosts],
                                 "host string, source_identity string, collected_at timestamp, host_timezone string")


def test_archive_keeps_uncovered_days(spark):
    empty = day_rows(spark).selectExpr("date", "host", "'' AS source_identity", "CAST(NULL AS TIMESTAMP) AS collected_at",
                                       "'' AS timezone", "app", "model", "tokens", "requests", "cost_usd")
    first = day_rows(spark, ("2026-01-01", "a", 1000), ("2026-01-01", "b", 1060))
    both = machines(spark, "a", "b")
    saved = archive.next_archive(first, covered(spark), both, empty)
    total = lambda df: df.agg(F.sum("tokens")).first()[0]
    only_a = day_rows(spark, ("2026-01-01", "a", 1010))
    assert total(archive.merge_archive(only_a, covered(spark), saved)) == 2070
    # A covered day without rows replaces the archive and stays replaced.
    gone = archive.merge_archive(day_rows(spark), covered(spark, ("2026-01-01", "b")), saved)
    assert total(gone) == 1000
    after = archive.next_archive(day_rows(spark), covered(spark, ("2026-01-01", "b")), machines(spark, "b"), saved)
    assert total(archive.merge_archive(day_rows(spark), covered(spark), after)) == 1000
    assert total(archive.selected(saved, machines(spark, "a"))) == 1000


def test_stale_hosts_keep_their_rows(spark):
    fresh, old = day_rows(spark, ("2026-01-02", "a", 1)), day_rows(spark, ("2026-01-01", "a", 7), ("2026-01-01", "b", 9))
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    status = archive.source_status(expected, expected.where("host = 'a'"), old)
    assert {r.host: r.status for r in status.collect()} == {"a": "fresh", "b": "stale", "c": "unavailable"}
    assert sorted(r.tokens for r in archive.with_stale_fallback(fresh, old, status).collect()) == [1, 9]


def test_archive_rows_are_checked(spark):
    bad = day_rows(spark, ("2026-01-01", "a", -1)).withColumnRenamed("tokens", "total_tokens")
    with pytest.raises(Exception, match="Invalid daily accounting row: tokens"):
        archive.archive_rows(bad).collect()
