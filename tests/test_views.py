import pytest
from pyspark.sql import functions as F

from tests import rows as R
from usagelens.functions import dates
from usagelens.operators import prefix, reports, sessions, sorting, speed, timeline


def test_date_presets():
    assert dates.date_preset("last-month", "2024-03-31") == ("2024-02-01", "2024-02-29")
    assert dates.date_preset("past-seven-days", "2026-10-26") == ("2026-10-20", "2026-10-26")
    assert dates.date_preset("last-year", "2026-10-26") == ("2025-01-01", "2025-12-31")
    for bad in (("today", "2026-2-1"), ("tomorrow", "2026-02-01"), ("today", "2026-02-30")):
        with pytest.raises(ValueError):
            dates.date_preset(*bad)


def test_period_units():
    assert dates.period_unit("2026-08-29", "2026-09-04") == "week"
    assert dates.period_unit("2024-02-01", "2024-02-29") == "month"
    assert dates.period_unit("2024-02-01", None) == "range"
    assert dates.period_unit(None, None) == "monthly"
    assert dates.period_unit("2024-02-01", "2024-02-01") == "day"


def test_slot_hours(spark):
    expected = [(1, 1000, 1), (2, 1000, 2), (3, 1000, 2), (3, 600, 3), (14, 1000, 12), (15, 1000, 24)]
    for days, width, hours in expected:
        assert dates.fixed_slot_hours(days, width) == hours
        assert spark.range(1).select(dates.slot_hours(F.lit(days), width)).first()[0] == hours
    two = timeline.resolution(R.usage(spark, ("2026-01-01", "a", 1, "0")), "2026-01-01", "2026-01-02")
    assert timeline.slots(two).count() == 24


def test_resolution_from_data(spark):
    rows = R.usage(spark, ("2026-01-01", "a", 5, "1", "03"), ("2026-01-02", "b", 7, "2", "04"), ("2026-01-02", "b", 1, "2"))
    bounds = timeline.resolution(rows)
    got = {(r.slot, r.model): r.tokens for r in timeline.time_buckets(rows, bounds).collect()}
    assert got[("2026-01-01T02:00", "a")] == 5 and got[("2026-01-02T04:00", "b")] == 7
    assert got[("Unknown hour", "b")] == 1 and len(got) == 25


def test_stack_segments(spark):
    buckets = R.usage(spark, ("2026-01-01", "b", 5, "1"), ("2026-01-01", "a", 5, "1"), ("2026-01-01", "c", 2, "1"),
                      ("2026-01-01", "zero", 0, "1"))
    bounds = timeline.resolution(buckets, "2025-01-01", "2026-01-01")
    got = timeline.stack_segments(timeline.time_buckets(buckets, bounds)).orderBy("segment_base").collect()
    assert [(r.model, r.segment_base, r.segment_end) for r in got] == [("c", 0, 2), ("a", 2, 7), ("b", 7, 12)]


def test_matrix_and_runs(spark):
    rows = R.sessions(
        spark, {"hours": {"00": 30, "01": 20, "05": 10}, "total_tokens": 100},
        {"session_key": "s2", "hours": {"00": 100}, "total_tokens": 100},
    )
    bounds = timeline.resolution(rows, "2026-01-01", "2026-01-01")
    matrix = timeline.session_matrix(rows, bounds)
    cells = {(r.session_key, r.slot): r.tokens for r in matrix.collect()}
    assert cells[("s1", "Unknown hour")] == 40 and ("s2", "Unknown hour") not in cells
    assert sum(cells.values()) == 200
    runs = timeline.temporal_runs(matrix.where("session_key = 's1'"), bounds).collect()
    assert sorted((r.first_index, r.last_index, r.tokens) for r in runs if r.first_index is not None) == [(0, 1, 50), (5, 5, 10)]
    assert [r.tokens for r in runs if r.first_index is None] == [40]
    heat = {r.tokens: r.heat for r in timeline.heat_scale(matrix).collect()}
    assert heat[10] == 0.0 and heat[100] == 1.0
    flat = timeline.heat_scale(matrix.where("tokens = 100")).collect()
    assert [r.heat for r in flat] == [0.5]


def test_line_breaks(spark):
    rows = R.usage(spark, ("2026-01-01", "a", 1, "1"), ("2026-01-02", "a", 1, "1"), ("2026-01-20", "a", 1, "1"))
    bounds = timeline.resolution(rows)
    got = timeline.line_breaks(timeline.time_buckets(rows, bounds), bounds).orderBy("slot").collect()
    assert [r.line_break for r in got] == [True, False, True]


def test_calendar_grid(spark):
    grid = dates.calendar_grid(spark, "2026-10-07", "2026-10-13").orderBy("date").collect()
    assert [r.in_range for r in grid[:3]] == [False, False, True] and grid[0].weekday == 0 and grid[-1].week == 1
    assert dates.calendar_grid(spark, "2026-10-07", "2026-10-01").count() == 0


def test_percentiles(spark):
    df = spark.createDataFrame(
        [("m", 10.0, 100.0, "duration_ms"), ("m", 20.0, 300.0, "latency_ms"), ("m", 90.0, 500.0, "native_log"),
         ("m", None, None, ""), ("m", float("nan"), 0.0, "duration_ms")],
        "model string, tps double, first_token_ms double, duration_source string",
    )
    s = speed.response_stats(df).first()
    assert (s.responses, s.native, s.tps_count, s.tps_avg, s.tps_median) == (5, 1, 3, 40.0, 20.0)
    assert s.tps_p95 == pytest.approx(83) and s.latency_p95 == pytest.approx(0.48)
    without = speed.response_stats(df, include_native=False).first()
    assert (without.tps_count, without.native, without.tps_max) == (2, 0, 20.0)
    empty = speed.response_stats(df.where("tps = -1")).first()
    assert empty.responses == 0 and empty.tps_avg is None and empty.tps_p95 is None


def test_exact_percentiles_against_sorting(spark):
    import random

    random.seed(5)
    data = [(random.choice("ab"), random.choice([0.5, 7.0]) if random.random() < 0.4 else random.random() * 10 ** random.randrange(-3, 6))
            for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in prefix.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in "ab":
        values = sorted(v for k, v in data if k == g)
        for p, have in zip((0.5, 0.95), got[g]):
            i = (len(values) - 1) * p
            low = values[int(i)]
            assert have == pytest.approx(low + (values[min(int(i) + 1, len(values) - 1)] - low) * (i - int(i)))


def test_running_sums_cross_chunks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = prefix.running_sums(df, ["k"], F.floor(F.col("id") / 64), [F.col("id")], {"s": F.col("v")})
    assert {r.id: r.s for r in got.collect()} == {i: sum(j % 7 for j in range(i + 1)) for i in range(1000)}


def test_previous_within(spark):
    times = [0.0, 1.0, 3599.0, 3600.5, 3601.0, 9000.0]
    df = spark.createDataFrame([("s", t, i) for i, t in enumerate(times)], "series string, t double, n int")
    got = prefix.previous_within(df, ["series"], "t", ["n"], ["n"], 2.5).orderBy("t").collect()
    assert [r.previous.n if r.previous else None for r in got] == [None, 0, None, 2, 3, None]


def test_projects(spark):
    rows = R.sessions(
        spark, {}, {"date": "2026-01-02", "tps_count": 1, "tps_sum": 90.0, "tps_max": 90.0},
        {"app": "Claude Code", "session_key": "s2", "model": "b", "tps_count": 0, "tps_sum": 0.0, "tps_max": 0.0},
        {"project_key": "two"}, {"host": "another"}, {"project_key": ""},
    )
    groups = {r.project_key: r for r in sessions.summarize_projects(rows).collect()}
    one = groups["one"]
    assert len(groups) == 2
    assert (one.total_tokens, one.sessions, one.requests, one.tps_avg, one.tps_max, one.cost_usd) == (400, 3, 8, 42.0, 90.0, 2)
    assert one.hosts == ["another", "fictional"] and one.apps == ["Claude Code", "Codex"]
    parts = sessions.project_detail(rows, "Shared name", "one").collect()
    assert sum(r.total_tokens for r in parts if r.part == "date") == 400
    by_date = {str(r.date): r.sessions for r in sessions.summarize_projects(rows, "date").collect()}
    assert by_date["2026-01-02"] == 1
    assert sessions.top_projects(rows, 1).first().project_key == "one"


def test_sessions(spark):
    rows = R.sessions(spark, {}, {"model": "b", "date": "2026-01-03", "native_tps_count": 1, "native_tps_sum": 200.0, "native_tps_max": 200.0},
                      {"session_key": "idle", "tps_count": 0, "tps_sum": 0.0, "tps_max": 0.0})
    plain = {r.session_key: r for r in sessions.summarize_sessions(sessions.with_native_tps(rows, False)).collect()}
    assert plain["s1"].tps_avg == 30.0 and plain["idle"].tps_avg is None and plain["s1"].models == ["a", "b"]
    native = {r.session_key: r for r in sessions.summarize_sessions(sessions.with_native_tps(rows)).collect()}
    assert native["s1"].tps_avg == 64.0 and native["s1"].tps_max == 200.0
    detail = sessions.session_detail(rows, "fictional", "Codex", "s1").collect()
    assert {r.part for r in detail} == {"all", "date", "model"}
    assert sum(r.total_tokens for r in detail if r.part == "model") == 200
    shares = sessions.component_share(rows).where("session_key = 's1'").collect()
    assert sum(r.share for r in shares) == pytest.approx(100)


def test_hidden_sessions(spark):
    empty = {"requests": 1, "total_tokens": 0, "cost_usd": "0", "model": "Claude"}
    rows = R.sessions(
        spark, {**empty, "session_key": "hidden"}, {**empty, "session_key": "two", "requests": 2},
        {**empty, "session_key": "paid", "cost_usd": "0.1"}, {**empty, "session_key": "other", "model": "claudette"},
        {**empty, "session_key": "tokens", "total_tokens": 1}, {**empty, "session_key": "both"},
        {**empty, "session_key": "both", "model": "gpt", "date": "2026-02-01"},
    )
    shown = {r.session_key for r in sessions.visible_sessions(rows).collect()}
    assert shown == {"two", "paid", "other", "tokens", "both"}
    daily = R.usage(spark, ("2026-01-01", "Claude", 0, "0"), ("2026-01-01", "claude-x", 0, "0"), ("2026-01-01", "m", 1, "0"))
    only = R.sessions(spark, {**empty, "session_key": "hidden"})
    assert {r.model for r in sessions.available_models(daily, only).collect()} == {"claude-x", "m"}


def test_filters(spark):
    rows = R.usage(spark, ("2026-01-01", "a", 1, "0"), ("2026-02-01", "b", 1, "0"))
    assert reports.filter_usage(rows, "2026-01-15", None, ["a", "b"]).count() == 1
    assert reports.filter_usage(rows, None, None, []).count() == 0
    assert [r.model for r in reports.search_models(reports.models_in_range(rows), "B").collect()] == ["b"]


def test_sorting(spark):
    numbers = [10.0, 2.0, 0.0, 1200.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(numbers)], "v double, i int")
    up = [r.v for r in sorting.sort_table(df, "v", "ascending", ["i"]).collect()]
    down = [r.i for r in sorting.sort_table(df, "v", "descending", ["i"]).collect()]
    assert up[:4] == [0.0, 2.0, 10.0, 1200.0] and down == [3, 0, 1, 2, 4, 5, 6]
    text = spark.createDataFrame([("Model 10",), ("model 2",), ("Atlas",), ("",), (None,)], "v string")
    ordered = [r.v for r in sorting.sort_table(text, "v").collect()]
    assert ordered[:3] == ["Atlas", "model 2", "Model 10"] and set(ordered[3:]) == {"", None}
    with pytest.raises(ValueError):
        sorting.sort_table(df, "v", "reverse")
    with pytest.raises(ValueError):
        sorting.sort_table(df, "missing")
