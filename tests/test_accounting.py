import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests import rows as R
from usagelens.functions import usage as U
from usagelens.operators import dedupe, facts, reports


def test_fresh_input(spark):
    df = R.requests(
        spark, {}, {"input_token_semantics": 1}, {"input_token_semantics": 2}, {"app_type": "claude"},
        {"input_tokens": 300}, {"input_token_semantics": None},
    )
    assert [r[0] for r in df.select(U.fresh_input()).collect()] == [440, 370, 870, 870, 300, 440]


def test_unknown_semantics_fail(spark):
    with pytest.raises(PySparkException, match="Unknown meaning of input tokens: 7"):
        R.requests(spark, {"input_token_semantics": 7}).select(U.fresh_input()).collect()


@pytest.mark.parametrize(
    "proxy,copy,kept",
    [
        ({}, {}, 1),
        ({}, {"created_at": 5800}, 1),
        ({}, {"created_at": 5801}, 2),
        ({}, {"created_at": 4600}, 1),
        ({}, {"created_at": 4599}, 2),
        ({"status_code": 500}, {}, 2),
        ({"data_source": None}, {}, 1),
        ({"app_type": "claude-desktop"}, {"app_type": "claude", "data_source": "session_log"}, 1),
        ({"app_type": "claude"}, {"app_type": "claude-desktop"}, 2),
        ({}, {"cache_creation_tokens": 0}, 1),
        ({}, {"cache_creation_tokens": 0, "data_source": "session_log"}, 2),
        ({}, {"cache_creation_tokens": 5}, 2),
        ({"model": "MODEL"}, {}, 1),
        ({"model": "other"}, {}, 2),
        ({"model": "unknown"}, {}, 1),
        ({"model": "other"}, {"model": None}, 1),
        ({}, {"output_tokens": 32}, 2),
        ({"host": "two"}, {}, 2),
    ],
)
def test_proxy_covers_session_copy(spark, proxy, copy, kept):
    df = R.requests(spark, {"request_id": "p", "data_source": "proxy", **proxy}, {"request_id": "s", **copy})
    result = [r.request_id for r in dedupe.effective_requests(df).collect()]
    assert "p" in result and len(result) == kept


def test_effective_against_brute_force(spark):
    import random

    random.seed(3)
    data = [
        {
            "request_id": str(i), "host": random.choice("ab"), "input_tokens": random.choice([0, 1]), "output_tokens": 0,
            "cache_read_tokens": 0, "cache_creation_tokens": random.choice([0, 1]),
            "app_type": random.choice(["codex", "claude", "claude-desktop"]), "model": random.choice(["m", "N", "n", "unknown"]),
            "created_at": random.randrange(-2000, 9000), "status_code": random.choice([200, 200, 500]),
            "data_source": random.choice([None, "proxy", "session_log", "codex_session"]),
        }
        for i in range(400)
    ]

    def covers(p, s):
        return (
            p["data_source"] in (None, "proxy") and p["status_code"] == 200 and p["host"] == s["host"]
            and p["input_tokens"] == s["input_tokens"]
            and (p["app_type"] == s["app_type"] or (s["app_type"] == "claude" and p["app_type"] == "claude-desktop"))
            and (p["cache_creation_tokens"] == s["cache_creation_tokens"]
                 or (s["cache_creation_tokens"] == 0 and s["data_source"] != "session_log"))
            and (p["model"].lower() == s["model"].lower() or "unknown" in (p["model"], s["model"]))
            and abs(p["created_at"] - s["created_at"]) <= 600
        )

    expected = {
        s["request_id"] for s in data
        if s["data_source"] not in ("session_log", "codex_session") or not any(covers(p, s) for p in data)
    }
    got = dedupe.effective_requests(R.requests(spark, *data)).select("request_id").collect()
    assert sorted(r[0] for r in got) == sorted(expected)


def test_first_host_keeps_a_copied_request(spark):
    df = R.requests(spark, {"host": "two", "host_order": 1}, {"provider_id": "p"}, {"request_id": "other"})
    result = {r.request_id: r.host for r in dedupe.unique_requests(df).collect()}
    assert result == {"r": "one", "other": "one"}


def test_copies_are_combined_before_they_are_shuffled(spark):
    """No window over ids: a part of the aggregate runs on either side of the exchange."""
    plan = dedupe.unique_requests(R.requests(spark, {}, {"host": "two", "host_order": 1}))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_conflicting_copies_fail(spark):
    df = R.requests(spark, {}, {"host": "two", "host_order": 1, "output_tokens": 32})
    with pytest.raises(PySparkException, match="Hosts disagree about request"):
        dedupe.unique_requests(df).collect()


def test_a_null_in_one_copy_is_a_conflict(spark):
    df = R.requests(spark, {"cache_read_tokens": None, "cache_creation_tokens": 430}, {"host": "two", "host_order": 1, "cache_read_tokens": 430, "cache_creation_tokens": None})
    with pytest.raises(PySparkException, match="Hosts disagree about request"):
        dedupe.unique_requests(df).collect()


def test_two_hosts_with_one_request_and_rollup(spark):
    both = R.requests(spark, {"request_id": "same"}, {"request_id": "same", "host": "two", "host_order": 1})
    unique = dedupe.unique_requests(dedupe.effective_requests(both))
    rolled = R.rollups(spark, "one", "two")
    names = R.providers(spark, ("one", "x", "codex", "X"))
    rows = facts.usage_rows(facts.request_rows(unique, names), facts.rollup_rows(rolled, names))
    total = reports.grand_total(facts.daily_usage(rows)).first()
    assert unique.count() == 1
    assert dedupe.rollup_overlap(rolled).count() == 1
    assert (total.requests, total.tokens) == (9, 3 * 971)


def test_labels_and_local_time(spark):
    moment = int(dt.datetime(2026, 9, 1, 23, 30, tzinfo=dt.timezone.utc).timestamp())
    df = R.requests(
        spark, {"created_at": moment, "provider_id": "a", "app_type": "grokbuild"},
        {"created_at": moment, "provider_id": "b", "app_type": "claude-desktop", "model": ""},
        {"created_at": moment, "provider_id": "_x", "session_provider": "mine"},
    )
    names = R.providers(spark, ("one", "a", "grokbuild", "Acme"))
    tokyo = {r.app: r for r in facts.request_rows(df, names, "Asia/Tokyo").collect()}
    assert tokyo["Grokbuild"].provider == "Acme" and tokyo["Claude Code"].provider == "Unresolved provider"
    assert tokyo["Codex"].provider == "mine" and tokyo["Claude Code"].model == "unknown"
    assert {(r.date, r.hour) for r in tokyo.values()} == {(dt.date(2026, 9, 2), "08")}


def test_response_rates(spark):
    noon = int(dt.datetime(2026, 9, 1, 12, tzinfo=dt.timezone.utc).timestamp())
    extra = [
        {"output_tokens": 100, "duration_ms": 2000.0, "latency_ms": 9000.0, "native_response_ms": 1.0, "first_token_ms": 300.0},
        {"output_tokens": 90, "latency_ms": 3000.0},
        {"output_tokens": 800, "native_response_ms": 4000.0, "first_token_ms": 500.0},
        {"output_tokens": 100, "duration_ms": 1.0, "status_code": 500},
        {"output_tokens": 0, "duration_ms": 1000.0},
    ]
    df = R.requests(spark, *[{"request_id": str(i), "session_key": "k", "created_at": noon, **e} for i, e in enumerate(extra)])
    rows = facts.request_rows(df, R.providers(spark, ("one", "x", "codex", "X")))
    got = sorted((r.tps, r.duration_source, r.first_token_ms) for r in facts.response_fact(rows).collect())
    assert got == [(30.0, "latency_ms", None), (50.0, "duration_ms", 300.0), (200.0, "native_log", 500.0)]
    s = facts.session_daily(rows).first()
    assert (s.requests, s.tps_count, s.tps_sum, s.tps_max) == (5, 2, 80.0, 50.0)
    assert (s.native_tps_count, s.native_tps_sum) == (1, 200.0)
    assert s.hours == {"12": s.total_tokens}


def test_first_token_validity(spark):
    values = [None, 0.0, -1.0, float("nan"), 2000.0, 250.0]
    df = R.requests(spark, *[{"request_id": str(i), "duration_ms": 1000.0, "first_token_ms": v} for i, v in enumerate(values)],
                    {"request_id": "untimed", "first_token_ms": 150.0})
    rows = facts.request_rows(df, R.providers(spark, ("one", "x", "codex", "X")))
    responses = facts.response_fact(rows)
    assert sorted(r[0] for r in responses.select("first_token_ms").collect() if r[0]) == [150.0, 250.0]
    assert responses.count() == 7


def test_monthly_leaders(spark):
    df = R.usage(
        spark, ("2026-01-01", "a", 4, "0.10"), ("2026-01-02", "a", 4, "0.10"), ("2026-01-02", "b", 6, "0.90"),
        ("2026-02-01", "a", 2, "0.30"), ("2026-02-01", "b", 20, "0.30"), ("2026-03-01", "free", 5, "0"),
    )
    got = [(r.period, r.model, r.tokens, r.share) for r in reports.cost_leaders(df).orderBy("period", "model").collect()]
    assert got[0][:3] == ("2026-01", "b", 6) and got[0][3] == pytest.approx(9 / 11)
    assert [g[:3] for g in got[1:]] == [("2026-02", "a", 2), ("2026-02", "b", 20)] and got[1][3] == 0.5


def test_totals_agree_across_grains(spark):
    df = R.requests(spark, *[{"request_id": str(i), "created_at": i * 4000, "session_key": f"s{i % 3}"} for i in range(60)])
    names = R.providers(spark, ("one", "x", "codex", "X"))
    rows = facts.request_rows(df, names)
    everything = facts.usage_rows(rows, facts.rollup_rows(R.rollups(spark, "one"), names))
    daily, hourly = facts.daily_usage(everything), facts.hourly_usage(everything)
    total = reports.grand_total(daily).first()
    assert total == reports.grand_total(hourly).first()
    assert sorted(facts.daily_from_hourly(hourly).collect()) == sorted(daily.collect())
    per_hour = facts.session_daily(rows).select(F.explode("hours").alias("h", "t")).agg(F.sum("t")).first()[0]
    assert per_hour + 971 == total.tokens
