"""How often the large steps deal their rows out, and how often costly expressions are written."""

import re

import pytest
from pyspark.sql import functions as F

from tests import rows as R
from tools.check_queries import compare, connect
from usagelens.functions import usage as U
from usagelens.operators import dedupe, facts, reports, sessions
from usagelens.operators.bits import with_bit
from usagelens.plans import enrichment, reports as queries
from usagelens.sources import otlp

PACKET = (
    "received_at double, resourceLogs array<struct<resource:struct<attributes:{a}>,scopeLogs:array<struct<scope:struct<attributes:{a}>,"
    "logRecords:array<struct<timeUnixNano:string,attributes:{a}>>>>>>"
).format(a=otlp._ITEMS)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def dealt(df):
    return plan(df).count("Exchange hashpartitioning")


def test_proxies_are_dealt_out_once(no_broadcast):
    rows = dedupe.effective_requests(R.requests(no_broadcast, {"request_id": "a"}))
    assert dealt(rows) == 2  # proxies and session rows


def test_unique_rows_are_not_sorted_before_they_are_dealt_out(spark):
    found = plan(dedupe.unique_requests(R.requests(spark, {"request_id": "a"})))
    assert found.count("Exchange hashpartitioning") == 1
    assert "Sort" not in found[found.index("Exchange hashpartitioning"):]


def test_session_days_and_what_is_summed_from_them_are_dealt_out_once(no_broadcast):
    rows = facts.request_rows(R.requests(no_broadcast, {"request_id": "a", "session_key": "k"}), R.providers(no_broadcast))
    held = rows.localCheckpoint()
    days = facts.session_daily(held)
    for df in (days, sessions.summarize_sessions(days), sessions.session_by(days, "date"), sessions.component_share(days), sessions.visible_sessions(days)):
        assert dealt(df) == 1


@pytest.mark.parametrize("at", [7150, 7199, 7200, 7260])
@pytest.mark.parametrize(("apart", "left"), [(-601, 2), (-600, 1), (-1, 1), (0, 1), (599, 1), (600, 1), (601, 2)])
def test_proxies_near_a_stretch_end(spark, at, apart, left):
    rows = R.requests(
        spark, {"request_id": "p", "data_source": "proxy", "created_at": at + apart}, {"request_id": "s", "created_at": at},
    )
    assert dedupe.effective_requests(rows).count() == left


def test_title_is_that_of_the_latest_request_with_one(spark):
    rows = R.requests(
        spark,
        {"request_id": "a", "session_key": "k", "created_at": 100, "session_title": "old", "project_name": "p"},
        {"request_id": "c", "session_key": "k", "created_at": 200},
        {"request_id": "b", "session_key": "k", "created_at": 200, "session_title": "new"},
    )
    day = facts.session_daily(facts.request_rows(rows, R.providers(spark))).first()
    assert (day.session_title, day.project_name, day.requests, day.hours) == ("new", "", 3, {"00": day.total_tokens})


def test_attribute_maps_are_written_once_a_level(spark):
    found = otlp.response_events(otlp.flatten_otlp(spark.createDataFrame([], PACKET)))
    # An inferred filter on the inner array may write a level once more.
    assert plan(found, "optimizedPlan").count("map_from_arrays") <= 3


def test_rows_without_a_whole_identity_stay(spark):
    empty = {"requests": 1, "total_tokens": 0, "cost_usd": "0", "model": "claude-x"}
    rows = R.sessions(spark, {**empty, "session_key": "a"}, {**empty, "session_key": None}, {**empty, "session_key": "b"}, {"session_key": "b"})
    assert sorted(str(r.session_key) for r in sessions.visible_sessions(rows).collect()) == ["None", "b", "b"]


def test_rows_are_dealt_out_by_session_before_their_keys_and_titles_are_added(no_broadcast):
    held = R.requests(no_broadcast, {"request_id": "a", "session_id": "k"}, {"request_id": "b", "session_id": None}).localCheckpoint()
    known = facts.request_rows(facts.deal_sessions(held), R.providers(no_broadcast).limit(0))
    days = facts.session_daily(known.withColumn("session_key", U.session_key(F.col("session_id"))), dealt=True)
    found = plan(days)
    below = found[found.index("Exchange hashpartitioning(host"):]
    assert found.count("Exchange hashpartitioning(host") == 1
    assert "AS session_key" not in below.split("Scan")[0].split("\n", 1)[1]
    assert days.count() == 1


REPEATS = [
    {"request_id": "a", "host": "x"}, {"request_id": "a", "host": "y", "host_order": 1}, {"request_id": "b"}, {"request_id": "c", "session_id": None},
    {"request_id": None}, {"request_id": None, "host_order": 2}, {"request_id": "a", "app_type": "gemini"},
]


def test_only_ids_that_repeat_are_dealt_out(spark):
    rows = R.requests(spark, *REPEATS)
    known = dedupe.repeated_ids(rows)
    marked = with_bit(rows, known, F.xxhash64(*dedupe.KEYS), "repeated")
    assert sorted(str(r.request_id) for r in marked.where("repeated").collect()) == ["None", "None", "a", "a"]
    plain, told = dedupe.unique_requests(rows), dedupe.unique_requests(rows, repeated=known)
    assert told.columns == plain.columns
    assert sorted(map(str, told.collect())) == sorted(map(str, plain.collect()))


def test_repeated_ids_must_still_agree(spark):
    rows = R.requests(spark, {"request_id": "a"}, {"request_id": "a", "host": "y", "host_order": 1, "model": "other"})
    with pytest.raises(Exception, match="Hosts disagree"):
        dedupe.unique_requests(rows, repeated=dedupe.repeated_ids(rows)).collect()


def test_sparse_proxies_cover_the_same_rows(spark):
    rows = []
    for i, apart in enumerate((-7000, -601, -600, 0, 600, 601, 7000)):
        rows.append({"request_id": f"p{i}", "data_source": "proxy", "created_at": 50_000 + apart, "output_tokens": 100 + i})
        rows.append({"request_id": f"s{i}", "data_source": "codex_session", "created_at": 50_000, "output_tokens": 100 + i})
    rows.append({"request_id": "far", "data_source": "proxy", "created_at": 50_000, "output_tokens": None})
    rows.append({"request_id": "null", "data_source": "codex_session", "created_at": 50_000, "output_tokens": None})
    ledger = R.requests(spark, *rows)
    left = [sorted(r.request_id for r in dedupe.effective_requests(ledger, sparse=s).collect()) for s in (False, True)]
    assert left[0] == left[1] and "s3" not in left[0] and "s0" in left[0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of a few orders, with all a ledger is made of; some are empty requests, some have no session."""
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "lineitem": "id DIV 4 AS l_orderkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, id % 90 AS l_partkey, id % 23 AS l_suppkey,"
        " CAST(id % 7 + 1 AS DOUBLE) AS l_quantity, CAST(id AS DOUBLE) AS l_extendedprice, date_add(DATE'1998-03-02', CAST(id % 5 AS INT)) AS l_shipdate",
        "orders": "id AS o_orderkey, id % 40 AS o_custkey, date_add(DATE'1998-03-02', CAST(id % 5 AS INT)) AS o_orderdate, CAST(id AS DOUBLE) AS o_totalprice",
        "supplier": "id AS s_suppkey, CAST(id % 5 AS INT) AS s_nationkey",
        "nation": "CAST(id AS INT) AS n_nationkey, concat('N', id) AS n_name",
    }
    for name, n in (("lineitem", 4000), ("orders", 1000), ("supplier", 400), ("nation", 5)):
        spark.range(0, n, 1, 1).createOrReplaceTempView("numbers")
        spark.sql(f"SELECT {made[name]} FROM numbers").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def small_broadcast(spark):
    """What is small by its true size may be sent, not what only its estimate makes large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_coverage_deals_sessions_out_once(no_broadcast):
    empty = {"requests": 1, "total_tokens": 0, "cost_usd": "0", "model": "claude-x"}
    rows = R.sessions(
        no_broadcast, {**empty, "session_key": "hidden"}, {**empty, "session_key": "both"}, {"session_key": "both", "project_key": ""},
        {"session_key": "c", "project_key": None}, {"session_key": "d"},
    ).localCheckpoint()
    daily = R.usage(no_broadcast, ("2026-01-01", "m", 900, "0"), ("2026-01-02", "m", 50, "0")).localCheckpoint()
    found = reports.coverage(daily, sessions.judged_sessions(rows))
    assert dealt(found) == 1 and plan(found).count("Window") == 1
    assert found.first().asDict() == {
        "all_tokens": 950, "session_tokens": 300, "session_requests": 7, "project_tokens": 100, "hidden_requests": 1,
        "tokens_without_session": 650, "requests_without_session": 0, "tokens_without_project": 850,
    }


def test_coverage_moves_rows_to_their_session_as_they_are(small_broadcast, tables):
    found = plan(queries.coverage(small_broadcast, tables))
    of_names = re.findall(r"Exchange hashpartitioning\((?:host#\d+, provider_id|_key#)", found)
    assert not of_names  # neither names nor evidence deal the ledger out
    assert found.count("REPARTITION_BY_NUM") == 1  # the session rows
    same, note = compare(small_broadcast, connect(tables), tables, "coverage")
    assert same, note


def test_messages_and_requests_are_dealt_out_by_id_only(small_broadcast, tables):
    found = plan(enrichment.project_agreement(small_broadcast, tables))
    keys = re.findall(r"Exchange hashpartitioning\((.*?)#", found)
    assert keys == ["request_id", "request_id"]  # Claude's requests and the messages; what is known of sessions is sent
    for name in ("project_agreement", "message_link", "session_title_join", "provider_header", "enrichment_audit"):
        same, note = compare(small_broadcast, connect(tables), tables, name)
        assert same, (name, note)
