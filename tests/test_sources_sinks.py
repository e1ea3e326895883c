import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import rows as R
from tests.test_history import covered, day_rows, machines
from usagelens import schemas, sinks
from usagelens.functions import usage as U
from usagelens.operators import facts, reports
from usagelens.session import new_path, shared_dir
from usagelens.sources import logs, saved, usage

SF = "/root/testdata/sf0.001"


def land(spark, path, drop=()):
    R.requests(spark, {"request_id": path[-1]}).drop("host", "host_order", *drop).write.parquet(f"{path}/proxy_request_logs")
    rolled = R.rollups(spark, "x").withColumns({"success_count": F.lit(3), "request_model": F.lit("m")})
    rolled.drop("host", "host_order").write.parquet(f"{path}/usage_daily_rollups")
    spark.createDataFrame([("p", "codex", "P")], "id string, app_type string, name string").write.parquet(f"{path}/providers")


def test_machines_are_read_together(spark, tmp_path):
    for name in "ab":
        land(spark, f"{tmp_path}/{name}", drop=("session_id", "duration_ms") if name == "b" else ())
    tables = usage.read_usage(spark, [usage.Source("one", f"{tmp_path}/a"), usage.Source("two", f"{tmp_path}/b")])
    got = {r.request_id: (r.host, r.host_order, r.duration_ms) for r in tables.requests.collect()}
    assert got == {"a": ("one", 0, None), "b": ("two", 1, None)}
    assert tables.rollups.count() == 2 and tables.sources.count() == 2
    assert tables.requests.schema["total_cost_usd"].dataType == schemas.MONEY


def test_missing_required_column_fails(spark, tmp_path):
    land(spark, f"{tmp_path}/a", drop=("status_code", "model"))
    with pytest.raises(ValueError, match="proxy_request_logs lacks model, status_code"):
        usage.read_usage(spark, [usage.Source("one", f"{tmp_path}/a")])
    with pytest.raises(Exception):
        usage.read_usage(spark, [usage.Source("one", f"{tmp_path}/absent")])


def test_exports_read_back(spark, tmp_path):
    noon = int(dt.datetime(2026, 9, 1, 12, tzinfo=dt.timezone.utc).timestamp())
    df = R.requests(spark, {"session_key": "k", "created_at": noon, "duration_ms": 1000.0}, {"request_id": "2", "created_at": noon + 3600, "session_key": "k"})
    rows = facts.request_rows(df, R.providers(spark, ("one", "x", "codex", "X")))
    sessions = facts.session_daily(rows).select(*schemas.columns(schemas.SESSION_DAILY))
    responses = facts.response_fact(rows).select(*schemas.columns(schemas.RESPONSES))
    daily = facts.daily_usage(rows).select(*schemas.columns(schemas.DAILY))
    sinks.write_exports({"session_daily_usage": sessions, "response_speed": responses, "daily_usage": daily}, str(tmp_path))
    back = saved.read_export(spark, str(tmp_path), "session_daily_usage")
    assert [r.hours for r in back.collect()] == [{"12": 971, "13": 971}] == [r.hours for r in sessions.collect()]
    assert sorted(map(str, saved.read_export(spark, str(tmp_path), "response_speed").collect())) == sorted(map(str, responses.collect()))
    assert saved.read_export(spark, str(tmp_path), "daily_usage").collect() == daily.collect()
    view = sinks.public_view(sessions, "session_rows")
    assert not set(view.columns) & set(sinks.PRIVATE) and "tokens" in view.columns


def test_summary(spark, tmp_path):
    daily = R.usage(spark, ("2026-01-01", "a", 5, "1"), ("2026-01-02", "b", 7, "2"))
    audit = spark.createDataFrame([("h", 3)], "host string, raw_requests long")
    sinks.write_summary(reports.grand_total(daily), audit, reports.by_model(daily), reports.by_host_app(daily), f"{tmp_path}/s")
    one = spark.read.json(f"{tmp_path}/s").first()
    assert one.tokens == 12 and [m.model for m in one.by_model] == ["a", "b"] and one.sources[0].raw_requests == 3


def test_archive_rewrites_only_changed_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    both = machines(spark, "a").withColumn("source_identity", F.sha2("host", 256))
    empty = spark.createDataFrame([], schemas.ARCHIVE)
    first = day_rows(spark, ("2026-01-01", "a", 10), ("2026-01-02", "a", 20), ("2026-01-03", "a", 30))
    sinks.write_archive(first, covered(spark), both, empty, path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "archive").glob("date=*/*.parquet")}
    assert len(files) == 3
    again = day_rows(spark, ("2026-01-01", "a", 10), ("2026-01-02", "a", 21), ("2026-01-03", "a", 30))
    sinks.write_archive(again, covered(spark), both, saved.read_archive(spark, path), path)
    kept = [f for f in files if f.exists()]
    assert [f.parent.name for f in kept] == ["date=2026-01-01"]
    entries = saved.read_archive(spark, path, both)
    assert sorted(r.tokens for r in entries.collect()) == [10, 21, 30]
    start = saved.startup_rows(entries)
    assert {r.hour for r in start.collect()} == {U.UNKNOWN_HOUR}


def test_minute_journal(spark, tmp_path):
    schema = schemas.MINUTES
    row = ("m", False, 1791396000, 1.0, 1.0, 1.0, 1.0, 0.0, 5, True, False)
    later = (*row[:8], 9, True, False)
    path, compact = str(tmp_path / "j"), str(tmp_path / "k")
    sinks.append_minutes(spark.createDataFrame([row], schema), 1, path)
    sinks.append_minutes(spark.createDataFrame([later], schema), 2, path)
    now = 1791396600.0
    assert [r.tokens for r in saved.read_minutes(spark, path, now).collect()] == [9]
    sinks.compact_minutes(spark.read.parquet(path), compact, now)
    assert spark.read.parquet(compact).count() == 1
    assert saved.read_minutes(spark, path, now + 40 * 86400).count() == 0


def test_thread_files(spark, tmp_path):
    source = '{"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}'
    spark.createDataFrame([("t", "Name", "/w", source)], "id string, name string, cwd string, source string").coalesce(1).write.json(str(tmp_path / "x"))
    part = next((tmp_path / "x").glob("part*.json"))
    folder = tmp_path / "y"
    folder.mkdir()
    (folder / "state_7.json").write_text(part.read_text())
    got = logs.read_threads(spark, str(folder), "json").first()
    assert (got.id, got.name, got.parent_id, got.version) == ("t", "Name", "p", 7)


def test_titles_from_files(spark, tmp_path):
    (tmp_path / "proj" / "conv").mkdir(parents=True)
    (tmp_path / "proj" / "conv" / "custom-title.json").write_text('{"customTitle": "Mine"}')
    (tmp_path / "index.jsonl").write_text('{"id": "a", "thread_name": "A"}\n\n{"id": "b"}\n')
    assert [(r.session_id, r.title) for r in logs.title_files(spark, str(tmp_path)).collect()] == [("conv", "Mine")]
    assert [(r.id, r.ordinal) for r in logs.read_session_index(spark, str(tmp_path)).collect()] == [("a", 0)]


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        assert lines.select("ordinal", F.get_json_object("value", "$.n").cast("long").alias("n")).where("ordinal <> n").count() == 0
        assert lines.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_source_fingerprint(spark):
    df = spark.createDataFrame([({"path": "x", "python": "a"},), ({"python": "b", "path": "x"},), ({"path": "y"},)], "m map<string,string>")
    got = [r[0] for r in df.select(U.source_fingerprint(F.col("m"))).collect()]
    assert got[0] == got[1] != got[2]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_path(spark, "a") != new_path(spark, "a")


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "unit", "model", "cost_cents", "tokens", "share"] and df.count() > 0


@pytest.mark.parametrize("name", ["monthly_leaders", "effective_requests", "session_hours", "stream_pairs", "stream_receipts", "stream_rate"])
def test_queries_agree_with_sql(spark, name):
    from tools.check_queries import compare, connect

    ok, note = compare(spark, connect(SF), SF, name)
    assert ok, note


def test_only_the_newest_state_file_counts(spark, tmp_path):
    for name, threads in (("state_2.json", [("kept", "old name"), ("gone", "left behind")]), ("state_11.json", [("kept", "new name")])):
        (tmp_path / name).write_text("\n".join(json.dumps({"id": i, "name": n, "cwd": "/w", "source": None}) for i, n in threads))
    assert [(r.id, r.name, r.version) for r in logs.read_threads(spark, str(tmp_path), "json").collect()] == [("kept", "new name", 11)]
