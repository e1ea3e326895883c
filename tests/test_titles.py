"""Title sources: which state table counts, which files name a conversation, which title wins."""

from __future__ import annotations

import json

import pytest

from usagelens.operators import enrich
from usagelens.sources import logs

SF = "/root/testdata/sf0.001"


def thread(i, name, source=None):
    return json.dumps({"id": i, "name": name, "cwd": "/w", "source": source}) + "\n"


def test_states_are_ordered_by_number_and_older_ones_not_opened(spark, tmp_path):
    (tmp_path / "state_9.parquet").write_text("no table")
    (tmp_path / "state_latest.parquet").write_text("no table either")
    rows = spark.createDataFrame([("a", "New"), ("b", None)], "id string, name string")
    rows.repartition(2).write.parquet(str(tmp_path / "state_10.parquet"))
    assert logs.newest_state(spark, str(tmp_path))[0] == 10
    got = sorted((r.id, r.name, r.cwd, r.parent_id, r.version) for r in logs.read_threads(spark, str(tmp_path)).collect())
    assert got == [("a", "New", None, None, 10), ("b", None, None, None, 10)]


def test_equal_numbers_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert logs.newest_state(spark, str(tmp_path / "none")) is None
    assert logs.read_threads(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "two").mkdir()
    for name in ("a_3.json", "b_3.json", "z_x.json"):
        (tmp_path / "two" / name).write_text(thread(name, "N", "not json") + thread("kid", "K", json.dumps({"subagent": {"thread_spawn": {"parent_thread_id": ""}}})))
    got = logs.read_threads(spark, str(tmp_path / "two"), "json").collect()
    assert sorted((r.id, r.parent_id) for r in got) == [("b_3.json", None), ("kid", None)]


def test_files_that_are_no_objects_name_nothing(spark, tmp_path):
    texts = ["[1, 2]", "", "{", json.dumps({"cliSessionId": "s", "title": "T", "originCwd": "", "cwd": "/w"}, indent=2), json.dumps({"title": "T"})]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.json").write_text(text)
    assert [tuple(r) for r in logs.desktop_titles(spark, str(tmp_path)).collect()] == [("s", "T", "/w")]
    for name, text in (("p/one", '{"customTitle": "One"}'), ("p/two", '{"customTitle": "  "}'), ("p/three", "[]"), ("q/one", '{"customTitle": "Later"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "custom-title.json").write_text(text)
    got = logs.title_files(spark, str(tmp_path))
    assert sorted((r.session_id, r.title) for r in got.collect()) == [("one", "Later"), ("one", "One")]
    none = spark.createDataFrame([], "session_id string, title string")
    titled = enrich.conversation_titles(none, got, none).collect()
    assert [tuple(r) for r in titled] == [("one", "Later", "file")]


def test_which_title_wins(spark):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "session_id string, title string")

    files = spark.createDataFrame([("b", "file b", "/x/b/t"), ("c", "file c", "/x/c/t"), ("d", "file d", "/x/d/t"), ("e", " ", "/x/e/t")], "session_id string, title string, file string")
    log = rows(("a", "log a"), ("b", "log b"), ("e", "log e"), (None, "nobody"), ("f", ""))
    desktop = rows(("c", "app c"), ("c", "app c"), ("d", "app d"), ("d", "other d"), ("e", None))
    got = sorted(map(tuple, enrich.conversation_titles(log, files, desktop).collect()))
    assert got == [("a", "log a", "log"), ("b", "file b", "file"), ("c", "app c", "desktop"), ("d", "file d", "file"), ("e", "log e", "log")]
    assert enrich.conversation_titles(rows(), files.limit(0), rows()).collect() == []


@pytest.mark.parametrize("name", ["saved_titles", "thread_states"])
def test_queries_agree_with_sql(spark, name):
    from tools.check_queries import compare, connect

    ok, note = compare(spark, connect(SF), SF, name)
    assert ok, note
