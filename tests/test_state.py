"""Streams with state by key: the same rows for any cut of the files, and state that ends."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.operators import live, pairing
from usagelens.session import new_path
from usagelens.sources import logs
from usagelens.streaming import follow, log_state, message_state, pairing_state, receipts_state

BOUNDARY = (
    "session_key string, response_key string, kind string, start_origin string, stamp double, received_at double, "
    "output_tokens bigint, provider string, model string"
)


def boundary(kind, stamp, session="s", response=None, tokens=10, origin="response", delay=1.0):
    done = kind == "end"
    name = pairing_state.HEARTBEAT if kind == "beat" else pairing.COMPLETED if done else pairing.CREATED
    return (session, response, name, origin, float(stamp), float(stamp) + delay, tokens if done else None, "p", "m")


def streamed(spark, rows, cuts, schema, make, name):
    """Rows as files in the order of arrival, cut at ``cuts``, one file a batch; the journal and the batches' progress."""
    landed = new_path(spark, "landed")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(landed)
    stream = make(follow.follow_files(spark, landed, schema, max_files=1))
    journal = new_path(spark, name)
    progress = follow.append_available(stream, journal, new_path(spark, name + "-progress"))
    return follow.read_journal(spark, journal, stream), progress


def paired(spark, rows, cuts):
    rows = sorted(rows, key=lambda r: r[5])
    rows.append(boundary("beat", max(r[5] for r in rows) + 7200, None))
    found, progress = streamed(spark, rows, cuts, BOUNDARY, pairing_state.pair_stream, "pairs")
    return sorted(map(str, (tuple(r) for r in found.drop("batch").collect()))), progress


def sessions(seed, count):
    """Conversations that either name ids or do not, with repeats, requests, pauses, zero and unknown output."""
    r = random.Random(seed)
    rows, at = [], 1000.0
    for k in range(count):
        at += r.choice([0.0, 0.5, 3.0, 40.0, 700.0])
        session = r.choice(["a", "b", "c"])
        response = f"{session}{int(at // 60)}" if session == "a" else None
        kind = r.choice(["start", "start", "end"])
        row = boundary(kind, at, session, response, r.choice([None, 0, 5, 9]), r.choice(["request", "response"]), r.choice([0.5, 2.0, 6.0]))
        rows += [row] * r.choice([1, 1, 1, 2])
        if k % 20 == 0:
            rows.append(boundary("end", at, None, None))
        if k % 25 == 0:
            at += r.choice([100.0, 1900.0])
    return rows


def test_pairs_are_those_of_the_batch_for_any_cut(spark):
    rows = sessions(1, 120)
    batch = pairing.pair_responses(spark.createDataFrame(rows, BOUNDARY))
    runs = [paired(spark, rows, cuts) for cuts in ([], [7, 60, 61, 130])]
    names = [f.split()[0] for f in pairing_state.OUTCOME.split(", ")]
    expected = sorted(map(str, (tuple(r) for r in batch.select(*names).collect())))
    assert runs[0][0] == expected and runs[1][0] == expected
    # After the last timers nothing is left in state but the clock of its own.
    states = [p["stateOperators"] for p in runs[1][1] if p["stateOperators"]]
    assert max(s[0]["numRowsTotal"] for s in states) > 0 and states[-1][0]["numRowsTotal"] == 0


def test_state_holds_half_an_hour_only(spark):
    """Two hours of starts in one conversation: what is kept at once is bounded by what half an hour brings."""
    rows = [boundary("start", 1000 + 300 * k, "s", f"r{k}") for k in range(24)]
    found, progress = paired(spark, rows, list(range(2, 24, 4)))
    assert len(found) == 24 and all("awaiting_usage" in f for f in found)
    most = max(s["numRowsTotal"] for p in progress for s in p["stateOperators"])
    assert most <= 4 * 12


def walked(*rows):
    """Outcomes of one conversation, each (status, start, end, id), gaps at the end included."""
    walk = pairing_state.Walk({}, {})
    names = BOUNDARY.replace(" string", "").replace(" double", "").replace(" bigint", "").split(", ")
    events = [dict(zip(names, r, strict=True)) for r in rows]
    for e in events:
        e["done"] = int(e["kind"] == pairing.COMPLETED)
    out = [o for e in sorted(events, key=pairing_state._order) for o in walk.step(e)]
    out += walk.forget(1e9)
    assert not walk.held and not walk.seen and walk.due() is None
    return [(o[8], o[5], o[6], o[1]) for o in out]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([boundary("start", 1), boundary("end", 3)], [("measured", 1.0, 3.0, None)]),
        # An id that only the completion names; one that only the start names.
        ([boundary("start", 1), boundary("end", 3, response="x")], [("measured", 1.0, 3.0, "x")]),
        ([boundary("start", 1, response="x"), boundary("end", 3)], [("measured", 1.0, 3.0, "x")]),
        # Two open ids: a completion without id belongs to neither.
        (
            [boundary("start", 1, response="x"), boundary("start", 2, response="y"), boundary("end", 3)],
            [("missing_timing", None, 3.0, None), ("awaiting_usage", None, 1.0, "x"), ("awaiting_usage", None, 2.0, "y")],
        ),
        # A sent request is refined by the response that names the id, and keeps its own start.
        (
            [boundary("start", 1, origin="request"), boundary("start", 2, response="x"), boundary("end", 4, response="x")],
            [("measured", 1.0, 4.0, "x")],
        ),
        ([boundary("start", 1, origin="request"), boundary("start", 2), boundary("end", 4)], [("measured", 1.0, 4.0, None)]),
        # Starts that overlap without ids cannot be told apart.
        ([boundary("start", 1), boundary("start", 2), boundary("end", 4)], [("missing_timing", None, 4.0, None)]),
        # Repeated exports; a second end of the same response.
        (
            [boundary("start", 1, response="x")] * 2 + [boundary("end", 4, response="x"), boundary("end", 5, response="x")],
            [("measured", 1.0, 4.0, "x")],
        ),
        # Ids that differ never pair; more than half an hour does not, either.
        ([boundary("start", 1, response="x"), boundary("end", 3, response="y")], [("missing_timing", None, 3.0, "y"), ("awaiting_usage", None, 1.0, "x")]),
        ([boundary("start", 1), boundary("end", 1802)], [("awaiting_usage", None, 1.0, None), ("missing_timing", None, 1802.0, None)]),
        ([boundary("start", 1), boundary("end", 1801)], [("measured", 1.0, 1801.0, None)]),
        ([boundary("start", 1), boundary("end", 3, delay=5.5)], [("late", 1.0, 3.0, None)]),
        ([boundary("start", 1), boundary("end", 3, tokens=0)], [("empty", None, 3.0, None)]),
        ([boundary("start", 1), boundary("end", 3, tokens=None)], [("awaiting_usage", None, 3.0, None)]),
        ([boundary("start", 3), boundary("end", 3)], [("missing_timing", None, 3.0, None)]),
    ],
)
def test_walk_over_one_conversation(rows, expected):
    assert walked(*rows) == expected


def test_batch_pairs_keep_the_ends_of_different_responses(spark):
    """Two ends of different ids in a conversation that has starts without ids are two rows."""
    rows = [boundary("start", 1), boundary("end", 3, response="x"), boundary("start", 5), boundary("end", 9, response="y")]
    found = pairing.pair_responses(spark.createDataFrame(rows, BOUNDARY))
    assert sorted((r.response_key, r.start, r.end, r.status) for r in found.collect()) == [
        ("x", 1.0, 3.0, "measured"), ("y", 5.0, 9.0, "measured")
    ]


def report(key, received, tokens, source="a", session="s", runtime="codex", basis="native_log"):
    order = ord(source) - ord("a")
    return (key, source, order, session, runtime, "p", "m", tokens, received - 2.0, received - 1.0, basis, received - 0.5, float(received))


def reports(seed, count):
    """Cumulative reports of few responses and sessions: repeats, copies that disagree and agree again, telemetry that comes late."""
    r = random.Random(seed)
    said = {}
    rows = []
    for k in range(count):
        key, source = f"e{r.randrange(12)}", r.choice("abc")
        said[key] = said.get(key, 0) + r.choice([0, 0, 5])
        basis = "codex_otel" if k > count // 3 and r.random() < 0.08 else r.choice(["native_log", "proxy_elapsed"])
        session = None if key == "e1" else f"s{int(key[1:]) % 4}"
        runtime = "claude" if int(key[1:]) % 5 == 0 else "codex"
        rows.append(report(key, 100 + k // 3 + 0.25, said[key], source, session, runtime, basis))
    return rows


def summed(changes):
    return sorted(map(tuple, receipts_state.second_totals(changes).collect()))


def test_sums_of_changes_are_the_batch_at_every_cut(spark):
    rows, cuts = reports(4, 90), [20, 45, 70]
    standing, _ = streamed(spark, rows, cuts, receipts_state.REPORT, receipts_state.follow_authority, "standing")
    assert standing.where("stands < 0").count() > 0
    # The second step reads what the first said of each batch, in turn.
    told = [tuple(r) for r in standing.orderBy("batch").drop("batch").collect()]
    sizes = [standing.where(F.col("batch") <= k).count() for k in range(len(cuts) + 1)]
    changes, _ = streamed(spark, told, sizes[:-1], receipts_state.STANDING, receipts_state.follow_credits, "changes")
    assert changes.where("output_tokens < 0").count() > 0
    for k, upto in enumerate([*cuts, len(rows)]):
        batch = live.receipt_seconds(live.receipt_deltas(spark.createDataFrame(rows[:upto], receipts_state.REPORT)))
        expected = sorted(map(tuple, batch.select("second", "output_tokens", "excluded").collect()))
        assert summed(changes.where(F.col("batch") <= k)) == expected


def test_copies_that_agree_again_restore_the_first_second():
    two = [report("e", 10, 5), report("e", 11, 6, "b")]
    assert receipts_state.credits(two) == {10: (0, 1, 1), 11: (0, 1, 1)}
    assert receipts_state.credits([*two, report("e", 12, 6)]) == {10: (5, 1, 0), 11: (1, 1, 0)}


def test_corrections_replace_earlier_totals_once(spark):
    """A batch that is written again replaces itself; the newest total of a second counts."""
    schema = receipts_state.CHANGE
    rows = [("e", 1, 5, 1, 0), ("f", 2, 7, 1, 0), ("e", 1, -5, 0, 1), ("e", 1, 5, 0, -1), ("e", 3, 1, 1, 0)]
    landed, feed, progress = (new_path(spark, n) for n in ("landed", "feed", "feed-progress"))
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(landed)
    stream = receipts_state.follow_seconds(follow.follow_files(spark, landed, schema, max_files=2))
    follow.append_available(stream, feed, progress, "update")
    journal = follow.read_journal(spark, feed, stream)
    now = lambda: sorted(map(tuple, follow.corrected(journal, ["second"]).drop("arrivals").collect()))
    assert now() == [(1, 5, False), (2, 7, False), (3, 1, False)]
    batches = journal.groupBy("batch").count().where("count > 0").count()
    assert batches > 1
    last = journal.agg(F.max("batch")).first()[0]
    again = journal.where(F.col("batch") == last).drop("batch").collect()
    spark.createDataFrame(again, journal.drop("batch").schema).write.mode("overwrite").parquet(f"{feed}/batch={last}")
    journal = follow.read_journal(spark, feed, stream)
    assert now() == [(1, 5, False), (2, 7, False), (3, 1, False)]


def test_repeats_are_found_in_bounded_state_and_the_late_kept_apart(spark):
    schema = "app_type string, request_id string, created_at bigint, output_tokens bigint"
    rows = [("a", f"r{k}", 1000 + 60 * k, k) for k in range(60)]
    rows += [("a", "r59", 1000 + 60 * 59, 59), ("a", "late", 1000, 1), ("a", "r58", 1000 + 60 * 58, 58)]
    landed = new_path(spark, "landed")
    for a in range(0, 63, 10):
        spark.createDataFrame(rows[a : a + 10], schema).coalesce(1).write.mode("append").parquet(landed)
    keys = ["app_type", "request_id"]
    stream = follow.first_within(follow.follow_files(spark, landed, schema, max_files=1), keys, "created_at", "5 minutes")
    journal, out = new_path(spark, "once-progress"), new_path(spark, "once")
    progress = follow.append_available(stream, out, journal)
    once = follow.read_journal(spark, out, stream).drop("batch")
    assert sorted(r.request_id for r in once.collect()) == sorted(f"r{k}" for k in range(60))
    behind = follow.left_behind(spark.createDataFrame(rows, schema), once, keys)
    assert [tuple(r) for r in behind.collect()] == [("a", "late", 1000, 1)]
    assert max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]) <= 30
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) >= 1


def log_lines(seed, count, inherited):
    """A log of kind A with every sort of line: turns, tools, records and their mirrors, repeated counters, other threads."""
    r = random.Random(seed)
    sid = f"00000000-0000-0000-0000-{seed:012d}"
    header = {"id": sid, "model_provider": r.choice(["acme", None]), "subagent_history_start_ordinal": inherited}
    lines = [{"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": header}]
    at, total = 0.0, 0
    for _ in range(count):
        at += r.choice([0.0, 0.25, 1.0, 2.0])
        use = {"input_tokens": 1, "output_tokens": r.choice([0, 5, 6]), "cached_input_tokens": r.choice([None, 2])}
        total += r.choice([0, 0, 7])
        call = r.choice("xyz")
        kind, payload = r.choice(
            [
                ("event_msg", {"type": "task_started"}), ("event_msg", {"type": "task_complete"}), ("compacted", {}),
                *[("response_item", {"type": "message", "role": "user"})] * 3, *[("response_item", {"type": "message", "role": "assistant"})] * 4,
                *[("response_item", {"type": "function_call", "call_id": call})] * 2, *[("response_item", {"type": "function_call_output", "call_id": call})] * 3,
                *[("token_usage_record", {"usage": use, "thread_id": r.choice([None, sid, "other"]), "response_id": r.choice([None, f"r{total}"])})] * 3,
                *[("event_msg", {"type": "token_count", "info": {"last_token_usage": use, "total_token_usage": r.choice([None, {"total_tokens": total}])}})] * 4,
                ("turn_context", {"model": r.choice(["m-1", "m-2", None])}), ("other", {}),
            ]
        )
        stamp = (dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=at)).isoformat()
        lines.append({"type": kind, "timestamp": stamp, "payload": payload})
    return sid, lines


def sample_rows(df):
    names = ["event_key", "session_key", "runtime", "provider", "model", "output_tokens", "start", "end", "basis", "status"]
    return sorted(map(str, map(tuple, df.select(*names).collect())))


def test_logs_cut_anywhere_give_the_samples_of_the_whole(spark, tmp_path):
    """Batches that end at every line of a log, in the middle of turns and between a record and its mirror."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for seed, inherited in ((1, 0), (2, 9), (3, 0), (4, 0)):
        sid, lines = log_lines(seed, 160, inherited)
        (folder / f"log-{sid}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (folder / "log-without-header.jsonl").write_text(json.dumps({"type": "compacted", "payload": {}}) + "\n")
    records = logs.read_records(spark, str(folder), schema=schemas.LOG_A)
    expected = sample_rows(logs.native_samples_a(logs.log_a_events(records, live=True)))
    assert len(expected) > 40 and any("missing_timing" in x for x in expected) and any("measured" in x for x in expected)

    # The walk itself, stopped and taken up again behind every line: its state goes through the types it is stored in.
    columns = log_state.RESPONSE.replace(" string", "").replace(" bigint", "").replace(" double", "").split(", ")
    walked = []
    lines = logs.line_events_a(records).orderBy("file", "ordinal").collect()
    for name in sorted({x.file for x in lines}):
        state, calls = tuple(log_state._NEW[f] for f in log_state._FIELDS), {}
        for x in (x for x in lines if x.file == name):
            w, calls = dict(zip(log_state._FIELDS, state, strict=True)), dict(calls)
            found = log_state.step(w, calls, x.asDict())
            assert log_state.step(dict(w), dict(calls), x.asDict()) is None  # seen already
            state = tuple(w[f] for f in log_state._FIELDS)
            if found is not None and found[5]:
                walked.append(dict(zip(columns, found, strict=True)))
    assert len(walked) == len(expected)

    # As a stream: batches of ten and more lines of every log, the last of them read twice.
    landed = new_path(spark, "lines")
    for low, high in ((0, 10), (10, 11), (11, 73), (73, 74), (74, 1000), (120, 1000)):
        records.where(F.col("ordinal").between(low, high - 1)).coalesce(1).write.mode("append").parquet(landed)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    stream = log_state.follow_samples(follow.follow_files(spark, landed, kinds, max_files=1))
    assert sample_rows(follow.run_available(stream, "samples")) == expected


def message_lines(seed, count):
    """A log of kind B: growing messages, tools, failures, stops, a sub-agent, messages without id."""
    r = random.Random(seed)
    at, lines, number = 0.0, [], 0
    for _ in range(count):
        at += r.choice([0.0, 0.5, 2.0])
        stamp = (dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=at)).isoformat()
        line = {"timestamp": stamp, "sessionId": f"talk{seed}", "agentId": r.choice([None, None, None, "helper"])}
        if r.random() < 0.4:
            blocks = [{"type": "tool_result", "tool_use_id": c} for c in r.sample("xyz", r.choice([0, 0, 1, 2]))]
            lines.append(line | {"type": "user", "message": {"content": blocks}})
            continue
        number += r.choice([0, 0, 1])
        blocks = [{"type": "tool_use", "id": c} for c in r.sample("xyz", r.choice([0, 0, 0, 1, 2]))]
        message = {"content": blocks, "id": r.choice([f"m{seed}-{number}"] * 6 + [None, ""]), "model": r.choice(["c-1", "c-2"])}
        message["usage"] = {"output_tokens": r.choice([None, 0, 3, 9, 40])}
        message["stop_reason"] = r.choice([None, None, "end_turn"])
        lines.append(line | {"type": "assistant", "message": message, "isApiErrorMessage": r.random() < 0.1})
    return lines


def test_growing_messages_cut_anywhere_are_those_of_the_whole(spark, tmp_path):
    folder = tmp_path / "talks"
    folder.mkdir()
    for seed in (1, 2, 3):
        (folder / f"talk{seed}.jsonl").write_text("\n".join(map(json.dumps, message_lines(seed, 150))) + "\n")
    records = logs.read_records(spark, str(folder), schema=schemas.LOG_B)
    expected = sample_rows(logs.native_samples_b(logs.log_b_events(records)))
    assert len(expected) > 60 and any("missing_timing" in x for x in expected) and any("measured" in x for x in expected)
    landed = new_path(spark, "lines")
    for low, high in ((0, 7), (7, 8), (8, 61), (61, 1000), (100, 1000)):
        records.where(F.col("ordinal").between(low, high - 1)).coalesce(1).write.mode("append").parquet(landed)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    stream = message_state.follow_messages(follow.follow_files(spark, landed, kinds, max_files=1))
    newest = follow.corrected(follow.run_available(stream, "messages"), ["session_id", "message_id"])
    assert sample_rows(logs.keyed_samples_b(newest)) == expected


class Lists:
    """State of one group without a stream: lists by name, and how often they were called."""

    def __init__(self):
        self.lists, self.calls, self.timers = {}, 0, []

    def getListState(self, name, schema):
        owner = self

        class State:
            def get(self):
                owner.calls += 1
                return iter(list(owner.lists.get(name, [])))

            def put(self, values):
                owner.calls += 1
                owner.lists[name] = list(values)

            def clear(self):
                owner.calls += 1
                owner.lists[name] = []

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_responses_of_a_group_share_their_calls_of_state():
    handle, step = Lists(), receipts_state.Credits(600)
    step.init(handle)
    rows = [Row(*receipts_state.FIELDS, "stands", "told_at")(*report(f"e{k}", 10 + k % 7, k + 1), 1, 10.0 + k % 7) for k in range(1000)]
    assert sum(r.output_tokens for r in step.handleInputRows((0,), iter(rows), None)) == 500_500
    assert handle.calls <= 7 and len(handle.lists["reports"]) == 1000


def test_a_group_forgets_only_what_was_not_seen_for_long():
    handle, step = Lists(), receipts_state.Credits(600)
    step.init(handle)
    fields = Row(*receipts_state.FIELDS, "stands", "told_at")
    list(step.handleInputRows((0,), iter([fields(*report("a", 10, 1), 1, 10.0), fields(*report(None, 50, 3), 1, 50.0)]), None))
    assert handle.timers == [610_001]
    list(step.handleExpiredTimer((0,), Clock(610_000), None))
    assert {v[0] for v in handle.lists["reports"]} == {"a", None}
    list(step.handleExpiredTimer((0,), Clock(610_001), None))
    assert {v[0] for v in handle.lists["reports"]} == {None} and handle.timers[-1] == 650_001
    assert [(r.event_key, r.output_tokens) for r in step.handleInputRows((0,), iter([fields(*report(None, 60, 5), 1, 60.0)]), None)] == [(None, 2)]
    list(step.handleExpiredTimer((0,), Clock(10**9), None))
    assert handle.lists["reports"] == handle.lists["said"] == handle.lists["seen"] == []
