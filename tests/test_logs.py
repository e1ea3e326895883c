import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException

from usagelens import schemas
from usagelens.operators import enrich, intervals
from usagelens.sources import logs

SID = "0f0e0d0c-1a2b-4c3d-8e9f-a0b1c2d3e4f5"
BASE = 1_760_400_000
SPENT = {"input_tokens": 210, "cached_input_tokens": 50, "output_tokens": 33}


def record(at, kind, **payload):
    """One log line ``at`` seconds after the session began."""
    return {"timestamp": dt.datetime.fromtimestamp(BASE + at, dt.timezone.utc).isoformat(), "type": kind, "payload": payload}


def asked(at):
    return record(at, "response_item", type="message", role="user")


def said(at):
    return record(at, "response_item", type="message", role="assistant")


def tool_called(at, call):
    return record(at, "response_item", type="function_call", call_id=call)


def tool_answered(at, call):
    return record(at, "response_item", type="function_call_output", call_id=call)


def metered(at, spent=SPENT, **more):
    return record(at, "token_usage_record", usage=spent, **more)


def counted(at, spent=SPENT, **more):
    return record(at, "event_msg", type="token_count", info={"last_token_usage": spent, **more})


def turn(at, what):
    return record(at, "event_msg", type=what)


def write_log(folder, records, sid=SID, tail=""):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(r) for r in [record(0, "session_meta", id=sid, cwd="/w/P", model_provider="acme"), *records]]
    (folder / f"rollout-{sid}.jsonl").write_text("\n".join(lines) + "\n" + tail)
    return str(folder)


def durations(spark, path, live=False):
    records = logs.read_records(spark, path, schema=schemas.LOG_A)
    rows = intervals.response_intervals(logs.log_a_events(records, live), live=live, chunk=3)
    return intervals.counted_intervals(rows).orderBy("ordinal")


def test_waiting_for_a_tool_is_no_response_time(spark, tmp_path):
    # Asked at 20, a tool called at 27.5, answered at 300, the rest said at 304: 7.5 s and 4 s of responses.
    records = [asked(20), tool_called(27.5, "grep"), metered(27.6), tool_answered(300, "grep"), counted(300.1), said(304), metered(304.2), counted(305)]
    got = [r.duration_ms for r in durations(spark, write_log(tmp_path / "a", records)).collect()]
    assert got == [pytest.approx(7500), pytest.approx(4000)]


def test_a_pause_between_turns_is_no_response_time(spark, tmp_path):
    records = [asked(5), said(6.25), counted(6.5), turn(7, "task_complete"), asked(40_000), said(40_009), counted(40_010)]
    got = [r.duration_ms for r in durations(spark, write_log(tmp_path / "a", records)).collect()]
    assert got == [pytest.approx(1250), pytest.approx(9000)]


def ledger(spark, *seconds, **extra):
    rows = [
        (str(i), SID, BASE + s, SPENT["input_tokens"], extra.get("output", SPENT["output_tokens"]), SPENT["cached_input_tokens"], "codex_session")
        for i, s in enumerate(seconds)
    ]
    return spark.createDataFrame(
        rows, "request_id string, session_id string, created_at long, input_tokens long, output_tokens long,"
        " cache_read_tokens long, data_source string")


def matched(spark, path, rows):
    timed = enrich.attach_native_timing(rows, durations(spark, path))
    return [r.native_response_ms for r in timed.orderBy("request_id").collect()]


def test_a_ledger_row_needs_the_second_and_the_counts_of_one_report(spark, tmp_path):
    path = write_log(tmp_path / "a", [asked(30), said(36), counted(37)])
    assert matched(spark, path, ledger(spark, 37)) == [pytest.approx(6000)]
    assert matched(spark, path, ledger(spark, 38)) == [None]
    assert matched(spark, path, ledger(spark, 37, output=34)) == [None]
    assert matched(spark, path, ledger(spark, 37, 37)) == [None, None]


def test_two_reports_of_one_second_match_nothing(spark, tmp_path):
    path = write_log(tmp_path / "a", [asked(30), said(36), counted(37), counted(37.4), asked(50), said(52), counted(55)])
    assert matched(spark, path, ledger(spark, 37, 55)) == [None, pytest.approx(2000)]


def test_an_aborted_turn_has_no_interval(spark, tmp_path):
    path = write_log(tmp_path / "a", [asked(3), turn(8, "turn_aborted"), counted(9)])
    assert [r.duration_ms for r in durations(spark, path).collect()] == [None]


def test_only_a_line_without_its_end_may_be_broken(spark, tmp_path):
    path = write_log(tmp_path / "a", [asked(3), said(4), counted(5)], tail='{"timestamp": "20')
    assert durations(spark, path).count() == 1
    for name, text in (("inside", '{"a":1}\n{oops\n{"a":2}\n'), ("last", '{"a":1}\n{oops\n')):
        folder = tmp_path / name
        folder.mkdir()
        (folder / f"x-{SID}.jsonl").write_text(text)
        with pytest.raises(PySparkException, match="Line is no JSON"):
            logs.read_records(spark, str(folder), schema=schemas.LOG_A).collect()


OPENERS, OUTPUTS, CUTS = ("input", "result"), ("output", "call"), ("reset", "start")


def expected_intervals(events):
    """(ordinal, duration) of each count, from what a response is.

    A response runs from the last opener before one of its outputs to its last
    output. It is closed by a usage record, or by a count that no usage record
    announced. An opener serves if no tool was open at it and at the output, and if
    no response was closed since that ended after it.
    """
    kinds, stamps = [e["event"] for e in events], [e["stamp"] for e in events]
    where = lambda names, a, b: [i for i in range(a, b) if kinds[i] in names]

    def cut_before(k):
        return max(where(CUTS, 0, k), default=-1) + 1

    def marker(k):
        return max(where(("usage", "count", *CUTS), 0, k), default=None)

    def closes(k):
        return kinds[k] == "usage" or (kinds[k] == "count" and not (marker(k) is not None and kinds[marker(k)] == "usage"))

    def open_calls(k):
        """Tools that were called and not answered after events up to k."""
        held = set()
        for call in {events[i]["call_id"] for i in where(("call", "result"), cut_before(k), k + 1)}:
            last = max(i for i in where(("call", "result"), cut_before(k), k + 1) if events[i]["call_id"] == call)
            held |= {call} if kinds[last] == "call" else set()
        return held

    def outputs(k):
        """Outputs of the response that closing k ends."""
        begin = max([cut_before(k), *(c + 1 for c in range(cut_before(k), k) if closes(c))])
        return where(OUTPUTS, begin, k)

    def opener(o):
        before = where(OPENERS, cut_before(o), o)
        if not before or open_calls(before[-1]) or open_calls(o - 1):
            return None
        used = [c for c in range(before[-1] + 1, o) if closes(c)]
        if any(not outputs(c) or stamps[before[-1]] <= stamps[outputs(c)[-1]] for c in used):
            return None
        return stamps[before[-1]]

    def duration(k):
        out = outputs(k)
        begun = next((opener(o) for o in out if opener(o) is not None), None)
        return (stamps[out[-1]] - begun) * 1000 if begun is not None and stamps[out[-1]] > begun else None

    found = []
    for k in where(("count",), 0, len(events)):
        m = marker(k)
        if m is not None and kinds[m] == "usage":
            found.append((events[k]["ordinal"], duration(m) if events[m]["tokens"] == events[k]["tokens"] else None))
        else:
            found.append((events[k]["ordinal"], duration(k)))
    return found


def test_intervals_against_the_definition(spark):
    import random

    random.seed(29)
    rows, expected = [], {}
    for s in range(14):
        stamp, events = 70.0, []
        for ordinal in range(1, 110):
            stamp += random.choice([0.0, 0.25, 1.0, 2.0])
            kind = random.choices(["reset", "start", "input", "result", "output", "call", "usage", "count"], [1, 1, 5, 4, 6, 4, 3, 4])[0]
            call = random.choice("xyz") if kind in ("result", "call") else None
            events.append({"ordinal": ordinal, "stamp": stamp, "event": kind, "call_id": call, "tokens": random.choice([5, 6])})
        expected.update({(f"s{s}", o): d for o, d in expected_intervals(events)})
        rows += [(f"s{s}", e["ordinal"], e["stamp"], e["event"], e["call_id"], None, None,
                  1, e["tokens"] if e["event"] in ("usage", "count") else None, 0) for e in events]
    df = spark.createDataFrame(
        rows, "session_id string, ordinal long, stamp double, event string, call_id string, model string,"
        " response_id string, input_tokens long, output_tokens long, cached_input_tokens long")
    got = intervals.counted_intervals(intervals.response_intervals(df, chunk=10)).collect()
    assert {(r.session_id, r.ordinal): r.duration_ms for r in got} == expected


def test_live_samples_of_kind_a(spark, tmp_path):
    lines = [record(10, "turn_context", model="m-7"), turn(12, "task_started"), said(19),
             metered(19.5, response_id="r-1", thread_id=SID), counted(21, total_token_usage={"total_tokens": 70}),
             counted(22, total_token_usage={"total_tokens": 70}), metered(30, thread_id="another")]
    records = logs.read_records(spark, write_log(tmp_path / "a", lines), schema=schemas.LOG_A)
    (one,) = logs.native_samples_a(logs.log_a_events(records, live=True)).collect()
    assert (one.model, one.provider, one.output_tokens, one.status) == ("m-7", "acme", SPENT["output_tokens"], "measured")
    assert (one.start - BASE, one.end - BASE) == (pytest.approx(12), pytest.approx(19))


def chat_line(at, side, message_id=None, blocks=(), tokens=None):
    stamp = dt.datetime.fromtimestamp(BASE + at, dt.timezone.utc).isoformat()
    message = {"content": list(blocks), "id": message_id, "model": "c-1", **({"usage": {"output_tokens": tokens}} if tokens else {})}
    return {"type": side, "timestamp": stamp, "sessionId": "talk", "message": message}


def test_live_samples_of_kind_b(spark, tmp_path):
    # A question, an answer that grows and calls a tool, the tool's result, its answer, and one that nobody asked for.
    lines = [chat_line(100, "user"), chat_line(104, "assistant", "x1", tokens=3), chat_line(111, "assistant", "x1", [{"type": "tool_use", "id": "call"}], tokens=44),
             chat_line(500, "user", blocks=[{"type": "tool_result", "tool_use_id": "call"}]), chat_line(508, "assistant", "x2", tokens=9),
             chat_line(900, "assistant", "x3", tokens=2), {"type": "custom-title", "sessionId": "talk", "customTitle": "Budget"}]
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "talk.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    records = logs.read_records(spark, str(folder), schema=schemas.LOG_B)
    rows = logs.native_samples_b(logs.log_b_events(records)).orderBy("end").collect()
    assert [(r.output_tokens, r.status) for r in rows] == [(44, "measured"), (9, "measured"), (2, "missing_timing")]
    assert [(round(r.start - BASE), round(r.end - BASE)) for r in rows[:2]] == [(100, 111), (500, 508)]
    assert [r.title for r in logs.custom_titles(records).collect()] == ["Budget"]
    assert {r.message_id for r in logs.assistant_messages(records).collect()} == {"x1", "x2", "x3"}


def test_header_scan(spark, tmp_path):
    records = logs.read_records(spark, write_log(tmp_path / "a", [asked(1), said(2), counted(3)]), schema=schemas.LOG_A)
    header = logs.session_headers(records).collect()
    assert [(h.session_id, h.model_provider, h.cwd) for h in header] == [(SID, "acme", "/w/P")]
    wanted = spark.createDataFrame([("nobody",)], "session_id string")
    assert logs.only_sessions(records, wanted).count() == 0


def test_desktop_titles(spark, tmp_path):
    talks = [{"cliSessionId": "a", "title": "Plan", "originCwd": "/w/one", "cwd": "/w/two"}, {"cliSessionId": "b", "title": "Notes", "cwd": "/w/two"}, {"title": "Nobody"}]
    for n, talk in enumerate(talks):
        (tmp_path / f"talk-{n}.json").write_text(json.dumps(talk, indent=1))
    got = sorted(map(tuple, logs.desktop_titles(spark, str(tmp_path)).collect()))
    assert got == [("a", "Plan", "/w/one"), ("b", "Notes", "/w/two")]
