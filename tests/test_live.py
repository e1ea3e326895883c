import json

import pytest
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.functions import usage as U
from usagelens.operators import live, pairing, quality
from usagelens.sources import otlp
from usagelens.streaming import follow, jobs

SAMPLE = [p.split()[0].strip("`") for p in schemas.SAMPLES.split(", ")]
DEFAULT = dict(source="a", source_order=0, event_key="e", session_key="s", runtime="codex", provider="p", model="m",
               output_tokens=100, start=90.0, end=100.0, basis="native_log", sampled_at=100.0, received_at=100.0)


def samples(spark, *rows):
    return spark.createDataFrame([tuple({**DEFAULT, **r}[n] for n in SAMPLE) for r in rows], schemas.SAMPLES)


def totals(df, second):
    rows = live.live_totals(live.session_rates(live.rate_cells(live.rebased(df))))
    return rows.where(F.col("second") == second).first()


def test_rate_spreads_output_over_the_response(spark):
    df = samples(spark, {"output_tokens": 500})
    assert totals(df, 100).total_tps == pytest.approx(50) and totals(df, 101).total_tps == pytest.approx(40)
    assert totals(df, 105) is None


def test_average_per_session(spark):
    df = samples(spark, *[{"event_key": k, "session_key": k, "output_tokens": n} for k, n in (("x", 600), ("y", 400), ("z", 200))])
    row = totals(df, 100)
    assert (row.total_tps, row.average_tps, row.contributing_sessions) == (pytest.approx(120), pytest.approx(40), 3)
    row = totals(samples(spark, {"event_key": "x"}, {"event_key": "y", "session_key": None}), 100)
    assert row.average_tps is None and row.total_tps == pytest.approx(20)


def test_clock_offsets_cancel(spark):
    df = samples(spark, {"sampled_at": 100.0, "received_at": 5100.0, "output_tokens": 500})
    assert totals(df, 5100).total_tps == pytest.approx(50)


def test_unknown_is_not_zero(spark):
    none = live.live_totals(live.session_rates(live.rate_cells(samples(spark, {}))))
    seconds = spark.createDataFrame([(7, True, False), (8, True, True), (9, False, False)], "second long, fresh boolean, partial boolean")
    got = {r.second: r.total_tps for r in live.observed_totals(none, seconds).collect()}
    assert got == {7: 0.0, 8: None, 9: None}


def test_canonical_copies(spark):
    df = samples(
        spark, {"event_key": "a"}, {"event_key": "a", "source": "b", "source_order": 1, "basis": "proxy_elapsed", "session_key": None},
        {"event_key": "b"}, {"event_key": "b", "source": "b", "source_order": 1, "output_tokens": 101},
        {"event_key": "c"}, {"event_key": "c", "source": "b", "source_order": 1, "session_key": "other"},
        {"event_key": "d", "session_key": "t"}, {"event_key": "d2", "session_key": "t", "basis": "codex_otel"},
    )
    got = {r.event_key: (r.source, r.conflict) for r in live.canonical_responses(df).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("a", True), "d2": ("a", False)}


def test_receipts_count_new_output_once(spark):
    df = samples(
        spark, {"received_at": 200.2}, {"source": "b", "source_order": 1, "received_at": 200.2},
        {"received_at": 201.2, "output_tokens": 150}, {"source": "b", "source_order": 1, "received_at": 201.2, "output_tokens": 150},
        {"event_key": "child", "session_key": "child", "received_at": 201.2, "output_tokens": 40},
    )
    got = {r.second: r.output_tokens for r in live.receipt_seconds(live.receipt_deltas(df)).collect()}
    assert got == {200: 100, 201: 90}


def test_trailing_average(spark):
    df = samples(spark, {"received_at": 200.2, "output_tokens": 15000})
    got = {r.second: r.average_tps for r in live.receipt_average(live.receipt_deltas(df)).collect()}
    assert got[201] == 50.0 and got[500] == 50.0 and 501 not in got and 200 not in got


def test_receipt_bins(spark):
    ticks = spark.createDataFrame([("m", t, True, "complete") for t in (10.1, 11.1, 12.1, 20.0, 21.0)],
                                  "series string, tick double, fresh boolean, status string")
    seconds = spark.createDataFrame([(11, 5, False), (15, 7, False)], "second long, output_tokens long, excluded boolean")
    got = {r.second: (r.output_tokens, r.observed, r.partial) for r in live.finished_bins(seconds, live.watched_seconds(ticks).drop("series")).collect()}
    assert got == {10: (0, True, False), 11: (5, True, False), 15: (7, False, True), 20: (0, True, False)}


def landed(spark, folder, *rows):
    """One file a row, in order of arrival."""
    for n, row in enumerate(rows):
        samples(spark, row).coalesce(1).write.mode("append").parquet(str(folder / "all"))
    return str(folder / "all")


ARRIVALS = [
    {"event_key": "a", "received_at": 500.0, "end": 499.0, "start": 498.0, "sampled_at": 500.0},
    {"event_key": "b", "received_at": 900.0, "end": 899.0, "start": 898.0, "sampled_at": 900.0},
    {"event_key": "c", "received_at": 901.0, "end": 420.0, "start": 419.0, "sampled_at": 901.0},  # long over when it arrives
    {"event_key": "a", "received_at": 902.0, "end": 499.0, "start": 498.0, "sampled_at": 902.0},  # a repeat
    {"event_key": "d", "received_at": 90.5, "end": 90.0, "start": 89.0, "sampled_at": 90.5},  # an older file that lands last
]


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_streams_do_not_depend_on_batches(spark, tmp_path, files):
    path = landed(spark, tmp_path, *ARRIVALS)
    stream = follow.follow_files(spark, path, schemas.SAMPLES, max_files=files)
    journal = follow.run_available(stream, "arrivals")
    assert journal.where("batch >= 0").select("batch").distinct().count() == {1: 5, 2: 3, 1000: 1}[files]
    rated, late = jobs.rates(journal)
    # Each sample in time is spread over the window in full: three of 100 tokens.
    assert rated.agg(F.sum("tps")).first()[0] == pytest.approx(3 * 100 / 1)
    assert [tuple(r) for r in late.collect()] == [("codex", 1, 100)]
    assert {r.second: r.output_tokens for r in jobs.receipts(journal).collect()} == {500: 100, 900: 100, 901: 100, 90: 100}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path = landed(spark, tmp_path, *ARRIVALS[:2])
    journal, progress = str(tmp_path / "journal"), str(tmp_path / "progress")
    for rows, expected in (((), 2), ((), 2), (ARRIVALS[2:], 5)):
        landed(spark, tmp_path, *rows)
        stream = follow.follow_files(spark, path, schemas.SAMPLES)
        follow.append_available(stream, journal, progress)
        assert follow.read_journal(spark, journal, stream).count() == expected


def test_an_empty_folder_is_an_empty_journal(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert follow.run_available(follow.follow_files(spark, str(tmp_path / "none"), schemas.SAMPLES), "none").count() == 0


def test_first_arrivals_ignore_batches(spark):
    rows = [("k", 5.0, 1, 7), ("k", 4.0, 2, 3), ("k", 4.0, 1, 0), ("l", 1.0, 1, 0)]
    journal = spark.createDataFrame(rows, "key string, at double, value int, batch int")
    assert sorted(map(tuple, follow.first_arrivals(journal, ["key"], "at").collect())) == [("k", 4.0, 1), ("l", 1.0, 1)]


def test_source_status(spark):
    beats = spark.createDataFrame([("a", 99.0, "complete", None), ("b", 90.0, "complete", None), ("c", 99.0, "complete", "bad")],
                                  "source string, received_at double, coverage string, error string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    rows = live.source_status(beats, known, F.lit(100.0))
    assert {r.source: r.status for r in rows.collect()} == {"a": "fresh", "b": "stale", "c": "error", "d": "initializing"}
    assert live.overall_status(rows).first().status == "partial"
    assert live.overall_status(rows.where("source = 'a'")).first().status == "complete"
    assert live.overall_status(rows.where("source = 'b'")).first().status == "unavailable"


EVENTS = ("event_id long, session_key string, response_key string, kind string, start_origin string, stamp double,"
          " received_at double, output_tokens long, provider string, model string")


def events(spark, *rows):
    out = []
    for i, (session, response, kind, stamp, tokens, *rest) in enumerate(rows):
        full = {"c": "response.created", "d": "response.completed", "q": "response.created"}[kind]
        received = rest[0] if rest else stamp + 1.0
        out.append((i, session, response, full, "request" if kind == "q" else "response", float(stamp), float(received), tokens, "p", "m"))
    return spark.createDataFrame(out, EVENTS)


def outcomes(spark, *rows):
    got = pairing.pair_responses(events(spark, *rows)).collect()
    return sorted((r.status, r.start, r.end, r.output_tokens) for r in got)


def test_repeated_exports_are_one(spark):
    rows = [("s", "r", "c", 40, None)] * 2 + [("s", "r", "d", 52, 90)] * 3
    assert outcomes(spark, *rows) == [("measured", 40.0, 52.0, 90)]


HALF_HOUR = 1800


@pytest.mark.parametrize(
    "rows,expected",
    [
        # Without ids: a start and the end behind it.
        ([("s", None, "c", 20, None), ("s", None, "d", 33, 8)], [("measured", 20.0, 33.0, 8)]),
        # Two open starts cannot be told apart, unless the first is the request.
        ([("s", None, "c", 20, None), ("s", None, "c", 22, None), ("s", None, "d", 33, 8)], [("missing_timing", None, 33.0, 8)]),
        ([("s", None, "q", 20, None), ("s", None, "c", 22, None), ("s", None, "d", 33, 8)], [("measured", 20.0, 33.0, 8)]),
        ([("s", None, "c", 20, None), ("s", None, "c", 20, None), ("s", None, "d", 33, 8)], [("measured", 20.0, 33.0, 8)]),
        # An end alone, without a count, without output; a start alone.
        ([("s", None, "d", 33, 8)], [("missing_timing", None, 33.0, 8)]),
        ([("s", None, "c", 20, None), ("s", None, "d", 33, None)], [("awaiting_usage", None, 33.0, None)]),
        ([("s", None, "c", 20, None), ("s", None, "d", 33, 0)], [("empty", None, 33.0, 0)]),
        ([("s", None, "c", 20, None)], [("awaiting_usage", None, 20.0, None)]),
        # An end that arrives late.
        ([("s", None, "c", 20, None), ("s", None, "d", 33, 8, 41)], [("late", 20.0, 33.0, 8)]),
        # A start is forgotten after half an hour; what follows pairs without it.
        ([("s", None, "c", 20, None), ("s", None, "d", 21 + HALF_HOUR, 8)], [("awaiting_usage", None, 20.0, None), ("missing_timing", None, 21.0 + HALF_HOUR, 8)]),
        ([("s", None, "c", 500, None), ("s", None, "c", 4000, None), ("s", None, "d", 4004, 8)],
         [("awaiting_usage", None, 500.0, None), ("measured", 4000.0, 4004.0, 8)]),
        # Ids keep overlapping responses apart, across sessions, too.
        ([("s", "x", "c", 20, None), ("s", "y", "c", 21, None), ("s", "x", "d", 33, 8), ("s", "y", "d", 35, 9)],
         [("measured", 20.0, 33.0, 8), ("measured", 21.0, 35.0, 9)]),
        ([(None, "x", "c", 20, None), ("s", "x", "d", 33, 8)], [("ambiguous_identity", None, 33.0, 8)]),
        # One side without an id pairs in the session; two different ids never pair.
        ([("s", None, "q", 20, None), ("s", "x", "d", 33, 8)], [("measured", 20.0, 33.0, 8)]),
        ([("s", "x", "c", 20, None), ("s", None, "d", 33, 8)], [("measured", 20.0, 33.0, 8)]),
        ([("s", "x", "c", 20, None), ("s", "y", "d", 33, 8)], [("awaiting_usage", None, 20.0, None), ("missing_timing", None, 33.0, 8)]),
        # Nothing names an event.
        ([(None, None, "c", 20, None)], [("ambiguous_identity", None, 20.0, None)]),
    ],
)
def test_pairing_rules(spark, rows, expected):
    got = [(status, start, end, tokens) for status, start, end, tokens in outcomes_by_end(spark, *rows)]
    assert got == expected


def outcomes_by_end(spark, *rows):
    got = pairing.pair_responses(events(spark, *rows)).collect()
    return sorted(((r.status, r.start, r.end, r.output_tokens) for r in got), key=lambda o: o[2])


def test_pairs_do_not_depend_on_chunks(spark):
    import random

    random.seed(8)
    rows = []
    for session in "uvw":
        for _ in range(70):
            kind = random.choice("ccdq")
            at = random.randrange(0, 30_000) / 2
            rows.append((session, None, kind, at, random.choice([None, 0, 4]) if kind == "d" else None, at + random.choice([1, 9])))
    df = events(spark, *rows)
    whole = sorted(map(str, pairing.pair_responses(df, chunk_s=100_000).collect()))
    assert whole == sorted(map(str, pairing.pair_responses(df, chunk_s=100).collect()))
    # Every end and every start that no end took is there once.
    ends = {(r.session_key, r.stamp, r.output_tokens) for r in df.where("kind = 'response.completed'").collect()}
    got = pairing.pair_responses(df).collect()
    assert {(r.session_key, r.end, r.output_tokens) for r in got if (r.session_key, r.end, r.output_tokens) in ends} == ends


def attribute(key, **value):
    return {"key": key, "value": value}


def packet(*records, resource=(), scope=()):
    return {"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [
        {"scope": {"attributes": list(scope)}, "logRecords": [
            {"timeUnixNano": str(n), "attributes": list(a)} for n, *a in records]}]}]}


def test_flatten_packets(spark, tmp_path):
    kind = lambda k: attribute("event.kind", stringValue=k)
    name = lambda k: attribute("event.name", stringValue=k)
    sid = attribute("conversation.id", stringValue="s")
    body = packet(
        (2_000_000_000, kind("response.created"), attribute("model", stringValue="inner")),
        (6_000_000_000, kind("response.completed"), attribute("output_token_count", intValue="300")),
        (7_000_000_000, kind("response.completed"), attribute("output_tokens", intValue="-3")),
        (7_000_000_000, kind("other")),
        (9_000_000_000, name("codex.websocket_request"), attribute("duration_ms", intValue="500")),
        (9_000_000_000, name("codex.websocket_request"), attribute("duration_ms", intValue="500"), attribute("success", boolValue=False)),
        (9_000_000_000, kind("response.created"), attribute("model", stringValue="x"), attribute("model", stringValue="y")),
        (0, kind("response.created"), attribute("event.timestamp", stringValue="1970-01-01T00:00:03Z")),
        (0, kind("response.created"), attribute("event.timestamp", stringValue="1970-01-01T00:00:03")),
        (900_000_000_000, kind("response.created")),
        resource=[sid, attribute("model", stringValue="outer")], scope=[attribute("model", stringValue="https://x")],
    )
    lost = packet((2_000_000_000, kind("response.created")))
    (tmp_path / "a.json").write_text("\n".join(json.dumps(p) for p in (body, lost)))
    packets = spark.read.schema(schemas.OTLP).json(str(tmp_path)).withColumn("received_at", F.lit(10.0))
    rows = otlp.flatten_otlp(packets)
    reasons = {r.reason: r.records for r in otlp.ingest_counts(rows).collect()}
    assert reasons == {"event": 4, "invalid": 4, "other": 1, "failed": 1, "missing_identity": 1}
    good = otlp.response_events(rows).orderBy("stamp", "kind").collect()
    assert [(r.stamp, r.start_origin, r.output_tokens, r.model) for r in good] == [
        (2.0, "response", None, "inner"), (3.0, "response", None, "Unknown"), (6.0, "response", 300, "Unknown"), (8.5, "request", None, "Unknown")]


def test_quarantine(spark):
    df = samples(spark, {}, {"output_tokens": 0}, {"end": 90.0}, {"end": 102.0}, {"session_key": ""}, {"start": float("nan")})
    good, bad = quality.quarantine(df, quality.sample_rules())
    assert good.count() == 1 and bad.count() == 5
    with pytest.raises(Exception, match="Invalid sample: output_tokens"):
        quality.strict(df.limit(2), quality.sample_rules(), "sample").collect()


NATIVE = "event_key string, session_key string, runtime string, provider string, model string, output_tokens long, start double, end double, basis string"
PROXY = NATIVE.replace("session_key string, ", "") + ", request_id string, session_id string"


def test_a_proxy_row_adds_what_the_log_lacks(spark):
    native = spark.createDataFrame(
        [("timed", "k", "claude", "Provider unreported", "m", 9, 11.0, 14.0, "native_log"), ("untimed", "k", "claude", "own", "m", 9, None, 30.0, "native_log")], NATIVE)
    proxy = spark.createDataFrame(
        [("timed", "claude", "Initech", "m", 9, 10.0, 15.0, "proxy_elapsed", "1", None), ("untimed", "claude", "Initech", "m", 9, 26.0, 30.0, "proxy_elapsed", "2", None),
         ("alone", "gemini", "Initech", "m", 9, None, 40.0, "proxy_elapsed", "3", None), ("logged elsewhere", "codex", "Initech", "m", 9, 1.0, 2.0, "proxy_elapsed", "4", None)],
        PROXY)
    got = {r.event_key: (r.provider, r.start, r.basis, r.status) for r in live.link_proxy(native, proxy).collect()}
    assert got == {"timed": ("Initech", 11.0, "native_log", "measured"), "untimed": ("own", 26.0, "proxy_elapsed", "measured"),
                   "alone": ("Initech", None, "proxy_elapsed", "missing_timing")}


def test_a_proxy_session_counts_only_if_known_or_marked(spark):
    opaque = lambda *parts: spark.range(1).select(U.opaque_identity(*map(F.lit, parts))).first()[0]
    native = spark.createDataFrame([("n", opaque("claude", "known"), "claude", "p", "m", 9, 1.0, 2.0, "native_log")], NATIVE)
    cases = {"a": ("claude", "known"), "b": ("claude", "guess"), "c": ("grokbuild", "grokbuild_abcdefghijkl"), "d": ("grokbuild", "grokbuild_short"),
             "e": ("claude", "e"), "f": ("claude", None)}
    proxy = spark.createDataFrame([(k, runtime, "p", "m", 9, 1.0, 2.0, "proxy_elapsed", k, session) for k, (runtime, session) in cases.items()], PROXY)
    got = {r.event_key: r.session_key for r in live.link_proxy(native, proxy).collect() if r.event_key != "n"}
    assert got == {"a": opaque("claude", "known"), "b": None, "c": opaque("grokbuild", "abcdefghijkl"), "d": None, "e": None, "f": None}


def test_activity_needs_a_reading_from_log_or_telemetry(spark):
    trace = spark.createDataFrame([(k, 95.0) for k in "abcde"] + [("old", -50.0)], "session_key string, stamp double")
    read = samples(spark, {"session_key": "a", "end": 96.0}, {"session_key": "b", "end": 96.0, "basis": "proxy_elapsed"},
                   {"session_key": "c", "end": 96.0, "runtime": "claude"}, {"session_key": "d", "end": 90.0})
    telemetry = spark.createDataFrame([("e", 97.0)], "session_key string, stamp double")
    assert sorted(r.session_key for r in live.activity_gaps(trace, read, 98.0, telemetry).collect()) == ["b", "c", "d"]


def test_issues_keep_the_order_they_were_seen_in(spark):
    rows = [("m", "zebra", 1), ("m", "apple", 2), ("m", "zebra", 3), ("n", "x", 0)]
    df = spark.createDataFrame(rows, "source string, issue string, seen int")
    assert {r.source: r.issues for r in live.ordered_issues(df, ["source"], "seen").collect()} == {"m": ["zebra", "apple"], "n": ["x"]}


def test_every_session_has_a_place_in_its_second(spark):
    df = spark.createDataFrame([(s, "codex", f"c{i}", f"c{i}", float(i % 4)) for s in (1, 2) for i in range(30)],
                               "second long, runtime string, contributor string, session_key string, tps double")
    got = live.ranked_sessions(df).collect()
    assert len(got) == 60 and {(r.second, r.place) for r in got} == {(s, p) for s in (1, 2) for p in range(1, 31)}
