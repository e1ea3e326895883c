"""The running average in state: the batch's rows for any cut, late corrections, silence behind the last arrival."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import live
from usagelens.session import new_path
from usagelens.streaming import average_state, follow

ARRIVAL = "series string, received_at double, tokens bigint"


def averaged(spark, rows, size, late_s=600):
    """Arrivals in files of ``size`` rows, a batch each, and a heartbeat long after."""
    landed, sums = new_path(spark, "landed"), new_path(spark, "sums")
    beat = max(t for _, t, _ in rows) + 10_000.0
    for part in [*[rows[k : k + size] for k in range(0, len(rows), size)], [("", beat, None)]]:
        spark.createDataFrame(part, ARRIVAL).coalesce(1).write.mode("append").parquet(landed)
    arrivals = follow.follow_files(spark, landed, ARRIVAL, max_files=1)
    follow.append_available(arrivals, sums, new_path(spark, "progress"), reduce=average_state.by_second)
    like = average_state.by_second(spark.createDataFrame([], ARRIVAL))
    journal, progress = new_path(spark, "averages"), new_path(spark, "progress")
    stream = average_state.follow_average(follow.follow_journal(sums, like, max_files=1), late_s=late_s)
    batches = follow.append_available(stream, journal, progress)
    return follow.read_journal(spark, journal, stream), batches


def expected(spark, rows):
    """``live.receipt_average`` of each series."""
    out = {}
    for series in {s for s, _, _ in rows}:
        deltas = spark.createDataFrame([(t, n, False) for s, t, n in rows if s == series], "received_at double, delta bigint, excluded boolean")
        out |= {(series, r.second): (r.output_tokens, r.average_tps) for r in live.receipt_average(deltas).collect()}
    return out


@pytest.mark.parametrize("size", [7, 200])
def test_averages_are_those_of_the_batch(spark, size):
    """Pauses longer than the window, arrivals right on a second, a file that comes up to 90 seconds late."""
    r = random.Random(size)
    rows, at = [], 5000.0
    for _ in range(60):
        at += r.choice([0.0, 0.25, 1.0, 40.0, 170.0, 350.0, 1000.0])
        rows.append((r.choice("ab"), at - r.choice([0.0, 0.0, 0.5, 90.0]), r.choice([1, 5, 100])))
    found, batches = averaged(spark, rows, size)
    got = {(x.series, x.second): (x.output_tokens, x.average_tps) for x in average_state.averages(found).collect()}
    want = expected(spark, rows)
    assert {k: v for k, v in got.items() if k in want} == want
    # What is more are zeros, one behind each stretch.
    rest = {k: v for k, v in got.items() if k not in want}
    assert rest and all(v == (0, 0.0) and (k[0], k[1] - 1) in want for k, v in rest.items())
    assert max(s["numRowsTotal"] for b in batches for s in b["stateOperators"]) < 200


def test_corrections_give_their_seconds_again():
    ring = {2 * 100 + 1: 30, 2 * 102: 12}
    before = dict(average_state.totals(ring, 0, 1000, 300))
    assert (before[100], before[101], before[102], before[400], before[401], before[402]) == (30, 30, 42, 42, 12, 0)
    assert dict(average_state.totals(ring | {2 * 100 + 1: 10}, 400, 401, 300)) == {400: 22, 401: 12}
    assert dict(average_state.totals({}, 0, 9, 300)) == {}
    assert dict(average_state.totals({2 * 5 + 1: 0}, 0, 9, 3)) == {5: 0, 6: 0, 7: 0, 8: 0, 9: 0}


def test_state_of_a_silent_series_ends(spark):
    found, batches = averaged(spark, [("a", 1000.0, 5), ("a", 1000.5, 6)], 1)
    assert found.agg(F.max("second")).first()[0] == 1301
    assert batches[-1]["stateOperators"][0]["numRowsTotal"] == 0
