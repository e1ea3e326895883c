"""Absolute usage reports: merged in state as one after the other, whatever the order of arrival."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import history
from usagelens.session import new_path
from usagelens.streaming import follow, usage_state

DAY = usage_state.DAY_S


def one_after_the_other(reports):
    """(count, only a lower bound) by kind and time, of reports in the order of their sequence."""
    slots, days = {}, {}
    for r in sorted(reports, key=lambda r: r["sequence"]):
        if not r["available"]:
            continue
        for at in range(r["begin"], r["end"], 60):
            new = r["slots"].get(at, 0)
            if not r["partial"]:
                slots[at] = (new, False)
            elif at not in slots or new > slots[at][0]:
                slots[at] = (new, True)
        for at, new in r["days"].items():
            days[at] = max(new, days.get(at, 0)) if r["partial"] else new
        if not r["partial"]:
            days |= {at: 0 for at in days if r["begin"] <= at < r["end"] and at not in r["days"]}
    return {("slot", at): v for at, v in slots.items()} | {("day", at): (v, True) for at, v in days.items()}


def rows_of(r):
    head = ("s", r["sequence"], r["begin"], r["end"], r["partial"], r["available"], 1000.0 + r["sequence"])
    named = [("slot", at, n) for at, n in r["slots"].items()] + [("day", at, n) for at, n in r["days"].items()]
    return [(*head, "report", None, None), *[(*head, *x) for x in named]]


def reports_of(seed, count):
    r = random.Random(seed)
    out = []
    for sequence in range(count):
        begin = 60 * r.randrange(2 * DAY // 60)
        end = begin + 60 * r.randrange(1, 40)
        if sequence % 4 == 3:
            begin, end = 0, 60 * r.randrange(1, 2 * DAY // 60)
        inside = list(range(begin, end, 60))
        slots = {at: r.randrange(9) for at in r.sample(inside, min(len(inside), r.randrange(6)))}
        days = {DAY * r.randrange(3): r.randrange(100) for _ in range(r.randrange(3))}
        out.append({"sequence": sequence, "begin": begin, "end": end, "partial": r.random() < 0.5, "available": r.random() < 0.9, "slots": slots, "days": days})
    return out


def test_merge_does_not_depend_on_the_order():
    """All orders, one report a step: the same as in the order of the sequence."""
    r = random.Random(3)
    for _ in range(150):
        told = [(k, r.random() < 0.6, r.randrange(5)) for k in range(r.randrange(1, 6))]
        expected = None
        for _, partial, n in told:
            if not partial:
                expected = (n, False)
            elif expected is None or n > expected[0]:
                expected = (n, True)
        for order in itertools.permutations(told):
            base, later = None, {}
            for step in order:
                base, later = usage_state.merge(base, later, [step])
                assert len(later) <= len(told)
            assert usage_state.known(base, later) == expected
            assert usage_state.merge(base, later, list(order)) == (base, later)  # read again


def test_zero_rows_and_named_rows_of_one_report_are_one_count():
    assert usage_state.merge(None, {}, [(4, False, 0), (4, False, 7)]) == ((4, 7), {})
    assert usage_state.merge((4, 7), {}, [(4, False, 0)]) == ((4, 7), {})
    assert usage_state.known(*usage_state.merge((4, 7), {}, [(5, True, 0), (5, True, 3)])) == (7, False)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_reports_in_order(spark, seed):
    reports = reports_of(seed, 12)
    rows = [x for r in reports for x in rows_of(r)]
    random.Random(seed).shuffle(rows)
    landed = new_path(spark, "landed")
    third = len(rows) // 3 + 1
    for at in range(0, len(rows), third):
        spark.createDataFrame(rows[at : at + third], usage_state.REPORT).coalesce(1).write.mode("append").parquet(landed)
    stream = usage_state.follow_usage(follow.follow_files(spark, landed, usage_state.REPORT, max_files=1))
    found = usage_state.known_usage(follow.run_available(stream, "usage")).collect()
    assert {(x.kind, x.at): (x.tokens, x.partial) for x in found} == one_after_the_other(reports)
    assert {x.series for x in found} == {"s"}


@pytest.mark.parametrize("partial", [False, True])
def test_batch_upserts_agree(spark, partial):
    """``upsert_usage`` and ``upsert_days`` are one more report."""
    first = {"sequence": 0, "begin": 0, "end": 600, "partial": False, "available": True, "slots": {60: 5, 120: 3}, "days": {0: 10, DAY: 20}}
    second = {"sequence": 1, "begin": 60, "end": 900, "partial": partial, "available": True, "slots": {60: 4, 120: 9}, "days": {DAY: 7, 2 * DAY: 1}}
    before, after = one_after_the_other([first]), one_after_the_other([first, second])
    old = spark.createDataFrame([(at, n, True, p) for (kind, at), (n, p) in before.items() if kind == "slot"], "slot long, tokens long, known boolean, partial boolean")
    new = spark.createDataFrame(list(second["slots"].items()), "slot long, tokens long")
    got = history.upsert_usage(old, new, 60, 900, partial).collect()
    assert {x.slot: (x.tokens, x.partial) for x in got} == {at: v for (kind, at), v in after.items() if kind == "slot"}
    day = lambda rows: spark.createDataFrame(rows, "day long, tokens long").select(F.date_from_unix_date((F.col("day") / DAY).cast("int")).alias("date"), "tokens")
    got = history.upsert_days(day([(0, 10), (DAY, 20)]), day(list(second["days"].items())), F.lit("1970-01-02").cast("date"), F.lit("1970-01-02").cast("date"), partial)
    assert sorted(x.tokens for x in got.collect()) == sorted(n for (kind, _), (n, _) in after.items() if kind == "day")
