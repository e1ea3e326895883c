"""Counted output as a stream of signed changes.

Reports are cumulative and come again and again, from several sources. Two steps
keep state; between them stands a journal:

1. ``follow_authority``, by session: once a session has telemetry, its other Codex
   reports do not count. Those that were let through are withdrawn.
2. ``follow_credits``, by response: what the reports that stand say about each second
   of arrival. Whatever changes that - more output, copies that disagree or agree
   again, reports that are withdrawn - comes out as a difference in the second the
   output first arrived in.

So the sums of all changes are, after every batch, what ``live.receipt_seconds`` gives
over the reports so far, as long as reports of one response or session are no
further apart than ``KEEP_S``. A timer drops what was not touched for so long, by the
clock of arrivals. Sessions and responses are many and small, so they share groups.
"""

from __future__ import annotations

import math
from collections.abc import Generator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from usagelens.operators.live import OTLP_BASIS
from usagelens.streaming.state import Shared, arriving, group_of, keep_state

#: Fixed value: seconds after which a response or session that was not seen is forgotten.
KEEP_S = 600

REPORT = (
    "event_key string, source string, source_order int, session_key string, runtime string, provider string, model string, "
    "output_tokens bigint, start double, end double, basis string, sampled_at double, received_at double"
)
FIELDS = [f.split()[0] for f in REPORT.split(", ")]
#: Reports that stand (1) or no longer do (-1), and when that was known.
STANDING = REPORT + ", stands int, told_at double"
#: Changes of one response in one second: counted output, and how many of its arrivals are there and excluded.
CHANGE = "event_key string, second bigint, output_tokens bigint, arrivals bigint, excluded bigint"
_STANDING = Row(*FIELDS, "stands", "told_at")
_CHANGE = Row("event_key", "second", "output_tokens", "arrivals", "excluded")


def _identity(report: tuple) -> str:
    return "\x1f".join(map(repr, report))


class Authority(Shared):
    """By session: whether telemetry speaks for it, and the reports let through before it did."""

    KEY = "session_key"
    LISTS = {"told": "yes int", "passed": REPORT}

    def __init__(self, keep_s: float = KEEP_S):
        super().__init__(keep_s)

    def step(self, key, rows, held) -> Generator[Row, None, float]:
        reports = [tuple(r[f] for f in FIELDS) for r in rows]
        basis, received = FIELDS.index("basis"), FIELDS.index("received_at")
        speaks = [r for r in reports if r[basis] == OTLP_BASIS]
        others = [r for r in reports if r[basis] != OTLP_BASIS]
        now = max(r[received] for r in reports)
        if speaks:
            for report in held["passed"]:
                yield _STANDING(*report, -1, now)
            held["passed"], held["told"] = [], [(1,)]
        for report in speaks:
            yield _STANDING(*report, 1, now)
        if not held["told"]:
            passed = {_identity(report) for report in held["passed"]}
            for report in dict.fromkeys(others):
                identity = _identity(report)
                if identity not in passed:
                    passed.add(identity)
                    held["passed"].append(report)
                    yield _STANDING(*report, 1, now)
        return now


def credits(reports: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """(counted output, arrivals, excluded ones) by second, of the reports of one response."""
    rows = [dict(zip(FIELDS, r, strict=True)) for r in reports]
    last: dict[tuple, dict] = {}
    rest = [f for f in FIELDS if f not in ("source", "received_at", "output_tokens")]
    order = lambda r: [(r[f] is not None, r[f]) for f in ("received_at", "output_tokens", *rest)]
    for r in rows:
        source = (r["source"], r["source_order"])
        if source not in last or order(r) > order(last[source]):
            last[source] = r
    told = {(r["runtime"], r["output_tokens"]) for r in last.values()}
    sessions = {r["session_key"] for r in last.values()} - {None}
    conflict = len(told) > 1 or len(sessions) > 1
    first: dict[int, float] = {}
    for r in rows:
        n = r["output_tokens"]
        first[n] = min(first.get(n, math.inf), r["received_at"])
    known, out = 0, {}
    for at, n in sorted((at, n) for n, at in first.items()):
        if n > known:
            second = math.floor(at)
            counted, arrivals, excluded = out.get(second, (0, 0, 0))
            out[second] = (counted + (0 if conflict else n - known), arrivals + 1, excluded + conflict)
            known = n
    return out


class Credits(Shared):
    """By response: the reports that stand, and what was last said of each second."""

    KEY = "event_key"
    LISTS = {"reports": REPORT + ", copies int", "said": "second bigint, output_tokens bigint, arrivals bigint, excluded bigint"}

    def __init__(self, keep_s: float = KEEP_S):
        super().__init__(keep_s)

    def step(self, key, rows, held) -> Generator[Row, None, float]:
        reports = {_identity(v[:-1]): v for v in held["reports"]}
        said = {second: tuple(v) for second, *v in held["said"]}
        now = 0.0
        for r in rows:
            now = max(now, r["told_at"])
            report = tuple(r[f] for f in FIELDS)
            identity = _identity(report)
            # A withdrawal may be read before what it takes back; copies then stand at minus one for a while.
            copies = (reports[identity][-1] if identity in reports else 0) + r["stands"]
            if copies:
                reports[identity] = (*report, copies)
            else:
                reports.pop(identity, None)
        found = credits([v[:-1] for v in reports.values() if v[-1] > 0])
        for second in sorted(found.keys() | said.keys()):
            new, old = found.get(second, (0, 0, 0)), said.get(second, (0, 0, 0))
            if new != old:
                yield _CHANGE(key, second, *[a - b for a, b in zip(new, old, strict=True)])
        held["reports"] = list(reports.values())
        held["said"] = [(second, *v) for second, v in found.items()]
        return now


def follow_authority(samples: DataFrame, keep_s: float = KEEP_S) -> DataFrame:
    """Reports as they stand: let through, or withdrawn. Others than Codex, and those without session, pass by."""
    keep_state(samples.sparkSession)
    rows = arriving(samples.select(*FIELDS), "received_at", f"{int(keep_s)} seconds")
    bound = F.coalesce((F.col("runtime") == "codex") & F.col("session_key").isNotNull(), F.lit(False))
    judged = rows.where(bound).withColumn("group", group_of(F.col("session_key"))).groupBy("group").transformWithState(
        statefulProcessor=Authority(keep_s), outputStructType=STANDING, outputMode="Append", timeMode="EventTime"
    )
    return judged.unionByName(rows.where(~bound).select(*FIELDS, F.lit(1).alias("stands"), F.col("received_at").alias("told_at")))


def follow_credits(standing: DataFrame, keep_s: float = KEEP_S) -> DataFrame:
    """Signed changes of counted output by response and second."""
    keep_state(standing.sparkSession)
    rows = arriving(standing, "told_at", f"{int(keep_s)} seconds").withColumn("group", group_of(F.col("event_key")))
    return rows.groupBy("group").transformWithState(
        statefulProcessor=Credits(keep_s), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"
    )


def second_totals(changes: DataFrame) -> DataFrame:
    """Counted output by second after all changes, as ``live.receipt_seconds`` has it."""
    totals = changes.groupBy("second").agg(
        F.sum("output_tokens").alias("output_tokens"), F.sum("arrivals").alias("_arrivals"), (F.sum("excluded") > 0).alias("excluded")
    )
    return totals.where("_arrivals > 0").drop("_arrivals")


def follow_seconds(changes: DataFrame) -> DataFrame:
    """Running totals by second, for update mode: every batch hands on the seconds it corrects."""
    return changes.groupBy("second").agg(
        F.sum("output_tokens").alias("output_tokens"), F.sum("arrivals").alias("arrivals"), (F.sum("excluded") > 0).alias("excluded")
    )
