"""The trailing average of received output as a stream.

A batch first adds up its arrivals by series and second, so a series hands at most a
row a second to the task that holds its state. State is a ring: the sums of the
seconds that the window and late arrivals can still reach. Timers move the clock of
a series on and give every second's average, idle ones included; the second after
which nothing is left in the window gets a zero, and then the series is silent.
Arrivals, or corrections, that come late give their seconds again; the newest row of
a second holds.

The newest rows are ``live.receipt_average`` by series, for any cut of the files, as
long as nothing comes more than ``LATE_S`` late. A row without tokens is a heartbeat.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from usagelens.operators.live import AVERAGE_S
from usagelens.streaming.follow import corrected
from usagelens.streaming.state import Mapped, arriving, keep_state, plain

#: How late arrivals may come, in seconds.
LATE_S = 600
AVERAGE = "series string, second bigint, output_tokens bigint"
_AVERAGE = Row("series", "second", "output_tokens")


def by_second(arrivals: DataFrame) -> DataFrame:
    """Sums of (series, received_at, tokens) by the first whole second that has them; ``exact`` ones arrived right on it."""
    exact = F.col("received_at") == F.floor("received_at")
    return arrivals.groupBy("series", F.ceil("received_at").alias("first"), exact.alias("exact")).agg(F.sum("tokens").alias("tokens"))


def _reach(key: int, window_s: int) -> tuple[int, int]:
    """First and last second whose window holds the arrivals of a key, which is twice the second, odd for exact ones."""
    first = key >> 1
    return first, first + window_s - (0 if key & 1 else 1)


def totals(ring: dict[int, int], low: int, high: int, window_s: int) -> Iterator[tuple[int, int]]:
    """(second, tokens in its window) of the seconds from low to high that have arrivals, and a zero behind the last of them."""
    steps: dict[int, tuple[int, int]] = {}
    for key, tokens in ring.items():
        first, last = _reach(key, window_s)
        for at, n, held in ((first, tokens, 1), (last + 1, -tokens, -1)):
            old = steps.get(at, (0, 0))
            steps[at] = (old[0] + n, old[1] + held)
    places, tokens, held = sorted(steps), 0, 0
    for at, until in zip(places, [*places[1:], 0], strict=False):
        tokens, held = tokens + steps[at][0], held + steps[at][1]
        if held:
            yield from ((s, tokens) for s in range(max(at, low), min(until - 1, high) + 1))
        elif low <= at <= high:
            yield at, 0


class Average(StatefulProcessor):
    """One series: its ring and the second up to which averages were given."""

    def __init__(self, window_s: int, late_s: int):
        self.window_s, self.late_s = window_s, late_s

    def init(self, handle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "at bigint", "tokens bigint")
        self.given = handle.getValueState("given", "second bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring, changed = Mapped(self.ring), set()
        for r in plain(rows):
            if r["tokens"] is not None:
                at = 2 * r["first"] + r["exact"]
                ring.now[at] = (ring.now.get(at, (0,))[0] + r["tokens"],)
                changed.add(at)
        if not changed:
            return
        ring.save()
        reach = [_reach(at, self.window_s) for at in changed]
        if not self.given.exists():
            given = min(first for first, _ in reach) - 1
            self.given.update((given,))
            self.handle.registerTimer((given + 1) * 1000)
        given = self.given.get()[0]
        again: set[int] = set()
        for first, last in reach:
            again.update(range(first, min(last, given) + 1))
        if again:
            held = {k: v[0] for k, v in ring.now.items()}
            yield from (_AVERAGE(key[0], s, n) for s, n in totals(held, min(again), max(again), self.window_s) if s in again)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ring, now = Mapped(self.ring), timerValues.getCurrentWatermarkInMs() // 1000
        given = self.given.get()[0]
        held = {k: v[0] for k, v in ring.now.items()}
        yield from (_AVERAGE(key[0], s, n) for s, n in totals(held, given + 1, now, self.window_s))
        now = max(now, given)
        ring.now = {k: v for k, v in ring.now.items() if _reach(k, self.window_s)[1] + self.late_s >= now}
        ring.save()
        if ring.now:
            self.given.update((now,))
            self.handle.registerTimer((now + 1) * 1000)
        else:
            self.given.clear()

    def close(self) -> None:
        pass


def follow_average(seconds: DataFrame, window_s: int = AVERAGE_S, late_s: int = LATE_S) -> DataFrame:
    """Averages of a stream of ``by_second`` rows."""
    keep_state(seconds.sparkSession)
    rows = arriving(seconds, "first", f"{late_s} seconds").withColumn("meter", F.col("series"))
    return rows.groupBy("meter").transformWithState(
        statefulProcessor=Average(window_s, late_s), outputStructType=AVERAGE, outputMode="Append", timeMode="EventTime"
    )


def averages(journal: DataFrame, window_s: int = AVERAGE_S) -> DataFrame:
    """The newest average of each second of a journal."""
    newest = corrected(journal, ["series", "second"])
    return newest.withColumn("average_tps", F.col("output_tokens") / window_s)
