"""Absolute usage reports merged as they arrive.

A report states the counts of a source for a range of time: all of them, or, where it
is partial, at least these. State by slot keeps the newest whole report's count and
the partial reports behind it that no later one beats. What is known of a slot so is
the same in whatever order and batches reports arrive: that of ``history.upsert_usage``
and ``upsert_days`` applied in the order of their sequence.

A report's rows may be spread over files. One row of kind ``report`` names the range;
slots inside that no row names are zero in a whole report. Rows of kind ``slot`` and
``day`` carry counts, ``at`` being the slot's or the day's first second. Counts of days
without time of day stand until a later whole report covers the day without naming it.

A timer drops slots that no report has touched for the retention.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from usagelens.operators.history import RETENTION
from usagelens.streaming.follow import corrected
from usagelens.streaming.state import Kept, Mapped, arriving, keep_state, plain

REPORT = (
    "series string, sequence bigint, begin bigint, end bigint, partial boolean, available boolean, collected_at double, "
    "kind string, at bigint, tokens bigint"
)
KNOWN = "series string, kind string, at bigint, tokens bigint, partial boolean"
DAY_S = 86400
_KNOWN = Row(*[f.split()[0] for f in KNOWN.split(", ")])


def merge(base: tuple | None, later: dict[int, int], rows: list[tuple[int, bool, int]]) -> tuple[tuple | None, dict[int, int]]:
    """(newest whole report as sequence and count, partial counts behind it by sequence) after more (sequence, partial, count)."""
    for sequence, partial, tokens in rows:
        if partial:
            later = later | {sequence: max(tokens, later.get(sequence, 0))}
        elif base is None or sequence >= base[0]:
            base = (sequence, max(tokens, base[1]) if base is not None and sequence == base[0] else tokens)
    kept, best = {}, -1
    for sequence in sorted(later, reverse=True):
        # An earlier partial count matters to a whole report between it and a later one, if it is larger.
        if (base is None or sequence > base[0]) and later[sequence] > best:
            kept[sequence] = best = later[sequence]
    return base, kept


def known(base: tuple | None, later: dict[int, int]) -> tuple[int, bool] | None:
    """(count, whether it is only a lower bound)."""
    most = max(later.values(), default=None)
    if base is None:
        return None if most is None else (most, True)
    return (base[1], False) if most is None or most <= base[1] else (most, True)


class Slot(Kept):
    """One slot or day of one source."""

    def __init__(self, keep_s: float):
        super().__init__(keep_s)

    def init(self, handle) -> None:
        super().init(handle)
        self.base = handle.getValueState("base", "sequence bigint, tokens bigint")
        self.later = handle.getMapState("later", "sequence bigint", "tokens bigint")
        self.said = handle.getValueState("said", "tokens bigint, partial boolean")
        self.named = handle.getValueState("named", "yes boolean")

    def forget(self) -> None:
        for state in (self.base, self.later, self.said, self.named):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(plain(rows))
        later = Mapped(self.later)
        base = tuple(self.base.get()) if self.base.exists() else None
        counts = [(r["sequence"], r["partial"], r["tokens"]) for r in rows]
        base, kept = merge(base, {s: v[0] for s, v in later.now.items()}, counts)
        later.now = {s: (v,) for s, v in kept.items()}
        later.save()
        if base is not None:
            self.base.update(base)
        if any(r["named"] for r in rows):
            self.named.update((True,))
        series, kind, at = key
        now, said = known(base, kept), tuple(self.said.get()) if self.said.exists() else None
        if now is not None and self.named.exists():
            # Days without time of day are never complete.
            now = (now[0], now[1] or kind == "day")
            if now != said:
                self.said.update(now)
                yield _KNOWN(series, kind, at, *now)
        self.saw(max(r["collected_at"] for r in rows))


def _grid(reports: DataFrame, step: int, kind: str) -> DataFrame:
    """Zero at every slot that starts inside a report's range."""
    first = F.ceil(F.col("begin") / step) * step
    last = F.col("end") - 1
    slots = F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint")))
    zero = {"kind": F.lit(kind), "tokens": F.lit(0).cast("bigint"), "named": F.lit(kind == "slot")}
    return reports.withColumn("at", F.explode(slots)).withColumns(zero)


def follow_usage(reports: DataFrame, step: int = 60, keep_s: float = RETENTION) -> DataFrame:
    """What is known of each slot and day, whenever it changes. Failed reports change nothing."""
    keep_state(reports.sparkSession)
    rows = reports.where("available").select(*[f.split()[0] for f in REPORT.split(", ")])
    header = F.col("kind") == "report"
    told = rows.where(~header & F.col("tokens").isNotNull()).withColumn("named", F.lit(True))
    every = told.unionByName(_grid(rows.where(header), step, "slot")).unionByName(_grid(rows.where(header & ~F.col("partial")), DAY_S, "day"))
    every = every.select("series", "kind", "at", "sequence", "partial", "tokens", "named", "collected_at")
    timed = arriving(every, "collected_at", f"{int(keep_s)} seconds")
    keys = timed.withColumns({"source": F.col("series"), "what": F.col("kind"), "slot": F.col("at")})
    return keys.groupBy("source", "what", "slot").transformWithState(
        statefulProcessor=Slot(keep_s), outputStructType=KNOWN, outputMode="Append", timeMode="EventTime"
    )


def known_usage(journal: DataFrame) -> DataFrame:
    """The newest count of each slot and day of a journal of changes."""
    return corrected(journal, ["series", "kind", "at"])
