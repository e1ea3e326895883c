"""Pairing of response boundaries as a stream, conversation by conversation.

Boundaries wait until the clock of arrivals has passed them by ``wait_s``, so what
came out of order is put in order first; then each conversation is a walk over its
boundaries. What is open is kept in state until its completion, or until half an
hour has passed without another start: then a timer reports it as a gap. Identities
of what was seen are kept as long, to drop repeated exports. So the state of a
conversation is bounded by what it sends in half an hour.

A completion belongs to the open starts of its own response id; without such to the
starts that carry no id. A completion without id takes those, or the only response
that is open under an id. A sent request is refined by the response that names its
id: it keeps its own start. Where boundaries of one conversation all carry ids, or
none does, outcomes are those of ``pairing.pair_responses`` over all rows; the walk
does not depend on how rows were cut into files.

A boundary that comes later than ``wait_s`` is taken when it comes. Nothing is
dropped but rows that arrive out of order by more than ``disorder``; Spark counts
those.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from usagelens.operators.pairing import COMPLETED, LATE_S, MAX_AGE_S
from usagelens.streaming.state import Mapped, arriving, keep_state, plain

#: How long boundaries wait for earlier ones, in seconds.
WAIT_S = 10.0
#: A heartbeat only moves the clock.
HEARTBEAT = "heartbeat"

EVENT = (
    "stamp double, done int, start_origin string, received_at double, output_tokens bigint, session_key string, "
    "response_key string, provider string, model string"
)
OPEN = (
    "stamp double, start_origin string, session_key string, provider string, model string, received_at double, response_key string, "
    "starts int, requests int, last double"
)
OUTCOME = (
    "session_key string, response_key string, provider string, model string, output_tokens bigint, start double, end double, "
    "received_at double, status string"
)
_EVENT = [f.split()[0] for f in EVENT.split(", ")]
_OPEN = [f.split()[0] for f in OPEN.split(", ")]
_OUTCOME = Row(*[f.split()[0] for f in OUTCOME.split(", ")])
#: Starts without response id.
LOOSE = ""


def _order(e: dict) -> tuple:
    """Starts before ends of the same moment; ends without id by their tokens; then the order of exports."""
    tokens = -1 if e["output_tokens"] is None else e["output_tokens"]
    loose = e["done"] and e["response_key"] is None
    return e["stamp"], e["done"], tokens if loose else -1, e["start_origin"] or "", e["received_at"], tokens


class Walk:
    """What is open and what was seen in one conversation: ``held`` by response id, ``seen`` by identity."""

    def __init__(self, held: dict[str, tuple], seen: dict[str, tuple]):
        self.held, self.seen = held, seen

    def _again(self, e: dict, scope: str) -> bool:
        """Whether an export repeats what was seen: the end of a response, the same end without id, the same start."""
        if e["done"]:
            identity = f"end {e['response_key']}" if e["response_key"] is not None else f"end at {e['stamp']!r} {e['output_tokens']}"
        else:
            identity = f"start {scope} {e['stamp']!r}"
        if identity in self.seen:
            return True
        self.seen[identity] = (e["stamp"],)
        return False

    def step(self, e: dict) -> Iterator[tuple]:
        own = e["response_key"] if e["response_key"] is not None else LOOSE
        if e["done"]:
            if self._again(e, own):
                return
            scope = own
            if own not in self.held and own != LOOSE and LOOSE in self.held:
                scope = LOOSE
            elif own == LOOSE and LOOSE not in self.held and len(self.held) == 1:
                (scope,) = self.held
            yield from self._overdue(scope, e["stamp"])
            yield self._outcome(self.held.pop(scope, None), e)
            return
        if self._again(e, own):
            return
        yield from self._overdue(own, e["stamp"])
        start = dict(e, starts=0, requests=0)
        if own != LOOSE and own not in self.held and e["start_origin"] != "request" and LOOSE in self.held:
            sent = dict(zip(_OPEN, self.held[LOOSE], strict=True))
            if sent["starts"] == 1 and sent["requests"] == 1 and e["stamp"] - sent["last"] <= MAX_AGE_S:
                # The response names the id of the request that was sent.
                del self.held[LOOSE]
                start = dict(sent, response_key=own)
        if own in self.held:
            start = dict(zip(_OPEN, self.held[own], strict=True))
        start |= {"starts": start["starts"] + 1, "requests": start["requests"] + (e["start_origin"] == "request"), "last": e["stamp"]}
        self.held[own] = tuple(start[f] for f in _OPEN)

    def _overdue(self, scope: str, stamp: float) -> Iterator[tuple]:
        """A pause of more than half an hour ends what was open."""
        if scope in self.held and stamp - self.held[scope][-1] > MAX_AGE_S:
            yield self._outcome(self.held.pop(scope), None)

    def forget(self, clock: float) -> Iterator[tuple]:
        """What is overdue at ``clock``: open starts come out as gaps."""
        for scope in sorted(self.held, key=lambda s: self.held[s][-1]):
            yield from self._overdue(scope, clock)
        for identity in [i for i, (stamp,) in self.seen.items() if clock - stamp > MAX_AGE_S]:
            del self.seen[identity]

    def due(self) -> float | None:
        """When the next of what is kept is overdue."""
        kept = [v[-1] for v in self.held.values()] + [v[0] for v in self.seen.values()]
        return min(kept) + MAX_AGE_S if kept else None

    @staticmethod
    def _outcome(held: tuple | None, c: dict | None) -> tuple:
        s = dict(zip(_OPEN, held, strict=True)) if held else None
        single = s is not None and (s["starts"] == 1 or (s["start_origin"] == "request" and s["requests"] == 1))
        if c is None:
            status = "awaiting_usage" if single else "missing_timing"
        elif c["output_tokens"] is None:
            status = "awaiting_usage"
        elif c["output_tokens"] == 0:
            status = "empty"
        elif not single or not 0 < c["stamp"] - s["stamp"] <= MAX_AGE_S or None is not s["response_key"] != c["response_key"] is not None:
            status = "missing_timing"
        elif s["session_key"] != c["session_key"]:
            status = "ambiguous_identity"
        else:
            status = "late" if c["stamp"] < c["received_at"] - LATE_S else "measured"
        first, last = c or s, s or c
        part = [first[f] if first[f] is not None else last[f] for f in ("session_key", "response_key", "provider", "model", "received_at")]
        start = s["stamp"] if status in ("measured", "late") else None
        return (*part[:4], c and c["output_tokens"], start, first["stamp"], part[4], status)


class Pairing(StatefulProcessor):
    """The walk of one conversation over state: boundaries that wait, what is open, what was seen."""

    def __init__(self, wait_s: float):
        self.wait_s = wait_s

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.held = handle.getMapState("held", "scope string", OPEN)
        self.seen = handle.getMapState("seen", "identity string", "stamp double")

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(e[f] for f in _EVENT) for e in plain(rows) if e["kind"] != HEARTBEAT]
        if new:
            self.waiting.appendList(new)
            self._wake(min(e[0] for e in new) + self.wait_s)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs() / 1000 - self.wait_s
        waiting = [dict(zip(_EVENT, e, strict=True)) for e in self.waiting.get()]
        ready = sorted((e for e in waiting if e["stamp"] <= clock), key=_order)
        rest = [tuple(e[f] for f in _EVENT) for e in waiting if e["stamp"] > clock]
        held, seen = Mapped(self.held), Mapped(self.seen)
        walk = Walk(held.now, seen.now)
        for e in ready:
            for found in walk.step(e):
                yield _OUTCOME(*found)
        for found in walk.forget(clock):
            yield _OUTCOME(*found)
        held.save()
        seen.save()
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        due = [e[0] for e in rest] + ([walk.due()] if walk.due() is not None else [])
        if due:
            self._wake(min(due) + self.wait_s)

    def close(self) -> None:
        pass


def pair_stream(events: DataFrame, wait_s: float = WAIT_S, disorder: str = "1 minute") -> DataFrame:
    """Outcomes of a stream of boundaries, in append mode; ``heartbeat`` rows move the clock where nothing else comes."""
    keep_state(events.sparkSession)
    timed = arriving(events, "received_at", disorder).withColumn("done", (F.col("kind") == COMPLETED).cast("int"))
    nobody = F.col("session_key").isNull() & F.col("response_key").isNull() & (F.col("kind") != HEARTBEAT)
    lost = timed.where(nobody).select(
        "session_key", "response_key", "provider", "model", "output_tokens",
        F.lit(None).cast("double").alias("start"), F.col("stamp").alias("end"), "received_at", F.lit("ambiguous_identity").alias("status"),
    )
    conversation = F.coalesce(F.concat(F.lit("s:"), "session_key"), F.concat(F.lit("r:"), "response_key"), F.lit(""))
    kept = timed.where(~nobody).select(conversation.alias("conversation"), "kind", "arrived", *_EVENT)
    paired = kept.groupBy("conversation").transformWithState(
        statefulProcessor=Pairing(wait_s), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime"
    )
    return paired.unionByName(lost)
