"""Live logs of kind B as a stream: messages grow over several lines, tools and sub-agents in between.

A conversation, or a sub-agent's own, is a walk over its lines in order. State is the
last input, whether a reply has used it up, open tool calls, and the messages of the
last ``KEEP_S`` seconds, as their first line found them and with the most output any
line reported. A message that a batch changed comes out as it then is; the newest row
of a message counts, as ``follow.corrected`` reads it from the journal. Rows are those
of ``logs.native_samples_b`` over the whole logs, as long as the lines of one message
are no further apart. Lines that were seen already are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from usagelens.functions import usage as U
from usagelens.sources import logs
from usagelens.streaming.state import Mapped, keep_state, plain

#: Fixed value: seconds after which a message gets no more lines.
KEEP_S = 600

WALK = "entered double, spent boolean, ordinal bigint"
MESSAGE = "boundary double, output_tokens bigint, stamp double, model string, provider string, seen double"
SAMPLE = "session_id string, message_id string, model string, provider string, output_tokens bigint, stamp double, start double, end double"
_WALK = [f.split()[0] for f in WALK.split(", ")]
_SAMPLE = Row(*[f.split()[0] for f in SAMPLE.split(", ")])
_NEW = {"entered": None, "spent": False, "ordinal": -1}


def step(w: dict, calls: dict[str, tuple], messages: dict[str, tuple], e: dict) -> str | None:
    """One event: changes the walk, its open calls and its messages; the message that it belongs to."""
    event, call = e["event"], "" if e["call_id"] is None else "=" + e["call_id"]
    if event == "call":
        calls[call] = (e["ordinal"],)
    elif event == "result":
        calls.pop(call, None)
    elif event == "input":
        w |= {"entered": None if calls else e["stamp"], "spent": False}
    elif event in ("failed", "stop"):
        w["spent"] = True
    elif event == "output":
        boundary = None if w["spent"] or calls else w["entered"]
        tokens = e["output_tokens"] if (e["output_tokens"] or 0) > 0 else None
        if tokens is not None and w["entered"] is not None and w["entered"] <= e["stamp"]:
            w["spent"] = True
        name = e["named"]
        if name is not None:
            first, most, stamp, *_ = messages.get(name, (boundary, None, None))
            if tokens is not None and (most is None or (tokens, e["stamp"]) > (most, stamp)):
                most, stamp = tokens, e["stamp"]
            messages[name] = (first, most, stamp, e["model"], e["provider"], e["stamp"])
            return name
    return None


class Conversation(StatefulProcessor):
    """The walk over one conversation."""

    def __init__(self, keep_s: float = KEEP_S):
        self.keep_s = keep_s

    def init(self, handle) -> None:
        self.walk = handle.getValueState("walk", WALK)
        self.calls = handle.getMapState("calls", "call string", "ordinal bigint")
        self.messages = handle.getMapState("messages", "message string", MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        w = dict(zip(_WALK, self.walk.get(), strict=True)) if self.walk.exists() else dict(_NEW)
        calls, messages = Mapped(self.calls), Mapped(self.messages)
        changed: dict[str, None] = {}
        # A line's events always come together, so the last line seen tells what is new.
        new = sorted((e for e in plain(rows) if e["ordinal"] > w["ordinal"]), key=lambda e: (e["ordinal"], e["part"]))
        for e in new:
            w["ordinal"] = e["ordinal"]
            name = step(w, calls.now, messages.now, e)
            if name is not None:
                changed[name] = None
        for name in changed:
            start, tokens, stamp, model, provider, _ = messages.now[name]
            if tokens is not None:
                timed = start is not None and start < stamp
                yield _SAMPLE(key[0], name, model, provider, tokens, stamp, start if timed else None, stamp if timed else None)
        newest = max((m[-1] for m in messages.now.values()), default=0.0)
        messages.now = {name: m for name, m in messages.now.items() if m[-1] >= newest - self.keep_s}
        self.walk.update(tuple(w[f] for f in _WALK))
        calls.save()
        messages.save()

    def close(self) -> None:
        pass


def follow_messages(records: DataFrame, keep_s: float = KEEP_S) -> DataFrame:
    """Messages of a stream of records (file, ordinal, r) as they grow."""
    keep_state(records.sparkSession)
    events = logs.log_b_events(records)
    rows = events.withColumns({"named": U.usable_identity(F.col("message_id")), "conversation": F.col("session_id")})
    return rows.groupBy("conversation").transformWithState(
        statefulProcessor=Conversation(keep_s), outputStructType=SAMPLE, outputMode="Append", timeMode="None"
    )
