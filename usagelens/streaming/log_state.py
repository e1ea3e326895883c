"""Live logs of kind A as a stream: a session's state goes on where its last line left it.

A log is a walk over its lines in order. State by file is what the walk needs to go
on in the middle of a turn: the last input, the first and last output of the response
in progress, open tool calls, the record that a token count may mirror, the counter,
the model of the turn and the header. It does not grow with the log. Lines that were
seen already are passed over, so a batch that comes again, or a file that is read
from its start once more, adds nothing.

Samples are those of ``logs.native_samples_a`` over the whole logs, however the
lines were cut into batches. Lines of one file must come in the order of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from usagelens.functions import usage as U
from usagelens.sources import logs
from usagelens.streaming.state import Mapped, keep_state, plain

WALK = (
    "session_id string, provider string, inherited bigint, model string, entered double, start double, end double, cleared boolean, "
    "record string, mirrored boolean, total string, last bigint"
)
RESPONSE = (
    "session_id string, ordinal bigint, event string, stamp double, input_tokens bigint, output_tokens bigint, "
    "cached_input_tokens bigint, response_id string, model string, provider string, start double, end double"
)
_FIELDS = [f.split()[0] for f in WALK.split(", ")]
_RESPONSE = Row(*[f.split()[0] for f in RESPONSE.split(", ")])
_NEW = dict.fromkeys(_FIELDS) | {"cleared": False, "mirrored": False, "last": -1}


def step(w: dict, calls: dict[str, tuple], e: dict) -> tuple | None:
    """One line: changes the walk and its open calls; the response that a report ends, with its interval."""
    if e["ordinal"] <= w["last"]:
        return None
    w["last"] = e["ordinal"]
    event = e["event"]
    if event == "header":
        w |= {"session_id": e["session_id"], "provider": e["model_provider"], "inherited": e["inherited_until"]}
        return None
    if w["session_id"] is None or e["ordinal"] <= w["inherited"] or e["thread_id"] not in (None, w["session_id"]):
        return None
    if event == "context":
        w["model"] = e["model"]
        return None
    if event in ("reset", "start"):
        calls.clear()
        w |= {"entered": None, "start": None, "end": None, "cleared": False}
    call = "" if e["call_id"] is None else "=" + e["call_id"]
    if event in ("input", "result", "start"):
        if event == "result":
            calls.pop(call, None)
        w |= {"entered": None if calls else e["stamp"], "cleared": False}
    elif event in ("output", "call"):
        if not calls and not w["cleared"] and w["start"] is None:
            w["start"] = w["entered"]
        if event == "call":
            calls[call] = (e["ordinal"],)
        if e["stamp"] is not None:
            w["end"] = e["stamp"]
    elif event in ("usage", "count"):
        return _report(w, e)
    return None


def _report(w: dict, e: dict) -> tuple | None:
    use = repr((e["input_tokens"], e["output_tokens"], e["cached_input_tokens"]))
    if e["event"] == "usage":
        w |= {"record": use, "mirrored": False}
    else:
        if e["total"] is not None:
            if e["total"] == w["total"]:
                return None
            w["total"] = e["total"]
        if w["record"] == use and not w["mirrored"]:
            # The first count after a record that names the same usage is its mirror.
            w["mirrored"] = True
            return None
    start, end = w["start"], w["end"]
    if end is None or (w["entered"] is not None and w["entered"] <= end):
        w["cleared"] = True
    w |= {"start": None, "end": None}
    timed = start is not None and end is not None and end > start
    fields = [e[f] for f in ("ordinal", "event", "stamp", "input_tokens", "output_tokens", "cached_input_tokens", "response_id")]
    return (w["session_id"], *fields, w["model"], w["provider"], start if timed else None, end if timed else None)


class Log(StatefulProcessor):
    """The walk over one file."""

    def init(self, handle) -> None:
        self.walk = handle.getValueState("walk", WALK)
        self.calls = handle.getMapState("calls", "call string", "ordinal bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        w = dict(zip(_FIELDS, self.walk.get(), strict=True)) if self.walk.exists() else dict(_NEW)
        calls = Mapped(self.calls)
        for e in sorted(plain(rows), key=lambda e: e["ordinal"]):
            found = step(w, calls.now, e)
            if found is not None:
                yield _RESPONSE(*found)
        self.walk.update(tuple(w[f] for f in _FIELDS))
        calls.save()

    def close(self) -> None:
        pass


def follow_responses(lines: DataFrame) -> DataFrame:
    """Reported responses with their intervals, of a stream of ``logs.line_events_a`` rows."""
    keep_state(lines.sparkSession)
    rows = lines.withColumn("log", F.col("file"))
    return rows.groupBy("log").transformWithState(
        statefulProcessor=Log(), outputStructType=RESPONSE, outputMode="Append", timeMode="None"
    )


def follow_samples(records: DataFrame) -> DataFrame:
    """Samples of a stream of records (file, ordinal, r)."""
    found = follow_responses(logs.line_events_a(records)).where("output_tokens > 0")
    labelled = found.withColumns(
        {
            "model": U.clean_label(F.col("model"), 120),
            "provider": U.clean_label(F.col("provider"), 120, "Provider unreported"),
            "second": F.floor("stamp"),
        }
    )
    return logs.keyed_samples_a(labelled)
