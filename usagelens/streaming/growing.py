"""Growing files followed by their new bytes.

A scan lists the files with their lengths; listings are kept as a journal. State by
file remembers how far it was read, and each listing makes the task that holds the
file's state walk from there to the listed length, in pieces. What is handed on by a
file's state is held until the file is done, so these are ranges of lines, not lines;
the step behind reads the lines of one range after the other. Bytes are so read twice,
and again when a batch comes again. A range whose lines are not those walked over stops
the batch: its file was replaced in between.

- A last line without a break waits until the break is there.
- A file that is shorter than what was read, or whose bytes before that place (or at
  its start) have changed, was replaced: it is read from its start as a new
  generation. This needs no inode, so object stores will do.
- What stands in a file at the first scan is history. Of files touched lately it comes
  out marked as not ``live``, at most the first line and the last ``START_BYTES``, so
  that a walk over the log can go on from it. Older files are not opened until they
  change. Files that appear later are live from their first line.
- A line longer than ``LONGEST``, or that is no UTF-8, comes out without a value.

State of a file that no scan has listed for a day goes by a timer.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Generator, Iterable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from usagelens.streaming.follow import follow_journal
from usagelens.streaming.state import Kept, arriving, keep_state, plain

#: History that is read back of a file, longest line, and how recently a file with history was touched.
START_BYTES, LONGEST, RECENT_S = 512 * 1024, 4 * 1024 * 1024, 300
#: Bytes read at once, bytes by which a file is known again, seconds after which a file that is gone is forgotten.
PIECE, MARK, FORGET_S = 1 << 20, 256, 86400

LISTING = "file string, size bigint, modified double, scanned_at double, first boolean"
LINE = "file string, generation int, ordinal bigint, place bigint, live boolean, value string"
#: Lines that follow each other in a file: the first one's number and place, how many, the last byte to look at, and a checksum.
RANGE = "file string, generation int, ordinal bigint, place bigint, lines bigint, stop bigint, live boolean, sum bigint"
PLACE = "generation int, offset bigint, ordinal bigint, mark bigint, size bigint, modified double, torn boolean, waits boolean"
_LINE = Row(*[f.split()[0] for f in LINE.split(", ")])
_RANGE = Row(*[f.split()[0] for f in RANGE.split(", ")])
_FIELDS = [f.split()[0] for f in PLACE.split(", ")]
_NEW = {"generation": 0, "offset": 0, "ordinal": 0, "mark": None, "size": 0, "modified": None, "torn": False, "waits": False}


def listing(spark: SparkSession, path: str, now: float, first: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """The matching files below a path with their lengths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.col("path").alias("file"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("modified"),
        F.lit(float(now)).alias("scanned_at"), F.lit(first).alias("first"),
    )


def keep_listing(listed: DataFrame, journal: str, number: int) -> None:
    """Add a scan to the journal of listings; a number is used once."""
    listed.write.mode("errorifexists").parquet(f"{journal}/batch={number}")


def _opened(file: str):
    if file.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + file.removeprefix("file:").lstrip("/"))
    system, path = pyarrow.fs.FileSystem.from_uri(quote(file.replace("s3a://", "s3://", 1), safe="/:@"))
    return system.open_input_file(path)


def _mark(f, offset: int) -> int:
    """What a file looks like at its start and before a place."""
    n = min(MARK, offset)
    return zlib.crc32(f.read_at(n, offset - n), zlib.crc32(f.read_at(n, 0)))


def _text(line: bytes) -> str | None:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return None


def _read(f, file: str, p: dict, stop: int, live: bool) -> Iterator[Row]:
    """Whole lines from where the file was read to; moves the place on."""
    f.seek(p["offset"])
    rest = b""
    while f.tell() < stop:
        data = rest + f.read(min(PIECE, stop - f.tell()))
        end = data.rfind(b"\n") + 1
        for line in data[:end].split(b"\n")[:-1]:
            if not p["torn"]:
                yield _LINE(file, p["generation"], p["ordinal"], p["offset"], live, _text(line) if len(line) <= LONGEST else None)
                p["ordinal"] += 1
            p["torn"] = False
            p["offset"] += len(line) + 1
        rest = data[end:]
        if len(rest) > LONGEST:
            if not p["torn"]:
                yield _LINE(file, p["generation"], p["ordinal"], p["offset"], live, None)
                p["ordinal"] += 1
            p["torn"] = True
            p["offset"] += len(rest)
            rest = b""


def _inherited(header: str | None) -> int:
    """The last copied line of a forked log, as its first line says; 0 if that says nothing."""
    try:
        found = json.loads(header or "")["payload"]["subagent_history_start_ordinal"]
    except (ValueError, KeyError, TypeError):
        return 0
    return found if type(found) is int and found > 0 else 0


def _history(f, file: str, p: dict, stop: int) -> Iterator[Row]:
    """The first line and the last bytes of what was there before."""
    if stop > START_BYTES:
        head = f.read_at(min(LONGEST, stop), 0)
        end = head.find(b"\n") + 1
        if end and end < stop - START_BYTES:
            header = _text(head[: end - 1])
            yield _LINE(file, p["generation"], 0, 0, False, header)
            p["ordinal"] = _inherited(header) + 1
        if end < stop - START_BYTES:
            # From the byte before, so that a line that begins right there is not lost.
            p["offset"], p["torn"] = stop - START_BYTES - 1, True
    yield from _read(f, file, p, stop, False)


def _follow(scan: dict, p: dict | None) -> Generator[Row, None, dict]:
    """Lines of one file at one scan; returns the place it was read to."""
    file, size, modified = scan["file"], scan["size"], scan["modified"]
    if p is not None and (size, modified) == (p["size"], p["modified"]):
        return p
    before, history = p, 0
    if p is None:
        p = dict(_NEW)
        if scan["first"]:
            if modified < scan["scanned_at"] - RECENT_S:
                return p | {"size": size, "modified": modified, "waits": True}
            history = size
    elif p["waits"]:
        history = p["size"] if size >= p["size"] else 0
        p = dict(_NEW)
    try:
        f = _opened(file)
    except FileNotFoundError:
        return before or p
    with f:
        stop = min(size, f.size())
        if p["mark"] is not None and (stop < p["offset"] or _mark(f, p["offset"]) != p["mark"]):
            p = _NEW | {"generation": p["generation"] + 1}
        if history:
            yield from _history(f, file, p, min(history, stop))
        yield from _read(f, file, p, stop, True)
        return p | {"mark": _mark(f, p["offset"]), "size": size, "modified": modified}


def _summed(line: Row, total: int) -> int:
    return zlib.crc32(b"\0" if line.value is None else line.value.encode() + b"\n", total)


def _ranges(walk: Generator[Row, None, dict], stop: int) -> Generator[Row, None, dict]:
    """The lines of a walk as ranges of about ``PIECE`` bytes; returns what the walk returns."""
    first, lines, total = None, 0, 0
    while True:
        try:
            line = next(walk)
        except StopIteration as end:
            if first:
                yield _RANGE(*first, lines, stop, live, total)
            return end.value
        # The first line of a history stands alone: what follows it may be far behind.
        apart = first and (
            line.place - first[3] >= PIECE or (line.generation, line.live) != (first[1], live) or (not live and first[3] == 0)
        )
        if apart:
            yield _RANGE(*first, lines, stop, live, total)
        if apart or not first:
            first, lines, total, live = (line.file, line.generation, line.ordinal, line.place), 0, 0, line.live
        lines += 1
        total = _summed(line, total)


def _lines_of(r: dict) -> list[Row]:
    """The lines of one range, read again."""
    p = {"generation": r["generation"], "ordinal": r["ordinal"], "offset": r["place"], "torn": False}
    with _opened(r["file"]) as f:
        found = list(islice(_read(f, r["file"], p, min(r["stop"], f.size()), r["live"]), r["lines"]))
    total = 0
    for line in found:
        total = _summed(line, total)
    if (len(found), total) != (r["lines"], r["sum"]):
        raise ValueError(f"File was replaced while it was read: {r['file']}")
    return found


def _read_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in LINE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    for batch in batches:
        for r in batch.to_pylist():
            columns = zip(*_lines_of(r), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Tail(Kept):
    """One file: how far it was read, and how to know it again."""

    def __init__(self):
        super().__init__(FORGET_S)

    def init(self, handle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", PLACE)

    def forget(self) -> None:
        self.place.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        scans = sorted(plain(rows), key=lambda s: s["scanned_at"])
        place = dict(zip(_FIELDS, self.place.get(), strict=True)) if self.place.exists() else None
        for scan in scans:
            place = yield from _ranges(_follow(scan, place), scan["size"])
        self.place.update(tuple(place[f] for f in _FIELDS))
        self.saw(scans[-1]["scanned_at"])


def follow_lines(spark: SparkSession, journal: str, max_files: int = 1000) -> DataFrame:
    """New lines of all listed files."""
    keep_state(spark)
    listed = follow_journal(journal, spark.createDataFrame([], LISTING), max_files)
    rows = arriving(listed, "scanned_at", "1 hour").withColumn("log", F.col("file"))
    ranges = rows.groupBy("log").transformWithState(
        statefulProcessor=Tail(), outputStructType=RANGE, outputMode="Append", timeMode="EventTime"
    )
    return ranges.mapInArrow(_read_ranges, LINE)


def _bad() -> Column:
    return F.col("value").isNull() | ((F.trim("value") != "") & F.try_parse_json("value").isNull())


def records(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed lines; a replaced file counts as another one. Lines that are no JSON are left to ``malformed``."""
    file = F.when(F.col("generation") == 0, F.col("file")).otherwise(F.concat("file", F.lit("#"), "generation"))
    good = lines.where(~_bad() & (F.trim("value") != ""))
    return good.select(file.alias("file"), "ordinal", F.from_json("value", schema).alias("r"), "live")


def malformed(lines: DataFrame) -> DataFrame:
    """How many complete lines of a file could not be read, over a journal of lines."""
    return lines.where(_bad()).groupBy("file", "generation").agg(F.count(F.lit(1)).alias("lines"))
