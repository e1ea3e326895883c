"""Operator 5: document fingerprints by locally consistent parsing.

A text is parsed into phrases, the names of the phrases again, until one name is
left. On each level, runs of equal symbols count as one; deterministic coin tossing
(the lowest bit in which a symbol differs from its left neighbour, and that bit's
value, three or four times over) leaves labels below 6, different between
neighbours; phrases start where a label is larger than both neighbours'. A cut
depends on a few symbols around it only, so equal substrings get equal phrases but
for their edges, at any offset. A phrase's name is the hash of its symbols.

The fingerprint keeps, of all names from level ``FROM_LEVEL`` up, the smallest hash
in each of ``BINS`` bins. Likeness is the share of common names among both texts'
names on average (2J / (1 + J) for the share J of equal bins): 1 for equal
fingerprints, about the common part of the texts else. Two empty texts are equal,
an empty one is unlike any other.

Documents are dealt by range of doc_id and stream in descending order; the next
document of a range's last one is found in a second step, which handles one
document a range. Null doc_id: first, ahead of all ids. Rows that share an id follow
the hash of their texts, repeated rows stay. Null text: empty. One row only: it is
its own next. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import id_back, keyed
from usagelens.session import materialize

BINS = 64
FROM_LEVEL = 2
#: Characters of text that are parsed together.
TOGETHER = 1 << 19
_EMPTY = 0xFFFF
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, _FACTOR | np.uint64(1), np.uint64)]), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit names."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tossed(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest place where x and left differ, plus x's bit there."""
    low = (x ^ left) & (~(x ^ left) + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return (2 * place + ((x & low) > 0)).astype(np.uint8)


_BYTES = np.arange(256, dtype=np.uint8)
#: Labels of a byte and its left neighbour, by 256 * byte + neighbour.
_TABLE = _tossed(np.repeat(_BYTES, 256), np.tile(_BYTES, 256))


def _labels(heads: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different between neighbours of one text; ``first`` marks where texts start."""
    labels = heads
    for _ in range(3 if heads.dtype == np.uint8 else 4):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[first] = labels[first] ^ 1
        if labels.dtype == np.uint8:
            labels = _TABLE[labels.astype(np.uint16) << 8 | left]
        else:
            labels = _tossed(labels, left)
    return labels


def _level(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the next level's symbols."""
    n = len(symbols)
    new = np.ones(n, bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    heads, owner = symbols[at], owner[at]
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    values = _mix(heads.astype(np.uint64) + runs * np.uint64(0x632BE59BD9B4E019))
    m = len(heads)
    first = np.ones(m, bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.flatnonzero(first)
    labels = _labels(heads, starts)
    cut = np.zeros(m, bool)
    cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    # No phrase of one symbol at a text's edges, so every level is shorter.
    cut[starts[1:] - 1] = False
    cut[np.minimum(starts + 1, m - 1)] = False
    cut[-1] = False
    cut |= first
    at = np.flatnonzero(cut)
    inside = np.arange(m) - np.repeat(at, np.diff(np.append(at, m)))
    names = np.add.reduceat(values * _POWERS[inside & 63], at)
    return _mix(names ^ np.diff(np.append(at, m)).astype(np.uint64)), owner[at]


def sketches(raws: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, a row of ``BINS`` numbers each."""
    out = np.full((len(raws), BINS), _EMPTY, np.uint16)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    symbols = np.frombuffer(b"".join(raws), np.uint8)
    level = 0
    while len(symbols):
        last = np.ones(len(symbols), bool)
        last[1:] &= owner[1:] != owner[:-1]
        last[:-1] &= owner[1:] != owner[:-1]
        keep = slice(None) if level >= FROM_LEVEL else last
        names = _mix(symbols[keep].astype(np.uint64) + np.uint64(level * int(_FACTOR) % 2**64))
        place = owner[keep].astype(np.int64) * BINS + (names >> np.uint64(58)).astype(np.int64)
        value = ((names >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
        np.minimum.at(out.reshape(-1), place, np.minimum(value, np.uint16(_EMPTY - 1)))
        rest = ~last
        symbols, owner = symbols[rest], owner[rest]
        if len(symbols):
            symbols, owner = _level(symbols, owner)
            level += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    held = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    same = ((a == b) & (a != _EMPTY)).sum(axis=1)
    return np.where(held == 0, 1.0, 2 * same / np.maximum(held + same, 1))


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as many first characters of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DDL = "kind string, shard int, _id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _finished(ids: list[int], own: list[str], following: list[str], shard: int) -> pa.RecordBatch:
    """Whole rows of documents whose next document is known."""
    changed = [edited(t, f).encode() for t, f in zip(own, following, strict=True)]
    distinct = list(dict.fromkeys([*own, *following]))
    place = {t: k for k, t in enumerate(distinct)}
    found = sketches([*(t.encode() for t in distinct), *changed])
    mine, theirs, new = found[[place[t] for t in own]], found[[place[t] for t in following]], found[len(distinct) :]
    to_new, to_next = likeness(mine, new), likeness(mine, theirs)
    return _batch([
        ("done", shard, i, None, len(t), hashlib.sha256(c).hexdigest(), _hex(a), _hex(b), float(x), float(y))
        for i, t, c, a, b, x, y in zip(ids, own, changed, mine, new, to_new, to_next, strict=True)
    ])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows, and the first and last document of the range as they are."""
    shard = TaskContext.get().partitionId()
    ids: list[int] = []
    held: list[str] = []
    size, first = 0, True
    for batch in batches:
        for i, text in zip(batch.column("_id").to_pylist(), batch.column("text"), strict=True):
            value = text.as_py()
            if first:
                yield _batch([("head", shard, i, value, *[None] * 6)])
                first = False
            ids.append(i)
            held.append(value)
            size += len(value)
            if size >= TOGETHER and len(held) > 1:
                yield _finished(ids[:-1], held[:-1], held[1:], shard)
                ids, held, size = ids[-1:], held[-1:], len(held[-1])
    if len(held) > 1:
        yield _finished(ids[:-1], held[:-1], held[1:], shard)
    if held:
        yield _batch([("last", shard, ids[-1], held[-1], *[None] * 6)])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _finished([row["_id"]], [row["text"]], [row["following"]], row["shard"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness."""
    order = F.col("_id").desc()
    ranges = keyed(docs).repartitionByRange(order).sortWithinPartitions(order, "_row").select("_id", "text")
    found = materialize(ranges.mapInArrow(_stream, DDL), "fingerprints")
    heads = found.where("kind = 'head'").select("shard", F.col("text").alias("following"))
    # One number a range; the last range goes on with the first.
    shards = sorted(r["shard"] for r in heads.select("shard").collect())
    links = docs.sparkSession.createDataFrame(list(zip(shards, shards[1:] + shards[:1], strict=True)), "shard int, next_shard int")
    last = found.where("kind = 'last'").select("shard", "_id", "text").join(links, "shard")
    closing = last.join(heads.withColumnRenamed("shard", "next_shard"), "next_shard").select("shard", "_id", "text", "following")
    columns = [id_back(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return found.where("kind = 'done'").select(*columns).unionByName(closing.mapInArrow(_close, DDL).select(*columns))
