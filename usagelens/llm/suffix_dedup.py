"""Operator 7: suffix-array dedup of byte strings.

Of all suffixes only some need sorting. Every ``length``-byte window of a text has
an anchor: the leftmost of its ``GRAM``-byte grams with the smallest hash. Equal
windows have their anchors at the same place, so they are found among the suffixes
that start at equal anchors. Windows in a row with one anchor form a segment.

1. Segments whose gram occurs once are left: none of their windows is repeated.
   Segments whose whole string occurs elsewhere are done: all their windows are
   repeated, and one of each sort stands for the rest.
2. What remains becomes suffixes from the anchor on, with the bytes before it at
   hand. Splitters sampled from anchored suffixes range-partition them by leading
   bytes; a bucket sorts its suffixes by multikey quicksort, eight bytes a symbol,
   and takes common prefixes of neighbours. A window is repeated if another suffix
   agrees with it right of the anchor, by the sorted order, and left of it.
3. Windows whose bytes right of the anchor are a prefix of a splitter may have
   equals in another bucket. They are compared across boundaries by 96 bits of hash.
   So a passage that a third of all texts hold is not gathered in one bucket: the
   splitters cut its suffixes, and each chunk of texts asks about a window once.

Each byte covered by a repeated window goes. Windows are judged on the input and
never cross texts. Very long texts are cut into pieces of windows; the pieces'
segments are just shorter.

Null and empty texts have no bytes. Rows that share a doc_id, or have none, are
texts of their own; repeated rows repeat each other's bytes. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from usagelens.llm import names
from usagelens.llm.names import EXACT, FILTER, OWN, Chunk, Names, Rolling, Tree, mix

LENGTH, GRAM = 400, 64
#: Windows of a text that are looked at together, a power of 2.
PIECE = 1 << 19
#: Most suffixes sampled for splitters, and most splitters; further buckets come from the gram's hash.
SAMPLE, SPLITTERS = 8192, 4095
#: The kind of rows that hold suffixes.
SUFFIX = 3


@dataclass
class Segments:
    """Segments of a chunk: text, first and last window, anchor, hash of the gram, hashes of the whole string."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    second: np.ndarray


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: k - width], values[width - k :]) if k < width else values


def segments(raws: list[bytes], length: int, gram: int) -> Segments:
    parts: list[tuple] = []
    place = np.uint64(2 * PIECE - 1)
    for number, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, PIECE):
            data = np.frombuffer(raw, np.uint8)[at : at + PIECE + length - 1].astype(np.uint64) + np.uint64(1)
            one, two = Rolling(data), Rolling(data, 1)
            h = one.windows(gram)
            # The upper bits choose the gram, the lower ones say where it is.
            least = _smallest(h & ~place | np.arange(len(h), dtype=np.uint64), length - gram + 1)
            anchor = (least & place).astype(np.int64)
            low = np.flatnonzero(np.diff(anchor, prepend=-1))
            high = np.append(low[1:], len(anchor)) - 1
            anchor = anchor[low]
            # The anchor's place in the string is part of its name.
            inside = (anchor - low).astype(np.uint64)
            first = mix(one(low, high + length) + inside)
            second = (two(low, high + length) >> np.uint64(32)).astype(np.uint32)
            # Anchors have small hashes; mixed again, they fall in all buckets alike.
            parts.append((np.full(len(low), number), low + at, high + at, anchor + at, mix(h[anchor] + np.uint64(1)), first, second))
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint32))
    return Segments(*(np.concatenate(c) for c in zip(*parts, strict=True)))


# --- splitters --------------------------------------------------------------


def sample_splitters(docs: DataFrame, count: int, buckets: int, length: int, gram: int) -> list[bytes]:
    """Splitters of anchored suffixes, from a bounded sample that steers work only, never results."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                s = segments([raw or b""], length, gram)
                take = s.anchor[np.argsort(s.gram)[:8]]
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + length] for a in take.tolist()], pa.binary())], ["lead"])

    every = max(1, count * 8 // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(every)) == 0).select("text")
    found = sorted(bytes(r["lead"]) for r in some.mapInArrow(run, "lead binary").limit(SAMPLE).collect())
    wanted = min(buckets - 1, SPLITTERS)
    if len(found) <= wanted:
        return found
    return [found[(k + 1) * len(found) // (wanted + 1)] for k in range(wanted)]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    return int(differ.argmax()) if differ.any() else n


class Ranges:
    """Which bucket a suffix goes to, and how many of its bytes decide that."""

    def __init__(self, splitters: list[bytes], buckets: int):
        self.splitters = splitters
        self.subs = max(1, buckets // (len(splitters) + 1))

    def place(self, lead: bytes, gram: int, chunk: int) -> tuple[int, int]:
        """(bucket, fewest leading bytes that no other bucket's suffix starts with)."""
        s = self.splitters
        low, high = bisect_left(s, lead), bisect_right(s, lead)
        at = low + chunk % (high - low + 1)
        around = [s[k] for k in (low - 1, high) if 0 <= k < len(s)] + s[low : min(low + 1, high)]
        return at * self.subs + gram % self.subs, max((_common(lead, x) for x in around), default=-1) + 1


# --- a bucket ---------------------------------------------------------------


def multikey_quicksort(symbols: np.ndarray) -> np.ndarray:
    """Places of the rows in order, by ternary partitions on one symbol after the other."""
    out: list[np.ndarray] = []
    width = symbols.shape[1]
    stack = [(np.arange(len(symbols)), 0)]
    while stack:
        rows, depth = stack.pop()
        while depth < width and len(rows) > 1 and (symbols[rows, depth] == symbols[rows[0], depth]).all():
            depth += 1
        if len(rows) < 2 or depth == width:
            out.append(rows)
        elif len(rows) <= 48:
            keys = [r.tobytes() for r in symbols[rows, depth:].astype(">u8")]
            out.append(rows[sorted(range(len(rows)), key=keys.__getitem__)])
        else:
            column = symbols[rows, depth]
            pivot = np.sort(column[:: max(1, len(column) // 33)])
            pivot = pivot[len(pivot) // 2]
            stack += [(rows[column > pivot], depth), (rows[column == pivot], depth + 1), (rows[column < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes plus nothing beyond their size."""
    inside = np.arange(width) < sizes[:, None]
    out = np.zeros((len(starts), width), np.uint8)
    out[inside] = data[(starts[:, None] + np.arange(width))[inside]]
    return out


def repeated_windows(lefts: np.ndarray, rights: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Flags (record, window) of windows that another record of the bucket holds.

    Record k has ``lefts[k]`` bytes before its anchor and ``rights[k]`` from it on,
    one record after the other in ``data``, and ``windows[k]`` windows.
    """
    most = length - gram
    out = np.zeros((len(lefts), most + 1), bool)
    starts = np.cumsum(lefts + rights) - (lefts + rights)
    lead = _matrix(data, starts + lefts, rights, -(-length // 8) * 8)
    order = multikey_quicksort(lead.view(">u8").astype(np.uint64))
    same = lead[order[1:]] == lead[order[:-1]]
    shared = np.where(same.all(axis=1), lead.shape[1], same.argmin(axis=1))
    # Only suffixes that share a gram with a neighbour matter.
    near = np.concatenate([[False], shared >= gram]) | np.concatenate([shared >= gram, [False]])
    at = np.flatnonzero(near)
    if not len(at):
        return out
    rows = order[at]
    # What lies between two of them in the order shares no gram with either.
    joint = np.where(np.diff(at) == 1, shared[at[1:] - 1], 0) if len(at) > 1 else np.zeros(0, np.int64)
    back = _matrix(data[::-1], len(data) - (starts + lefts)[rows], lefts[rows], most).astype(np.uint64)
    back += np.arange(most) < lefts[rows][:, None]
    left = np.zeros((len(rows), most + 1), np.uint64)
    np.cumsum(back * names._powers(names._FACTORS[0], max(most, 1))[:most], axis=1, out=left[:, 1:])
    for before in range(most + 1):
        window = lefts[rows] - before
        valid = np.flatnonzero((window >= 0) & (window < windows[rows]))
        if len(valid) < 2:
            continue
        run = np.cumsum(np.concatenate([[True], joint < length - before])).astype(np.uint64)
        key = mix(mix(left[valid, before]) + run[valid] * np.uint64(names._FACTORS[1]))
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(valid), bool)
        hit[by[1:][equal]] = True
        hit[by[:-1][equal]] = True
        out[rows[valid[hit]], window[valid[hit]]] = True
    return out


def _suffix_payload(records: list[tuple[int, int, int, bytes]]) -> bytes:
    """(bytes left, bytes right, windows, string) of each record."""
    sizes = np.array([r[:3] for r in records], "<u4")
    return np.array([len(records)], "<u4").tobytes() + sizes.tobytes() + b"".join(r[3] for r in records)


def _suffix_answer(payloads: list[bytes], length: int, gram: int) -> list[bytes]:
    """Flags of each record's windows, one after the other."""
    counts = [int(np.frombuffer(p, "<u4", 1)[0]) for p in payloads]
    sizes = np.concatenate([np.frombuffer(p, "<u4", 3 * n, 4).reshape(n, 3) for p, n in zip(payloads, counts, strict=True)]).astype(np.int64)
    data = np.concatenate([np.frombuffer(p, np.uint8)[4 + 12 * n :] for p, n in zip(payloads, counts, strict=True)])
    found = repeated_windows(sizes[:, 0], sizes[:, 1], sizes[:, 2], data, length, gram)
    own = np.arange(found.shape[1]) < sizes[:, 2][:, None]
    cuts = np.cumsum(counts)[:-1]
    return [names.bits(f[o]) for f, o in zip(np.split(found, cuts), np.split(own, cuts), strict=True)]


# --- passes over a chunk ----------------------------------------------------


class Pass:
    """What every pass over a chunk works out anew from its texts."""

    def __init__(self, table: pa.Table, length: int, gram: int, tree: Tree, ranges: Ranges, whole: bool):
        self.whole = whole
        self.chunk = Chunk.of(table)
        self.length, self.gram, self.tree, self.ranges = length, gram, tree, ranges
        self.s = segments(self.chunk.raws, length, gram)

    def ask_names(self) -> pa.Table:
        number = self.chunk.number
        whole = Names(self.s.first, self.tree, self.s.second)
        rows = list(Names(self.s.gram, self.tree).filter_rows(number))
        rows += whole.exact_rows(number, np.full(len(whole.hashes), number))
        return names.message(rows) if rows else names.message([(number % self.tree.fan, number, OWN, b"")])

    def read_names(self, got: dict) -> tuple[np.ndarray, np.ndarray]:
        """(segments that are repeated as a whole, segments whose suffixes are sent)."""
        grams, whole = Names(self.s.gram, self.tree), Names(self.s.first, self.tree, self.s.second)
        if not len(self.s.gram):
            return np.zeros(0, bool), np.zeros(0, bool)
        some = grams.answers(got[FILTER])[grams.inverse]
        repeated, earlier = whole.answers(got[EXACT], 0), whole.answers(got[EXACT], 1)
        done = repeated[whole.inverse]
        stands = np.zeros(len(done), bool)
        stands[whole.first[repeated & ~earlier]] = True
        return done, (some & ~done) | stands

    def suffixes(self, sent: np.ndarray) -> tuple[dict[int, list[int]], np.ndarray]:
        """(bucket -> segments, for each sent segment the leading bytes that decide its bucket)."""
        by: dict[int, list[int]] = {}
        decides = np.zeros(len(sent), np.int64)
        for k in np.flatnonzero(sent).tolist():
            raw = self.chunk.raws[self.s.text[k]]
            lead = raw[self.s.anchor[k] : self.s.high[k] + self.length]
            bucket, decides[k] = self.ranges.place(lead, int(self.s.gram[k] >> np.uint64(32)), self.chunk.number)
            by.setdefault(bucket, []).append(k)
        return by, decides

    def across(self, sent: np.ndarray, decides: np.ndarray) -> tuple[np.ndarray, np.ndarray, Names]:
        """Texts, places and names of windows that may have equals in other buckets."""
        s, texts, places, first, second = self.s, [], [], [], []
        # A window at i has i + length - anchor bytes right of its anchor.
        stop = np.minimum(s.high, s.anchor + decides - self.length - 1)
        wanted = np.flatnonzero(sent & (stop >= s.low))
        for text in np.unique(s.text[wanted]).tolist():
            mine = wanted[s.text[wanted] == text]
            at = np.concatenate([np.arange(s.low[k], stop[k] + 1) for k in mine.tolist()])
            base, end = int(at.min()), int(at.max()) + self.length
            data = np.frombuffer(self.chunk.raws[text], np.uint8)[base:end].astype(np.uint64) + np.uint64(1)
            first.append(Rolling(data)(at - base, at - base + self.length))
            second.append((Rolling(data, 1)(at - base, at - base + self.length) >> np.uint64(32)).astype(np.uint32))
            texts.append(np.full(len(at), text))
            places.append(at)
        if not texts:
            none = np.zeros(0, np.int64)
            return none, none, Names(none.astype(np.uint64), self.tree, none.astype(np.uint32))
        return np.concatenate(texts), np.concatenate(places), Names(np.concatenate(first), self.tree, np.concatenate(second))

    def ask_suffixes(self, got: dict) -> pa.Table:
        s, number = self.s, self.chunk.number
        done, sent = self.read_names(got)
        by, decides = self.suffixes(sent)
        rows = [(number % self.tree.fan, number, OWN, names.bits(done) + names.bits(sent))]
        for bucket, mine in by.items():
            records = [
                (int(s.anchor[k] - s.low[k]), int(s.high[k] + self.length - s.anchor[k]), int(s.high[k] - s.low[k] + 1),
                 self.chunk.raws[s.text[k]][s.low[k] : s.high[k] + self.length])
                for k in mine
            ]
            rows.append((bucket, number, SUFFIX, _suffix_payload(records)))
        _, _, asked = self.across(sent, decides)
        rows += asked.exact_rows(number, np.zeros(len(asked.hashes), np.int64))
        return names.message(rows)

    def cut(self, got: dict) -> pa.Table:
        s, n = self.s, len(self.s.low)
        own = next(iter(got[OWN].values()))
        done, sent = names.flags(own, n), names.flags(own, n, 8 * -(-n // 8))
        by, decides = self.suffixes(sent)
        covered = [np.zeros(len(raw) + 1, np.int32) for raw in self.chunk.raws]
        for k in np.flatnonzero(done).tolist():
            covered[s.text[k]][s.low[k]] += 1
            covered[s.text[k]][s.high[k] + self.length] -= 1
        for bucket, mine in by.items():
            sizes = [int(s.high[k] - s.low[k] + 1) for k in mine]
            hit = names.flags(got[SUFFIX][bucket], sum(sizes))
            for k, flags in zip(mine, np.split(hit, np.cumsum(sizes)[:-1]), strict=True):
                at = s.low[k] + np.flatnonzero(flags)
                covered[s.text[k]][at] += 1
                covered[s.text[k]][at + self.length] -= 1
        texts, places, asked = self.across(sent, decides)
        if len(texts):
            hit = asked.answers(got[EXACT], 0)[asked.inverse]
            for text in np.unique(texts[hit]).tolist():
                at = places[hit & (texts == text)]
                covered[text][at] += 1
                covered[text][at + self.length] -= 1
        rows = []
        for doc_id, raw, steps in zip(self.chunk.doc_ids, self.chunk.raws, covered, strict=True):
            gone = np.cumsum(steps)[:-1] > 0
            if self.whole and gone.any():
                gone = _whole_characters(raw, gone)
            spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) > 0))
            kept = raw if not spans else np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), len(raw) - len(kept), spans, kept))
        out = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), KEPT, strict=True)], schema=KEPT)
        return out if self.chunk.carried is None else out.append_column("_carry", self.chunk.carried)


def _whole_characters(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """Leaves out characters that would go in part."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(raw))))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(docs: DataFrame, length: int, gram: int, whole: bool = False, carry: Column | None = None) -> DataFrame:
    if not 0 < gram <= length:
        raise ValueError("A gram must fit into a window")
    count, chunks, buckets = names.sizes(docs)
    ranges = Ranges(sample_splitters(docs, count, buckets, length, gram), buckets)
    rows, tree = names.dealt(docs, chunks, carry), Tree.over(max(chunks, buckets))

    def over(step: str):
        def run(table: pa.Table, got: dict) -> pa.Table:
            if not table.num_rows:
                return (KEPT if step == "cut" else names.SCHEMA).empty_table()
            p = Pass(table, length, gram, tree, ranges, whole)
            return getattr(p, step)(got) if got else getattr(p, step)()

        return run

    answers = names.ask(names.passed(rows, None, over("ask_names"), names.DDL), tree=tree)
    sent = names.passed(rows, answers, over("ask_suffixes"), names.DDL)
    answers = names.ask(sent, {SUFFIX: lambda payloads: _suffix_answer(payloads, length, gram)}, tree)
    schema = StructType.fromDDL(KEPT_DDL)
    if carry is not None:
        schema = schema.add(rows.schema["_carry"])
    return names.passed(rows, answers, over("cut"), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every document."""
    return _removed(docs, length, gram)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, with what remains as their text; a character that would go in part stays."""
    others = [F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(docs.columns) if c != "text"]
    cut = _removed(docs, length, gram, True, F.struct(F.col("text").isNull().alias("null"), *others))
    text = F.when(~F.col("_carry.null"), F.col("kept").cast("string"))
    return cut.select(*((text if c == "text" else F.col(f"_carry.f{k}")).alias(c) for k, c in enumerate(docs.columns)))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
