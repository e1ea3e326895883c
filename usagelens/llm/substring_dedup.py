"""Operator 1: substring dedup by level-wise doubling.

Windows of ``start`` words are looked at first. Those that are repeated, and only
those, are extended to twice their length, and so on up to ``length`` words or
until no candidates survive. Below the full length a window of ``length`` words
stays a candidate while its sampled sub-windows are repeated: of its sub-windows of
one level, the one with the smallest hash is looked up, which equal windows choose
alike. The last level compares whole windows of all candidates by 96 bits of hash
and tells which of the equal ones is the earliest.

A word goes if a window that covers it also starts earlier: in a smaller doc_id, or
earlier in the same document. Windows are judged on the input.

Words are what stands between spaces and the control characters 9 to 13. Null and
empty texts have no words. Rows that share a doc_id are read one after the other, by
hash of their texts, as parts of one document, but no window spans two rows. Rows
without doc_id come after all others, each its own document; equal rows among them
count as repeats. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm import names
from usagelens.llm.names import OWN, Chunk, Names, Rolling, Tree, mix
from usagelens.llm.words import bounds, slices

LENGTH, START = 20, 5


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words each text has."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in slices(raws):
        data, starts, stops, count = bounds(raws[at:stop])
        hashes.append(Rolling(data.astype(np.uint64) + np.uint64(1))(starts, stops))
        counts.append(count)
    return np.concatenate(hashes), np.concatenate(counts)


class Windows:
    """The words of a chunk, with which windows of ``length`` words lie in one text."""

    def __init__(self, chunk: Chunk, length: int):
        self.length = length
        self.words, self.counts = hash_words(chunk.raws)
        self.stops = np.cumsum(self.counts)
        self.rolling = Rolling(self.words)
        n = max(0, len(self.words) - length + 1)
        stop = np.repeat(self.stops, self.counts)[:n]
        self.inside = np.arange(n) + length <= stop

    def level(self, size: int, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash per sub-window, smallest per candidate window, places of the chosen sub-windows)."""
        h = self.rolling.windows(size)
        n, steps = len(candidates), self.length - size + 1
        low, k = h, 1
        while 2 * k <= steps:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < steps:
            low = np.minimum(low[: k - steps], low[steps - k :])
        chosen = np.zeros(len(h), bool)
        for t in range(steps):
            chosen[t : t + n] |= candidates & (h[t : t + n] == low)
        return h, low, np.flatnonzero(chosen)

    def surviving(self, size: int, candidates: np.ndarray, repeated: np.ndarray, h: np.ndarray, low: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Candidates whose chosen sub-window is repeated."""
        good = np.zeros(len(h), bool)
        good[chosen] = repeated
        out, n = np.zeros(len(candidates), bool), len(candidates)
        for t in range(self.length - size + 1):
            out |= (h[t : t + n] == low) & good[t : t + n]
        return out & candidates

    def whole(self, candidates: np.ndarray, tree: Tree) -> tuple[np.ndarray, Names]:
        """Places and names of whole candidate windows."""
        at = np.flatnonzero(candidates)
        first = self.rolling(at, at + self.length)
        second = (Rolling(mix(self.words), 1)(at, at + self.length) >> np.uint64(32)).astype(np.uint32)
        return at, Names(first, tree, second)


def _spread(chosen: np.ndarray) -> np.ndarray:
    """Chosen sub-windows have small hashes; mixed again, they fall in all buckets alike."""
    return mix(chosen + np.uint64(1))


def _own(chunk: Chunk, flags: np.ndarray, tree: Tree) -> tuple:
    return chunk.number % tree.fan, chunk.number, OWN, names.bits(flags)


def _candidates(w: Windows, got: dict) -> np.ndarray:
    """Candidates of the level before, as the chunk sent them to itself."""
    return names.flags(next(iter(got[OWN].values())), len(w.inside)) if got else w.inside


def _levels(length: int, start: int) -> list[int]:
    out = []
    while start < length:
        out.append(start)
        start *= 2
    return out


def _send(table: pa.Table, got: dict, length: int, before: int | None, size: int | None, tree: Tree) -> pa.Table:
    """One pass: reads the answers of level ``before`` and asks about level ``size``, or whole windows."""
    if not table.num_rows:
        return names.message([])
    chunk = Chunk.of(table)
    w = Windows(chunk, length)
    candidates = _candidates(w, got)
    if before is not None and candidates.any():
        h, low, chosen = w.level(before, candidates)
        asked = Names(_spread(h[chosen]), tree)
        repeated = asked.answers(got.get(names.FILTER, {}))[asked.inverse]
        candidates = w.surviving(before, candidates, repeated, h, low, chosen)
    rows = [_own(chunk, candidates, tree)]
    if candidates.any():
        if size is not None:
            h, _, chosen = w.level(size, candidates)
            rows += Names(_spread(h[chosen]), tree).filter_rows(chunk.number)
        else:
            at, asked = w.whole(candidates, tree)
            owner = np.searchsorted(w.stops, at[asked.first], side="right")
            rows += asked.exact_rows(chunk.number, chunk.order[owner])
    return names.message(rows)


def _sender(length: int, before: int | None, size: int | None, tree: Tree) -> Callable:
    return lambda table, got: _send(table, got, length, before, size, tree)


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
KEPT_DDL = "doc_id long, n_words long, n_removed long, text string"


def _cut(table: pa.Table, got: dict, length: int, tree: Tree) -> pa.Table:
    """The last pass: takes repeated words out."""
    if not table.num_rows:
        return KEPT.empty_table()
    chunk = Chunk.of(table)
    w = Windows(chunk, length)
    candidates = _candidates(w, got)
    drop = np.zeros(len(w.words) + 1, np.int32)
    if candidates.any():
        at, asked = w.whole(candidates, tree)
        later = np.ones(len(at), bool)
        later[asked.first] = asked.answers(got.get(names.EXACT, {}), 1)
        np.add.at(drop, at[later], 1)
        np.add.at(drop, at[later] + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    kept = []
    for raw, stop, count in zip(chunk.raws, w.stops.tolist(), w.counts.tolist(), strict=True):
        words = raw.split()
        mine = keep[stop - count : stop]
        kept.append(b" ".join(words if mine.all() else [words[i] for i in np.flatnonzero(mine).tolist()]))
    total = np.concatenate([[0], np.cumsum(~keep)])
    removed = total[w.stops] - total[w.stops - w.counts]
    columns = [chunk.doc_ids, w.counts, removed, pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, KEPT, strict=True)], schema=KEPT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every document."""
    _, chunks, buckets = names.sizes(docs)
    rows, tree = names.dealt(docs, chunks), Tree.over(max(chunks, buckets))
    levels = _levels(length, start)
    answers = None
    for before, size in zip([None, *levels], [*levels, None], strict=True):
        answers = names.ask(names.passed(rows, answers, _sender(length, before, size, tree), names.DDL), tree=tree)

    return names.passed(rows, answers, lambda table, got: _cut(table, got, length, tree), KEPT_DDL)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
