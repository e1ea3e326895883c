"""Operator 12: the best documents for each query text, by term weights.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
lower-cased. With N documents that hold a term at all, L terms in them, n terms in one
document, df documents that hold a term and tf its places in a document:

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))     weight of a term
    m = 50 + (50 n N) div L                        what length costs a document
    score = sum over the query's terms of w ((1000000000 tf) div (1000 tf + 20 m))

A document's score for every query follows from m and from how often it holds the
terms that any query has. So documents are restricted to that vocabulary, and those
that agree in both make one class, found by hash and compared in full. Only classes
are scored, in blocks against all queries, and a task keeps the best ``top`` of each
query. A class among the best is opened again to its members by ascending doc_id. A
class stands where its smallest doc_id stands, so the best ``top`` classes by (score,
smallest doc_id) hold the best ``top`` documents. Classes of one document, the most,
need no opening. Large classes are opened by parts, each part giving its ``top``
smallest ids.

The vocabulary and the weights of one pass over the documents are held in every
task. Queries are dealt into passes so that those of one pass hold about
``MOST_TERMS`` terms; nothing else depends on the pass.

Null and term-free texts are not counted in N and never rank; a query without terms
has no rows. Equal scores rank by ascending doc_id, null last; rows that share an id
rank each for itself. Query rows that agree in id and text are one query; equal ids
with other texts are queries of their own. Empty tables give no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import NO_ID, id_back, raw_texts
from usagelens.session import materialize

#: Documents that a query gets; a fixed value of the contract.
TOP = 50
#: Query terms of one pass, about: some 100 bytes each in a task.
MOST_TERMS = 1 << 18
#: Classes that are scored together, and parts of a large group.
TOGETHER, PARTS = 512, 16

#: Bytes of terms as they are compared; all others part them.
_TERM = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(0x80)) + bytes(range(0x80, 0x100))
_TERM = _TERM.translate(bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)))


def terms(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats."""
    return raw.translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id and distinct terms of each query that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("_query"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "_query", "terms"])

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    named = rows.withColumn("_query", F.xxhash64("item_id", "text"))
    return named.mapInArrow(run, "item_id long, _query long, terms array<binary>").where(F.size("terms") > 0)


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """_id, terms of the whole text and, of the vocabulary, (term, tf) by term as pairs of unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            counts, packed = [], []
            for raw in raw_texts(batch):
                found = terms(raw)
                held = Counter(map(get, found))
                held.pop(None, None)
                counts.append(len(found))
                packed.append(np.array(sorted(held.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["_id", "n", "bag"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "_id long, n long, bag binary")


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a task hands on one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4")[::2], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    rows = found.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


class Scorer:
    """Scores of classes for all queries of a pass, from the postings of queries by term."""

    def __init__(self, queries: list[list[int]], weights: np.ndarray):
        pairs = sorted((t, q) for q, held in enumerate(queries) for t in held)
        term = np.array([t for t, _ in pairs], np.int64)
        self.queries, self.weights = np.array([q for _, q in pairs], np.int64), weights
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.count = len(queries)
        # A term gives less than a million times its weight; below 2**53 doubles add integers exactly.
        self.exact = max(map(len, queries), default=0) * int(weights.max(initial=0)) * 10**6 < 1 << 53

    def __call__(self, found: list[bytes], m: np.ndarray) -> np.ndarray:
        """Scores by class and query."""
        pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(found)), [len(b) // 8 for b in found])
        term, tf = pairs[:, 0], pairs[:, 1]
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        width = self.starts[term + 1] - self.starts[term]
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.starts[term], width)
        cell = np.repeat(row, width) * self.count + self.queries[place]
        gains = np.repeat(gain, width)
        size = len(found) * self.count
        if self.exact:
            return np.bincount(cell, gains, size).astype(np.int64).reshape(-1, self.count)
        scores = np.zeros(size, np.int64)
        np.add.at(scores, cell, gains)
        return scores.reshape(-1, self.count)


def _best(scorer: Callable, count: int, top: int) -> Callable:
    """A mapInArrow function: the best classes of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        # What is kept by query, best first: (-score, smallest id, m, bag, members).
        kept: list[list[tuple]] = [[] for _ in range(count)]
        least = np.ones(count, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found, m = part.column("bag").to_pylist(), part.column("m").to_numpy()
                ids, members = part.column("_first").to_pylist(), part.column("members").to_pylist()
                scores = score(found, m)
                for q in np.flatnonzero((scores >= least).any(axis=0)).tolist():
                    column = scores[:, q]
                    rows = np.flatnonzero(column >= least[q]).tolist()
                    best = kept[q] + [(-int(column[r]), ids[r], int(m[r]), found[r], members[r]) for r in rows]
                    best.sort()
                    kept[q] = best[:top]
                    if len(kept[q]) == top:
                        least[q] = -kept[q][-1][0]
        rows = [(q, -b[0], *b[1:]) for q, best in enumerate(kept) for b in best]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        names = ["query", "score", "_first", "m", "bag", "members"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _smallest(rows: DataFrame, group: list[str], order: list[Column], part: Column, top: int) -> DataFrame:
    """The first ``top`` rows of each group: first of each part of it, then of those."""
    at = F.row_number()
    first = rows.withColumn("_part", part).withColumn("_at", at.over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_at") <= top)
    return first.drop("_part", "_at").withColumn("_at", at.over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_at") <= top)


def _ranked_pass(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    """Ranks of the queries of one pass."""
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, held in queries for t in held}))}
    found = materialize(bags(docs, vocabulary), "bags")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(n_docs, d) for d in _frequencies(found, len(vocabulary)).tolist()], np.int64)
    numbers = [[vocabulary[t] for t in held] for _, held in queries]
    # Null where no document has a term: then nothing is scored.
    length = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    keys = ["hash", "m", "bag"]
    members = found.where(F.length("bag") > 0).select("_id", "bag", length.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    # Grouped by hash, bag and m: rows meet by hash and agree in full.
    classes = members.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count("*").alias("members"))
    best = classes.mapInArrow(
        _best(lambda: Scorer(numbers, weights), len(queries), top), "query int, score long, _first long, m long, bag binary, members long"
    ).withColumn("hash", F.xxhash64("bag", "m"))
    better = [F.col("score").desc(), F.col("_first"), F.col("hash")]
    best = materialize(_smallest(best, ["query"], better, F.pmod("hash", F.lit(PARTS)), top).drop("_at"), "best")
    # Each part of an opened class is joined in a task of its own.
    part = F.pmod(F.xxhash64("_id"), F.lit(PARTS))
    several = best.where("members > 1").select(*keys).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    opened = members.withColumn("_part", part).join(several, [*keys, "_part"]).select(*keys, "_part", "_id")
    opened = _smallest(opened, keys, [F.col("_id")], F.col("_part"), top).drop("_at")
    rows = best.where("members = 1").select("query", "score", F.col("_first").alias("_id"))
    rows = rows.unionByName(best.where("members > 1").join(opened, keys).select("query", "score", "_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("_id")))
    rows = rows.withColumn("rank", place).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(queries)], "query int, item_id long")
    return rows.join(names, "query").select("item_id", "rank", id_back(), "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each query."""
    held = materialize(query_terms(queries), "queries")
    size = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = max(1, -(-size // MOST_TERMS))
    out = None
    for number in range(passes):
        mine = held.where(F.pmod("_query", F.lit(passes)) == number).select("item_id", "terms").collect()
        rows = _ranked_pass(docs, [(r.item_id, [bytes(t) for t in r.terms]) for r in mine], top)
        out = rows if out is None else out.unionByName(rows)
    return out
