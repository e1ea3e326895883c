"""Operator 8: SimHash near-duplicates with bit-sliced comparison.

Fingerprints: lower-cased words, shingles with their repeats, XXH64 of each; a bit
is 1 if set in over half the hashes.

Links: fingerprints that differ in at most ``radius`` bits. Cut into ``radius + 2``
blocks, such a pair agrees in two blocks at least, so every fingerprint is dealt
under each pair of its blocks (a key). Within a key, bit planes are held vertically
- one bit of 64 fingerprints a word - and compared by exclusive or; carry-save
counters add the planes up for 64 pairs at once, and a block of candidates is left
as soon as all its pairs are beyond the radius. Keys that hold more than ``HOT``
fingerprints are dealt once more by the rest of their bits, in the same way: their
pairs agree in one of ``radius + 1`` further blocks. A key then yields links that
span what it connects, never all its pairs.

Equal fingerprints are one row in all of this, with the smallest doc_id; components
follow from star steps over links.

Null text: no words, fingerprint 0. Null doc_id: takes part as the largest id and is
returned as null. Rows that share an id are judged apart. Repeated rows stay. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import NO_ID, id_back, keyed, per_batch, raw_texts
from usagelens.llm.components import components
from usagelens.llm.names import Rolling, mix
from usagelens.llm.words import bounds
from usagelens.session import materialize

BITS, SEED = 64, 42
#: Fingerprints of one key beyond which it is dealt by further bits.
HOT, SAMPLED = 4096, 16
#: Hot keys that are broadcast at most, 12 bytes each; more are joined by a shuffle.
BROADCAST = 50_000
#: Fingerprints that are compared side by side, and of which blocks are left together.
LANES = 1 << 12
#: Nearest rows that a row is linked to under a key where links are candidates, and classes of partners over all keys.
NEAREST, CLASSES = 4, 4


def simhash(raw: bytes, width: int) -> int:
    """The fingerprint of one text."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """_id and fp (the fingerprint as a signed 64-bit integer) of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((simhash(t, width) for t in raw_texts(batch)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64))], ["_id", "fp"])

    return keyed(docs).select("_id", "text").mapInArrow(per_batch(run), "_id long, fp long")


# --- bit-sliced comparison --------------------------------------------------


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of 64 values a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _within(planes: np.ndarray, flips: np.ndarray | None, radius: int) -> np.ndarray:
    """Lanes whose planes (exclusive or ``flips``, a row a plane) have at most ``radius`` ones.

    ``counters`` is the number of ones so far in binary, a plane a digit, saturating
    in ``beyond``.
    """
    digits = radius.bit_length()
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(digits)]
    beyond = np.zeros(planes.shape[1], np.uint64)
    full = np.uint64(2**64 - 1)
    for b in range(BITS):
        carry = planes[b] if flips is None else planes[b] ^ flips[b]
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        beyond |= carry
        if b % 8 == 7:
            over = _above(counters, radius) | beyond
            if (over == full).all():
                return np.zeros(planes.shape[1], np.uint64)
    return ~(_above(counters, radius) | beyond)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius."""
    over = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], np.uint64(2**64 - 1))
    for d in reversed(range(len(counters))):
        if radius >> d & 1:
            equal &= counters[d]
        else:
            over |= equal & counters[d]
            equal &= ~counters[d]
    return over


def _lanes(words: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:count].view(bool)


class _Union:
    """Which rows of one batch hang together; the root is the smallest place."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def close_pairs(values: np.ndarray, keys: np.ndarray, radius: int, nearest: bool = False) -> list[tuple[int, int]]:
    """Links (places) that span what is connected within each run of equal keys; with ``nearest``, links to the nearest."""
    n = len(values)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    union = _Union(n)
    met: list[tuple[np.ndarray, np.ndarray]] = []
    room = np.repeat(starts + sizes, sizes) - np.arange(n)
    # Short runs: all of them at once, each row with the row `shift` places on.
    at = np.flatnonzero(np.repeat(sizes <= 64, sizes) & (room > 1))
    shift = 1
    while len(at):
        for part in (at[k : k + 64 * LANES] for k in range(0, len(at), 64 * LANES)):
            hit = part[_lanes(_within(_planes(values[part] ^ values[part + shift]), None, radius), len(part))]
            for i in hit.tolist():
                union.join(i, i + shift)
            met += [(hit, hit + shift), (hit + shift, hit)]
        shift += 1
        at = at[room[at] > shift]
    # Long runs: each row against blocks of rows.
    full = np.uint64(2**64 - 1)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for low in range(start, start + size, LANES):
            block = values[low : min(low + LANES, start + size)]
            planes = _planes(block)
            for i in range(start, start + size if nearest else low + len(block)):
                flips = np.where(values[i] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1), full, np.uint64(0))
                hit = low + np.flatnonzero(_lanes(_within(planes, flips, radius), len(block)))
                for j in hit[hit > i].tolist():
                    union.join(i, j)
                if nearest:
                    hit = hit[hit != i]
                    hit = hit[np.argsort(np.bitwise_count(values[hit] ^ values[i]), kind="stable")[:NEAREST]]
                    met.append((np.full(len(hit), i), hit))
    if not nearest:
        return [(root, i) for i in range(n) if (root := union.find(i)) != i]
    if not met:
        return []
    a, b = (np.concatenate(side) for side in zip(*met, strict=True))
    order = np.lexsort((b, np.bitwise_count(values[a] ^ values[b]), a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    near = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < NEAREST
    return sorted({(min(p), max(p)) for p in zip(a[near].tolist(), b[near].tolist(), strict=True)})


# --- dealing ----------------------------------------------------------------


def _bits_of(values: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits at some places as one number; neighbouring places are taken together."""
    out = np.zeros(len(values), np.uint64)
    cuts = [k for k in range(1, len(places)) if places[k] != places[k - 1] + 1]
    for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
        field = values >> np.uint64(places[a]) & np.uint64((1 << (b - a)) - 1)
        out = out << np.uint64(b - a) | field
    return out


def _groups(places: list[int], count: int) -> list[list[int]]:
    """Places cut into groups of nearly equal size."""
    cuts = [len(places) * k // count for k in range(count + 1)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _kinds(blocks: int, agree: int) -> list[tuple[list[int], list[int]]]:
    """(bits of the key, bits that stay open) for every choice of ``agree`` of the blocks."""
    cut = _groups(list(range(BITS)), blocks)
    out = []
    for chosen in combinations(range(blocks), agree):
        out.append(([b for k in chosen for b in cut[k]], [b for k in range(blocks) if k not in chosen for b in cut[k]]))
    return out


LINKS_DDL = "u long, v long, apart int"
_DEALT = "rep long, fp long, key long"
#: The lowest bits of a key say which choice of blocks it is.
_KIND = np.uint64(0xFF)


def links(distinct: DataFrame, radius: int = 2, blocks: int | None = None, agree: int = 2, nearest: bool = False) -> DataFrame:
    """Links u, v of rows (rep, fp) that are close and meet under a key, with how many bits they are apart.

    Keys are choices of ``agree`` of ``blocks`` blocks, ``radius + agree`` blocks
    unless given; all pairs that differ in ``blocks - agree`` bits meet. Links span
    what is connected; with ``nearest`` they go from each row to its ``NEAREST``
    rows under each key, for a check of their own.
    """
    blocks = radius + agree if blocks is None else blocks
    if blocks * 4 > BITS or blocks < agree or comb(blocks, agree) > 1 << 8:
        raise ValueError("Keys of this radius would have too few bits or be too many")
    kinds = _kinds(blocks, agree)
    further = [_groups(rest, blocks - agree + 1) for _, rest in kinds]

    def named(kind: int, *parts: np.ndarray) -> np.ndarray:
        """One number for a key; were two keys to share one, more rows would be compared."""
        found = np.full(len(parts[0]), kind + 1, np.uint64)
        for part in parts:
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + part)
        return found & ~_KIND | np.uint64(kind)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        rep, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "fp"))
        keys = np.concatenate([named(k, _bits_of(fp.view(np.uint64), own)) for k, (own, _) in enumerate(kinds)])
        columns = [np.tile(rep, len(kinds)), np.tile(fp, len(kinds)), keys.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "fp", "key"])

    def deal_further(batch: pa.RecordBatch) -> pa.RecordBatch:
        rep, fp, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "fp", "key"))
        kind = (key.view(np.uint64) & _KIND).astype(np.int64)
        parts = []
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            for part, places in enumerate(further[k]):
                sub = _bits_of(fp[at].view(np.uint64), places)
                parts.append((rep[at], fp[at], named(k, key[at].view(np.uint64), np.full(len(at), part, np.uint64), sub).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["rep", "fp", "key"])

    rows = distinct.select("rep", "fp")
    dealt = rows.mapInArrow(per_batch(deal), _DEALT)
    # Which keys are hot is read off one row in SAMPLED; that steers work, not results.
    some = rows.where(F.pmod(F.xxhash64("rep", "fp"), F.lit(SAMPLED)) == 0).mapInArrow(per_batch(deal), _DEALT)
    counts = some.groupBy("key").count().where(F.col("count") > HOT // SAMPLED)
    hot = materialize(counts.select("key"), "simhash_hot")
    many = hot.count()
    groups = dealt
    if many:
        side = F.broadcast(hot) if many <= BROADCAST else hot
        spread = dealt.join(side, "key", "left_semi").select("rep", "fp", "key").mapInArrow(per_batch(deal_further), _DEALT)
        groups = dealt.join(side, "key", "left_anti").select("rep", "fp", "key").union(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def compare(columns: list[np.ndarray]) -> pa.RecordBatch | None:
            rep, fp, key = columns[0], columns[1].view(np.uint64), columns[2]
            found = close_pairs(fp, key, radius, nearest)
            if not found:
                return None
            i, j = (list(side) for side in zip(*found, strict=True))
            apart = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j]), pa.array(apart)], ["u", "v", "apart"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "fp", "key")]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            # The last key may go on in the next batch.
            stop = int(np.searchsorted(columns[2], columns[2][-1]))
            held = [c[stop:] for c in columns]
            if stop and (out := compare([c[:stop] for c in columns])) is not None:
                yield out
        if held is not None and len(held[0]) and (out := compare(held)) is not None:
            yield out

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKS_DDL)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of candidate pairs u, v, those whose sketches may be ``similarity`` alike, with the estimate.

    Sketches are estimates: a pair is left out that lies four standard deviations
    below, fewer bins allowing for more.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("a", "b"))
        held, same = (a != 255) | (b != 255), (a == b) & (a != 255)
        bins = np.maximum(held.sum(axis=1), 1)
        likely = same.sum(axis=1) / bins
        likely[~held.any(axis=1)] = 1.0
        keep = likely >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / bins)
        columns = [batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep)), pa.array(likely[keep])]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "likely"])

    sketches = nodes.select("rep", "sketch")
    both = pairs.join(sketches.select(F.col("rep").alias("u"), F.col("sketch").alias("a")), "u")
    both = both.join(sketches.select(F.col("rep").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(per_batch(run), "u long, v long, likely double")


def likeliest_links(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of the likely pairs, each node's best in each of ``CLASSES`` classes of partners.

    A minimum per node and class, so that a node with very many candidates is
    combined before the shuffle; the best of all is always among them.
    """
    found = likely_pairs(pairs, nodes, similarity)
    ends = F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("other")), F.struct(F.col("v").alias("n"), F.col("u").alias("other")))
    sides = found.select("likely", F.inline(ends))
    best = sides.groupBy("n", F.pmod(F.xxhash64("other"), F.lit(CLASSES)).alias("class")).agg(F.min(F.struct(-F.col("likely"), "other")).alias("_b"))
    return best.select(F.least("n", "_b.other").alias("u"), F.greatest("n", "_b.other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = materialize(fingerprints(docs, width), "simhash")
    distinct = materialize(found.groupBy("fp").agg(F.min("_id").alias("rep")), "simhash_distinct")
    # rep may repeat where rows share an id: fingerprints themselves are the nodes.
    nodes = links(distinct.select(F.col("fp").alias("rep"), "fp"), radius)
    member = components(nodes)
    joined = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    first = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(first, "component").select("fp", "component_id")
    return found.join(named, "fp").select(
        id_back(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back("component_id").alias("component_id")
    )


# --- near copies ------------------------------------------------------------

#: Words of fewer bytes are in every text and say little about which it is.
LONG_WORD = 4
#: A first pass: pairs that differ in at most ``FAR`` bits and agree in ``AGREE`` of ``BLOCKS`` blocks, all up to 7 bits, most beyond.
FAR, BLOCKS, AGREE = 12, 10, 3
#: Bins of a sketch.
SKETCH = 128


def word_simhash(raw: bytes) -> int:
    """The fingerprint of the distinct longer words of a text, or of all its words."""
    words = {w.strip(b".,;:!?\"'()[]") for w in raw.lower().split()}
    words = {w for w in words if len(w) >= LONG_WORD} or words
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(words), bitorder="little").view(np.uint64)[0])


def shingle_set(raw: bytes, width: int) -> bytes:
    """Sorted 32-bit hashes of the distinct shingles of lower-cased words."""
    data, starts, stops, _ = bounds([raw.lower()])
    if not len(starts):
        return b""
    words = Rolling(data.astype(np.uint64) + np.uint64(1))(starts, stops)
    n = max(1, len(words) - width + 1)
    at = np.arange(n)
    found = Rolling(words)(at, np.minimum(at + width, len(words)))
    return np.unique((found >> np.uint64(32)).astype("<u4")).tobytes()


def sketch(shingles: bytes) -> bytes:
    """The smallest hash in each of ``SKETCH`` bins, in a byte; 255 for an empty bin."""
    hashes = np.frombuffer(shingles, "<u4")
    out = np.full(SKETCH, 255, np.uint8)
    # Each byte is the lowest of its bin's hashes by its other bits, folded.
    mixed = mix(hashes.astype(np.uint64) + np.uint64(1))
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    place = (mixed & np.uint64(SKETCH - 1)).astype(np.int64)
    np.minimum.at(least, place, mixed)
    out[np.unique(place)] = (least[np.unique(place)] >> np.uint64(20)) % np.uint64(255)
    return out.tobytes()


def _alike(a: bytes, b: bytes) -> float:
    """The share of common shingles."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


# Pairs beyond the fingerprints' reach, complete at the similarity: of two sets that are alike, the first shingles of one global
# order (rarest first, as many as may be missing and one more) have one in common.

#: Shingles that come last in the order, and rows under a key beyond which its pairs are not judged at once.
COMMON, ALL_PAIRS = 100_000, 32
#: Rows of a cell that are compared side by side; keys with more are dealt to several cells.
CELL = 1024
#: Rows of a block that are compared with so many, and pairs that a task hands on together.
ROWS, HANDED = 128, 1 << 16
#: Pairs of sets that a task judges, by the number of pairs, or by that of the round before where it is not known yet.
JUDGED = 5_000
#: Of the lowest bits of 64 bins, one in ten differs at 0.8 and half in strangers; 20 are over five standard deviations off.
BIN_BITS = 20


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, class) of the shingles that most texts hold, read off one text in SAMPLED; any choice gives the same links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(shingle_set(r, width), "<u4") for r in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, "<u4")]).astype(np.int64))], ["h"])

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(per_batch(run), "h long")
    top = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count")).limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().astype(np.uint32), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(n[order].astype(np.float64)).astype(np.uint64) + np.uint64(1)


def prefix(shingles: bytes, similarity: float, known: np.ndarray, rank: np.ndarray) -> bytes:
    """The set's first shingles, one of which every set of that similarity has among its own first; a set of none has one name of its own."""
    hashes = np.frombuffer(shingles, "<u4")
    if not len(hashes):
        return np.zeros(1, "<u4").tobytes()
    place = np.zeros(len(hashes), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        place = np.where(known[at] == hashes, rank[at], np.uint64(0))
    order = (place << np.uint64(58)) | (mix(hashes.astype(np.uint64) + np.uint64(1)) >> np.uint64(6))
    count = int(len(hashes) * (1 - similarity) + 1e-6) + 1
    return hashes[np.argsort(order, kind="stable")[:count]].tobytes()


def bin_bits(sketched: bytes) -> int:
    """The lowest bits of the first 64 bins as a signed number."""
    return int(np.packbits(np.frombuffer(sketched, np.uint8)[:64] & 1, bitorder="little").view(np.int64)[0])


_KEYED = "key long, cell long, side int, rep long, n int, bits long, comp long"


def _keyed(nodes: DataFrame) -> DataFrame:
    """A row per node (rep, n, bits, prefix, comp) and shingle of its prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(p, "<u4") for p in batch.column("prefix").to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        key = np.concatenate([*sets, np.zeros(0, "<u4")]).astype(np.int64)
        none = np.zeros(len(key), np.int64)
        rest = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("rep", "n", "bits", "comp")]
        columns = [key, none, none.astype(np.int32), *rest]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cell", "side", "rep", "n", "bits", "comp"])

    return nodes.select("rep", "n", "bits", "prefix", "comp").mapInArrow(per_batch(run), _KEYED)


def _cell_pairs(columns: dict[str, np.ndarray], similarity: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in one cell that may be alike and are in two components, block by block; each row's nearest, or with ``every`` all."""
    n, comp, side = (columns[c] for c in ("n", "comp", "side"))
    bits = columns["bits"].view(np.uint64)
    for low in range(0, len(n), ROWS):
        i = np.arange(low, min(low + ROWS, len(n)))
        best, where = np.full(len(i), 255, np.uint8), np.zeros(len(i), np.int64)
        for from_ in range(low if every else 0, len(n), CELL):
            j = np.arange(from_, min(from_ + CELL, len(n)))
            apart = np.bitwise_count(bits[i][:, None] ^ bits[j][None, :])
            fits = (comp[i][:, None] != comp[j][None, :]) & (apart <= BIN_BITS)
            # Sides 1 and 2 of a cell meet each other only.
            fits &= (side[i][:, None] == 0) | (side[i][:, None] != side[j][None, :])
            # The smaller set must be large enough beside the larger one, whichever that is.
            fits &= n[i][:, None] >= similarity * n[j][None, :] - 1e-6
            fits &= n[j][None, :] >= similarity * n[i][:, None] - 1e-6
            if every:
                a, b = np.nonzero(fits)
                yield i[a], j[b]
            else:
                apart = np.where(fits, apart, 255).astype(np.uint8)
                at = apart.argmin(axis=1)
                found = apart[np.arange(len(i)), at]
                where, best = np.where(found < best, j[at], where), np.minimum(best, found)
        if not every:
            yield i[best < 255], where[best < 255]


def _pairs_under(cells: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Pairs u, v that meet in a cell; a row (key, null) for each key whose pairs are not all among them."""
    names = ["key", "cell", "side", "rep", "n", "bits", "comp"]

    def pairs(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(held["key"]), bool)
        new[1:] = (held["key"][1:] != held["key"][:-1]) | (held["cell"][1:] != held["cell"][:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(new))
        u, v, wide, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            """Pairs, smaller node first, and the wide keys; pairs may repeat."""
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (u, v))
            none = np.arange(len(a) + len(wide)) >= len(a)
            left = np.concatenate([np.minimum(a, b), np.array(wide, np.int64)])
            right = np.concatenate([np.maximum(a, b), np.zeros(len(wide), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=none)], ["u", "v"])

        for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist(), strict=True):
            part = {c: x[a:b] for c, x in held.items()}
            small = b - a <= ALL_PAIRS and part["cell"][0] == 0
            if not every and not small:
                wide.append(part["key"][0])
            for i, j in _cell_pairs(part, similarity, every or small):
                u.append(part["rep"][i])
                v.append(part["rep"][j])
                size += len(i)
                if size > HANDED:
                    yield out()
                    u, v, wide, size = [], [], [], 0
        yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            if held is not None:
                columns = {c: np.concatenate([held[c], columns[c]]) for c in names}
            # The last cell may go on in the next batch.
            other = (columns["key"] != columns["key"][-1:]) | (columns["cell"] != columns["cell"][-1:])
            stop = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = {c: x[stop:] for c, x in columns.items()}
            if stop:
                yield from pairs({c: x[:stop] for c, x in columns.items()})
        if held is not None and len(held["key"]):
            yield from pairs(held)

    dealt = cells.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(run, "u long, v long")


def _salted(rows: DataFrame, hot: DataFrame, turn: int) -> DataFrame:
    """Rows under hot keys dealt to cells of about ``CELL`` rows, other cells in every turn."""
    side = F.broadcast(hot) if hot.count() <= BROADCAST else hot
    cells = F.greatest(F.lit(1), F.floor(F.col("_rows") / CELL))
    named = rows.drop("cell").join(side, "key", "left")
    cell = F.when(F.col("_rows").isNotNull(), 1 + F.pmod(F.xxhash64("rep", "key", F.lit(turn)), cells)).otherwise(F.lit(0))
    return named.withColumn("cell", cell.cast("long")).drop("_rows")


def _all_cells(rows: DataFrame) -> DataFrame:
    """Rows dealt so that all pairs of two components under a key meet once at least.

    Rows of the key's largest component meet the others only, which are sent to all
    cells; so one large component beside few rows is dealt about once.
    """
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("_c"))
    keys = counts.groupBy("key").agg(F.max(F.struct("_c", "comp")).alias("_m"), F.sum("_c").alias("_all"), F.count("*").alias("_k")).where("_k > 1")
    keys = keys.select("key", F.col("_m.comp").alias("_main"), F.ceil(F.col("_m._c") / CELL).alias("_gm"), F.ceil((F.col("_all") - F.col("_m._c")) / CELL).alias("_gr"))
    own = rows.drop("cell", "side").join(keys, "key")
    own = own.withColumn("_at", F.pmod(F.xxhash64("rep"), F.when(F.col("comp") == F.col("_main"), F.col("_gm")).otherwise(F.col("_gr"))))
    # Cells are numbered 1 + main group * (groups of the rest) + group, and below 0 for two groups of the rest.
    steps = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    main = steps(F.col("_gr"), lambda k: F.struct((1 + F.col("_at") * F.col("_gr") + k).alias("cell"), F.lit(1).alias("side")))
    rest = steps(F.col("_gm"), lambda k: F.struct((1 + k * F.col("_gr") + F.col("_at")).alias("cell"), F.lit(2).alias("side")))
    pair = lambda k: -1 - (F.least("_at", k) * F.col("_gr") + F.greatest("_at", k))
    among = steps(F.col("_gr"), lambda k: F.struct(pair(k).alias("cell"), F.when(k == F.col("_at"), 0).when(k > F.col("_at"), 1).otherwise(2).alias("side")))
    cells = F.when(F.col("comp") == F.col("_main"), main).otherwise(F.concat(rest, among))
    return own.select("key", "rep", "n", "bits", "comp", F.inline(cells))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The documents, all columns, one of each group of near copies.

    A link is a pair whose word shingles agree to ``similarity`` (common ones among
    all). Candidates come from fingerprints of longer words, which few edits move
    little, and from shared rare shingles, of which every such pair has one. Rounds
    link nodes to their nearest in other components until one adds no link; then
    every pair that still is in two components is judged. Of a group of linked
    documents the one with the smallest doc_id stays; rows without doc_id come after
    all others. Rows that share a doc_id stay or go together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID - (1 << 62)) + F.shiftrightunsigned(F.xxhash64(text), 2))
    rows = docs.select(order.alias("_order"), text.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, width))

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = raw_texts(batch)
        found = np.fromiter(map(word_simhash, raws), np.uint64, len(raws))
        digests = pa.array([hashlib.md5(r, usedforsecurity=False).digest() for r in raws], pa.binary())
        sets = [shingle_set(r, width) for r in raws]
        sketches = [sketch(s) for s in sets]
        firsts = pa.array([prefix(s, similarity, *common.value) for s in sets], pa.binary())
        rest = [pa.array([len(s) // 4 for s in sets], pa.int32()), pa.array(map(bin_bits, sketches), pa.int64()), firsts]
        columns = [batch.column("_order"), pa.array(found.view(np.int64)), digests, pa.array(sketches, pa.binary()), *rest]
        return pa.RecordBatch.from_arrays(columns, ["_order", "fp", "digest", "sketch", "n", "bits", "prefix"])

    ddl = "_order long, fp long, digest binary, sketch binary, n int, bits long, prefix binary"
    found = materialize(rows.mapInArrow(per_batch(prints), ddl), "copies")
    # Exact copies are one node, the smallest.
    held = ["fp", "sketch", "n", "bits", "prefix"]
    kept = found.groupBy("digest").agg(F.min("_order").alias("rep"), *[F.min(c).alias(c) for c in held])
    kept = materialize(kept, "copies_nodes")
    nodes = kept.select("rep", *held)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.array([shingle_set(r, width) for r in raw_texts(batch)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("_order"), held], ["_order", "set"])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike = [_alike(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        keep = pa.array(np.array(alike, np.float64) >= similarity)
        return pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    known: list[DataFrame] = []

    def alike(pairs: DataFrame, about: int | None = None) -> tuple[DataFrame, int]:
        """Those of the pairs that are links, and the number of pairs; ``about`` so many are expected, which steers files only."""
        pairs = materialize(pairs, "copies_pairs", None if about is None else 1 + about // JUDGED)
        count = pairs.count()
        files = 1 + count // JUDGED
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("_order")).distinct()
        for held in known:
            wanted = wanted.join(held.select("_order"), "_order", "left_anti")
        if not known or not wanted.isEmpty():
            # Texts are joined by a sort merge at every size; a side that Spark may broadcast when small would not stay small.
            shingles = rows.join(wanted.hint("merge"), "_order", "left_semi").mapInArrow(per_batch(sets), "_order long, set binary")
            known.append(materialize(shingles.dropDuplicates(["_order"]), "copies_shingles", files))
        shingles = reduce(DataFrame.union, known)
        both = pairs.join(shingles.select(F.col("_order").alias("u"), F.col("set").alias("a")), "u")
        both = both.join(shingles.select(F.col("_order").alias("v"), F.col("set").alias("b")), "v")
        found = both.select("u", "v", "a", "b").mapInArrow(per_batch(judge), "u long, v long")
        return materialize(found, "copies_links", files), count

    def labelled(member: DataFrame | None) -> DataFrame:
        """The nodes' prefixes, a row a shingle, with the nodes' components."""
        if member is None:
            return _keyed(nodes.withColumn("comp", F.col("rep")))
        named = nodes.join(member, nodes["rep"] == member["node"], "left")
        return _keyed(named.withColumn("comp", F.coalesce("component", "rep")))

    some = _keyed(nodes.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).withColumn("comp", F.col("rep")))
    # Which keys are hot only steers work: all pairs of two components under a key that is hot or wide are judged in the end.
    hot = some.groupBy("key").agg((F.count("*") * SAMPLED).alias("_rows")).where(F.col("_rows") > 2 * CELL)
    hot = materialize(hot, "copies_hot")
    near = links(nodes.select("rep", "fp"), FAR, BLOCKS, AGREE, nearest=True).select("u", "v").where("u != v").distinct()
    met = materialize(_pairs_under(_salted(labelled(None), hot, 0), similarity, False), "copies_met")
    wide = materialize(met.where("v is null").select(F.col("u").alias("key")).union(hot.select("key")).distinct(), "copies_wide")
    first = likely_pairs(met.where("v is not null").distinct(), nodes, similarity).select("u", "v")
    linked, count = alike(likeliest_links(near, nodes, similarity).union(first).distinct())
    member = components(linked)
    if not wide.isEmpty():
        side = F.broadcast(wide) if wide.count() <= BROADCAST else wide
        turn, more = 1, True
        while more:
            cells = _salted(labelled(member).join(side, "key", "left_semi"), hot, turn)
            met = _pairs_under(cells, similarity, False).where("v is not null").distinct()
            found_links, count = alike(likely_pairs(met, nodes, similarity).select("u", "v"), count)
            more, turn = not found_links.isEmpty(), turn + 1
            if more:
                member = components(member.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found_links))
        rest = _all_cells(labelled(member).join(side, "key", "left_semi"))
        met = _pairs_under(rest, similarity, True).where("v is not null").distinct()
        last, _ = alike(likely_pairs(met, nodes, similarity).select("u", "v"))
        if not last.isEmpty():
            member = components(member.select(F.col("node").alias("u"), F.col("component").alias("v")).union(last))
    # Goes: an exact copy of a smaller document, or a member of a group that is not its smallest.
    # Copies are found by document and digest, so that a text that many documents share is no hot key.
    exact = found.select("_order", "digest").join(kept.select(F.col("rep").alias("_order"), "digest"), ["_order", "digest"], "left_anti")
    gone = exact.select("_order").union(member.select(F.col("node").alias("_order"))).distinct()
    marked = docs.select(F.struct("*").alias("_all"), order.alias("_order"))
    return marked.join(gone.hint("merge"), "_order", "left_anti").select("_all.*")
