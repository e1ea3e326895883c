"""Asking all other texts whether a string occurs there, in few and small rows.

Texts are dealt to chunks of bounded size by hash of doc_id. A chunk turns strings
into hashes ("names"), keeps each once, sorted, and sends one message to every
bucket its names fall in; so a string that a third of all texts hold is one entry
per chunk. A bucket puts the messages side by side and answers each with bits, in
the message's own order, that the chunk reads back when it sees its texts again.
Documents are shuffled once; the passes over a chunk read the same shuffle files.

A message to every bucket is a square of rows. Beyond ``FAN`` buckets names go by
hops: a chunk sends to ``fan`` relays, each of which holds one range of hashes of
``fan`` chunks, puts equal names together and deals the rest to ``fan`` narrower
ranges, as a chunk would; answers come back the same way. So a row stays as large as
it is at ``FAN`` buckets, and rows grow as the texts do.

Rows of messages and answers: bucket, chunk, kind, payload.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from usagelens.llm.common import NO_ID
from usagelens.session import materialize

#: Bytes of text in a chunk and of messages in a bucket, about.
CHUNK, BUCKET = 8 << 20, 8 << 20
#: Messages of a chunk at most; more buckets are reached over relays.
FAN = 4096
#: Kinds of rows: kept by the chunk for itself; hashes of 32 bits that only leave out what is unique; whole names;
#: hashes of 64 bits on their way to a relay, which come back as answers to a FILTER.
OWN, FILTER, EXACT, WIDE = 0, 1, 2, 9
DDL = "bucket int, chunk int, kind int, payload binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(factor, k, 1 << 64))
        k += m
    return out


class Rolling:
    """Hashes of substrings of a sequence of 64-bit symbols, for one of two factors."""

    #: By factor: powers and inverse powers, the longest so far.
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, lane: int = 0):
        n = len(symbols) + 1
        made = self.tables.get(lane)
        if made is None or len(made[0]) < n:
            factor, size = _FACTORS[lane], 1 << max(16, (n - 1).bit_length())
            made = _powers(factor, size), _powers(pow(factor, -1, 1 << 64), size)
            if size <= 1 << 21:
                self.tables[lane] = made
        up, self.down = made
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(symbols * up[: n - 1], out=self.sums[1:])

    def plain(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(self.plain(start, stop) + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n] + np.uint64(size))


# --- chunks -----------------------------------------------------------------


def dealt(docs: DataFrame, chunks: int, carry: Column | None = None) -> DataFrame:
    """chunk, doc_id, _order, _row and text; rows that share an id share a chunk.

    ``_order`` is doc_id; rows without one come after all others, by hash of text,
    and are spread over all chunks. ``carry`` goes along as ``_carry``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    along = [] if carry is None else [carry.alias("_carry")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *along)
    rows = rows.withColumn("_row", F.xxhash64("text"))
    late = F.lit(NO_ID - (1 << 62)) + F.shiftrightunsigned("_row", 2)
    rows = rows.withColumn("_order", F.coalesce("doc_id", late))
    chunk = F.pmod(F.xxhash64("_order", F.lit(7)), F.lit(chunks)).cast("int")
    return rows.select(chunk.alias("chunk"), "doc_id", "_order", "_row", "text", *(["_carry"] if along else []))


def sizes(docs: DataFrame) -> tuple[int, int, int]:
    """(documents, chunks, buckets) for the texts."""
    count, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total = total or 0
    return count, max(32, -(-total // CHUNK)), max(32, -(-total // BUCKET))


@dataclass(frozen=True)
class Tree:
    """``hops`` from a chunk to a bucket, each to one of ``fan`` parts of the range the hop before led to.

    A place after ``k`` hops is (chunks or relays of one group, range of hashes), as one
    number: group * fan ** k + range. Chunks are places after no hop.
    """

    fan: int
    hops: int = 1

    @staticmethod
    def over(places: int) -> Tree:
        """The fewest hops that reach so many buckets from as many chunks."""
        hops, fan = 1, places
        while fan > FAN:
            hops += 1
            fan = round(places ** (1 / hops))
            fan += fan**hops < places
        return Tree(fan, hops)

    def part(self, hashes: np.ndarray, hop: int) -> np.ndarray:
        """Which of the parts of its range a name goes to in a hop."""
        ranges = np.uint64(self.fan ** (hop + 1))
        return ((hashes >> np.uint64(32)) * ranges >> np.uint64(32)).astype(np.int64) % self.fan

    def onward(self, hop: int) -> Column:
        """The place that the part of a row, ``bucket``, is for the row's sender, ``chunk``."""
        ranges, fan = F.lit(self.fan**hop), F.lit(self.fan)
        group = F.floor(F.col("chunk") / (ranges * fan))
        return (group * ranges * fan + F.pmod("chunk", ranges) * fan + F.col("bucket")).cast("int")


@dataclass
class Chunk:
    """The texts of one chunk in order of document."""

    number: int
    doc_ids: list
    order: np.ndarray
    raws: list[bytes]
    carried: pa.ChunkedArray | None

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        # Sorts places only: Arrow's own sort does not take structs along.
        table = table.take(np.lexsort((table.column("_row").to_numpy(), table.column("_order").to_numpy())))
        raws = table.column("text").cast(pa.binary()).to_pylist()
        order = table.column("_order").to_numpy()
        carried = table.column("_carry") if "_carry" in table.column_names else None
        return Chunk(table.column("chunk")[0].as_py(), table.column("doc_id").to_pylist(), order, raws, carried)


def message(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def flags(payload: bytes, count: int, start: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little", count=start + count)[start:].view(bool)


class Names:
    """Distinct names of a chunk or relay, sorted, and which bucket or part each falls in.

    ``second`` adds 32 bits to the hash. ``inverse`` is each string's place among the
    names, ``first`` the place of each name's first string.
    """

    def __init__(self, hashes: np.ndarray, buckets: int | Tree, second: np.ndarray | None = None, hop: int = 0):
        tree = buckets if isinstance(buckets, Tree) else Tree(buckets)
        self.wide = hop + 1 < tree.hops
        order = np.argsort(hashes, kind="stable") if second is None else np.lexsort((second, hashes))
        h = hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if second is not None:
            s = second[order]
            new[1:] |= s[1:] != s[:-1]
        at = np.flatnonzero(new)
        self.hashes, self.second = h[at], None if second is None else s[at]
        self.first = order[at]
        self.multi = np.diff(np.append(at, len(h))) > 1
        self.inverse = np.empty(len(h), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.buckets, self.starts = np.unique(tree.part(self.hashes, hop), return_index=True)
        self.stops = np.append(self.starts[1:], [len(at)] * bool(len(at)))

    def filter_rows(self, chunk: int, kind: int = FILTER) -> Iterator[tuple]:
        width, kind = (np.uint64, WIDE) if self.wide else (np.uint32, kind)
        for b, i, j in zip(self.buckets.tolist(), self.starts, self.stops, strict=True):
            yield b, chunk, kind, self.hashes[i:j].astype(width).tobytes() + bits(self.multi[i:j])

    def exact_rows(self, chunk: int, order: np.ndarray, kind: int = EXACT) -> Iterator[tuple]:
        """``order`` ranks the names among the same names of other chunks."""
        for b, i, j in zip(self.buckets.tolist(), self.starts, self.stops, strict=True):
            part = order[i:j]
            base = int(part.min())
            wide = int(part.max()) - base >= 1 << 32
            rank = (part - base).astype("<u8" if wide else "<u4").tobytes()
            head = np.array([j - i, base, wide], "<i8").tobytes()
            yield b, chunk, kind, head + self.hashes[i:j].tobytes() + self.second[i:j].tobytes() + rank + bits(self.multi[i:j])

    def answers(self, replies: dict[int, bytes], block: int = 0) -> np.ndarray:
        """A flag per name; ``block`` chooses among the flags an answer holds one after the other."""
        out = np.zeros(len(self.hashes), bool)
        for b, i, j in zip(self.buckets.tolist(), self.starts, self.stops, strict=True):
            out[i:j] = flags(replies[b], j - i, block * 8 * -(-(j - i) // 8))
        return out


# --- buckets ----------------------------------------------------------------


def _filter(payloads: list[bytes]) -> list[bytes]:
    """Whether each name occurs twice at least, up to chance."""
    counts = [_filter_count(len(p)) for p in payloads]
    low = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(payloads, counts, strict=True)])
    found = np.concatenate([flags(p[4 * n :], n) for p, n in zip(payloads, counts, strict=True)])
    order = np.argsort(low, kind="stable")
    same = low[order][1:] == low[order][:-1]
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cuts = np.cumsum(counts)[:-1]
    return [bits(part) for part in np.split(found, cuts)]


def _filter_count(size: int, width: int = 4) -> int:
    """Entries of a payload of some bytes and a bit each."""
    n = size * 8 // (8 * width + 1)
    while width * n + -(-n // 8) > size:
        n -= 1
    return n


def _read_exact(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their second parts, ranks, whether a name stands there more than once)."""
    n, base, wide = np.frombuffer(payload, "<i8", 3).tolist()
    rank = np.frombuffer(payload, "<u8" if wide else "<u4", n, 24 + 12 * n).astype(np.int64) + base
    multi = flags(payload[24 + (20 if wide else 16) * n :], n)
    return np.frombuffer(payload, "<u8", n, 24), np.frombuffer(payload, "<u4", n, 24 + 8 * n), rank, multi


def _exact(payloads: list[bytes]) -> list[bytes]:
    """Two blocks of flags: the name occurs twice at least; it occurs in a place of lower order."""
    read = [_read_exact(p) for p in payloads]
    counts = [len(part[0]) for part in read]
    h, s, r, multi = (np.concatenate(x) for x in zip(*read, strict=True))
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    lowest = np.repeat(np.minimum.reduceat(r[order], at), size)
    repeated, earlier = multi.copy(), np.zeros(len(h), bool)
    repeated[order[np.repeat(size > 1, size)]] = True
    earlier[order] = r[order] > lowest
    cuts = np.cumsum(counts)[:-1]
    return [bits(a) + bits(b) for a, b in zip(np.split(repeated, cuts), np.split(earlier, cuts), strict=True)]


def answer(table: pa.Table, more: dict[int, Callable[[list[bytes]], list[bytes]]] | None = None) -> pa.Table:
    """The answers of one bucket; ``more`` adds kinds."""
    kinds = {OWN: list, FILTER: _filter, EXACT: _exact} | (more or {})
    rows = sorted(zip(*(table.column(c).to_pylist() for c in SCHEMA.names), strict=True), key=lambda r: (r[2], r[1], r[3]))
    out = []
    for kind in dict.fromkeys(r[2] for r in rows):
        mine = [r for r in rows if r[2] == kind]
        out += [(b, c, k, reply) for (b, c, k, _), reply in zip(mine, kinds[kind]([r[3] for r in mine]), strict=True)]
    return message(out)


# --- relays -----------------------------------------------------------------


class Relay:
    """The names of one kind that a group of chunks, or of relays before, sent to one range.

    ``senders`` are (chunk, names) in the order of the payloads, ``rank`` the lowest of each name.
    """

    def __init__(self, rows: list[tuple], kind: int, tree: Tree, hop: int):
        mine = sorted((c, p) for _, c, k, p in rows if k == kind)
        self.kind, payloads = kind, [p for _, p in mine]
        if kind == WIDE:
            counts = [_filter_count(len(p), 8) for p in payloads]
            hashes = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(payloads, counts, strict=True)])
            multi = np.concatenate([flags(p[8 * n :], n) for p, n in zip(payloads, counts, strict=True)])
            second, self.ranks = None, np.zeros(len(hashes), np.int64)
        else:
            read = [_read_exact(p) for p in payloads]
            counts = [len(part[0]) for part in read]
            hashes, second, self.ranks, multi = (np.concatenate(x) for x in zip(*read, strict=True))
        self.senders = list(zip((c for c, _ in mine), counts, strict=True))
        self.names = Names(hashes, tree, second, hop)
        at = self.names.inverse
        self.names.multi |= np.bincount(at, multi, len(self.names.hashes)) > 0
        self.rank = np.full(len(self.names.hashes), np.iinfo(np.int64).max)
        np.minimum.at(self.rank, at, self.ranks)

    def rows(self, place: int) -> Iterator[tuple]:
        return self.names.filter_rows(place) if self.kind == WIDE else self.names.exact_rows(place, self.rank)

    def back(self, place: int, got: dict[int, bytes]) -> Iterator[tuple]:
        """What each sender asked, from the answers to what the relay asked."""
        at, stop = self.names.inverse, 0
        repeated = self.names.answers(got)[at]
        earlier = None if self.kind == WIDE else self.names.answers(got, 1)[at] | (self.ranks > self.rank[at])
        for chunk, count in self.senders:
            start, stop = stop, stop + count
            if self.kind == WIDE:
                yield place, chunk, FILTER, bits(repeated[start:stop])
            else:
                yield place, chunk, EXACT, bits(repeated[start:stop]) + bits(earlier[start:stop])


def _relays(table: pa.Table, tree: Tree, hop: int) -> list[Relay]:
    rows = list(zip(*(table.column(c).to_pylist() for c in SCHEMA.names), strict=True))
    return [Relay(rows, kind, tree, hop) for kind in sorted({r[2] for r in rows})]


def _forward(table: pa.Table, tree: Tree, hop: int) -> pa.Table:
    place = table.column("bucket")[0].as_py()
    return message([row for relay in _relays(table, tree, hop) for row in relay.rows(place)])


def _backward(table: pa.Table, got: pa.Table, tree: Tree, hop: int) -> pa.Table:
    place, answers = table.column("bucket")[0].as_py(), replies(got)
    relays = _relays(table, tree, hop)
    return message([row for r in relays for row in r.back(place, answers[FILTER if r.kind == WIDE else EXACT])])


def _over_relays(messages: DataFrame, tree: Tree, hop: int) -> DataFrame:
    """The answers to what the places after ``hop`` hops ask."""
    routed = messages.withColumn("bucket", tree.onward(hop))
    if hop + 1 == tree.hops:
        answers = routed.groupBy("bucket").applyInArrow(lambda table: answer(table), DDL)
    else:
        sent = routed.groupBy("bucket").applyInArrow(lambda table: _forward(table, tree, hop + 1), DDL)
        sent = sent if hop + 2 == tree.hops else materialize(sent, "relayed")
        got = _over_relays(sent, tree, hop + 1).groupBy("chunk")
        answers = routed.groupBy("bucket").cogroup(got).applyInArrow(lambda table, g: _backward(table, g, tree, hop + 1), DDL)
    return answers.withColumn("bucket", F.pmod("bucket", F.lit(tree.fan)))


def ask(
    messages: DataFrame, more: dict[int, Callable[[list[bytes]], list[bytes]]] | None = None, tree: Tree | None = None
) -> DataFrame:
    """The answers to all messages; names go over the relays of ``tree``, other kinds straight to their bucket."""
    if tree is None or tree.hops == 1:
        return messages.groupBy("bucket").applyInArrow(lambda table: answer(table, more), DDL)
    messages = materialize(messages, "messages")
    relayed = F.col("kind").isin(WIDE, EXACT)
    return ask(messages.where(~relayed), more).union(_over_relays(messages.where(relayed), tree, 0))


def replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """kind -> bucket -> payload of one chunk."""
    out: dict[int, dict[int, bytes]] = {}
    for b, k, p in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
        out.setdefault(k, {})[b] = p
    return out


def passed(rows: DataFrame, answers: DataFrame | None, over: Callable[[pa.Table, dict], pa.Table], ddl: str | StructType) -> DataFrame:
    """One pass of ``over`` over every chunk with the answers it got, if any were asked before."""
    if answers is None:
        return rows.groupBy("chunk").applyInArrow(lambda table: over(table, {}), ddl)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda table, got: over(table, replies(got)), ddl)
