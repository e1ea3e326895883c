"""Operator 4: token ids in bit-packed files.

Format: a Parquet folder of blocks, ordered by document. A block holds whole
documents of about ``BLOCK`` ids:

    shard, block     place of the block; shards follow the ids of documents
    first            ids of the shard before this block
    first_id, last_id  its smallest and largest document
    doc_ids          documents of the block, ascending
    counts           ids of each document
    offsets          byte in ``payload`` where each document starts, and the end
    bits             bits of one id, the fewest that hold the largest id
    payload          ids in ``bits`` bits each, lowest bit first; documents start
                     on a byte

A reader finds a document by its block's offsets and unpacks it with numpy alone.
Documents are sorted by range of doc_id, so no task holds more than its range and
a block. Rows without doc_id come last; rows that share an id follow the hash of
their texts. Null text is empty, so it has the end id only. Equal rows are all
written. Empty table: empty folder, no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from usagelens.llm import pieces
from usagelens.llm.common import NO_ID, id_back, keyed

#: Ids of a block, about.
BLOCK = 1 << 16
#: Parts that a worker remembers, see ``pieces.Memory``.
REMEMBERED = 1_000_000
#: Documents, words, and bytes of text, that are encoded together.
TOGETHER, JOINED, BYTES = 2048, 200, 4 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to a byte."""
    if bits in (8, 16, 32):  # the layout of plain little-endian integers
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` ids of ``payload`` as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count).astype("<u4")
    rows = np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Encoder:
    """The tokenizers library behind a bounded memory of parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        pattern = self.library.pre_tokenizer
        # Only where the pattern splits a word from punctuation may they be encoded apart.
        self.apart = [w for w, _ in pattern.pre_tokenize_str(" a,")] == ["\u0120a", ","] if pattern else False
        self.parts, self.words = pieces.Memory(REMEMBERED), pieces.Memory(REMEMBERED // 2)
        self.rests: dict[str, bytes] = {}
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, each behind a space, many in a string: a token with a space starts each."""
        lines = [" " + " ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        found = [array(self.code, e.ids) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        if not found:
            return {}
        ids = np.concatenate([np.frombuffer(f, self.kind) for f in found])
        cuts = (np.flatnonzero(self.leads[ids]) * ids.itemsize).tolist()
        raw = ids.tobytes()
        return dict(zip(words, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast(new, add_special_tokens=False)
        return {p: array(self.code, e.ids).tobytes() for p, e in zip(new, found, strict=True)}

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``.

        Texts that hold no special token and no white space side by side are cut all
        at once, and each different part is looked up once.
        """
        plain = [i for i, t in enumerate(texts) if not pieces.has_blanks(t) and not any(s in t for s in self.special)]
        rest = sorted(set(range(len(texts))).difference(plain))
        out: list[bytes] = [b""] * len(texts)
        raws = [texts[i].encode() for i in plain]
        at, size = 0, 0
        for k, raw in enumerate(raws):
            size += len(raw)
            if size >= BYTES or k + 1 == len(raws):
                for i, ids in zip(plain[at : k + 1], self._plain(raws[at : k + 1]), strict=True):
                    out[i] = ids
                at, size = k + 1, 0
        cut = [
            [k for s, marked in pieces.special_split(texts[i], self.special) for k in ([pieces.FIRST + s] if marked else pieces.keys(s))]
            for i in rest
        ]
        for i, ids in zip(rest, self.parts.looked_up(cut, self._learn_parts), strict=True):
            out[i] = ids
        return out

    def _plain(self, raws: list[bytes]) -> list[bytes]:
        parts, held = pieces.plain_parts(raws)
        if not len(parts):
            return [b""] * len(raws)
        found = self.parts.each([pieces.key_of(p) for p in parts.dictionary.to_pylist()], self._learn_parts)
        ids = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // ids.itemsize
        which = parts.indices.to_numpy()
        counts = sizes[which]
        stops = np.cumsum(counts, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[which] - (stops - counts)
        places = np.repeat(shift, counts)
        places += np.arange(stops[-1], dtype=np.int32)
        whole = ids[places]
        # Where each text ends among the ids: with its last part.
        ends = np.append(0, stops)[np.cumsum(held)]
        return [whole[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def _learn_parts(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts by key: of their words and endings where the pattern cuts them apart."""
        split = {k: w for k in new if (w := pieces.word_of(k))} if self.apart else {}
        missing = self.words.unknown(set(split.values()))
        self.words.young |= self._learn_words([*missing])
        held, rests = self.words.young, self.rests
        if len(rests) > REMEMBERED // 8:
            rests.clear()
        rests |= self._learn([*{k[len(w) :] for k, w in split.items()}.difference(rests)])
        learned = self._learn([*{pieces.part(k) for k in new if k not in split}])
        out = {k: held[w] + rests[k[len(w) :]] for k, w in split.items()}
        out.update([(k, learned[pieces.part(k)]) for k in new if k not in split])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)


BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("bits", pa.int32()), ("payload", pa.binary()),
])
BLOCKS_DDL = "shard int, block long, first long, first_id long, last_id long, doc_ids array<long>, counts array<long>, offsets array<long>, bits int, payload binary"


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Encode each whole text, append ``end_id`` and write blocks to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        bits = max(1, max(e.size - 1, end_id).bit_length())
        end = np.array([end_id], e.kind).tobytes()
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        ids: list[int] = []
        counts: list[int] = []
        packed: list[bytes] = []

        def close() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, packed)]).tolist()
            row = [shard, block, first, ids[0], ids[-1], ids, counts, offsets, bits, b"".join(packed)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                for i, found in zip(part.column("_id").to_pylist(), e.batch(part.column("text").to_pylist()), strict=True):
                    numbers = np.frombuffer(found + end, e.kind)
                    ids.append(i)
                    counts.append(len(numbers))
                    packed.append(pack(numbers, bits))
                    held += len(numbers)
                    if held >= BLOCK:
                        yield close()
                        block, first, held = block + 1, first + held, 0
                        ids, counts, packed = [], [], []
        if ids:
            yield close()

    rows = keyed(docs).repartitionByRange("_id").sortWithinPartitions("_id", "_row").drop("_row")
    # Payloads never repeat, so a dictionary of them would only be built to be thrown away.
    written = rows.mapInArrow(run, BLOCKS_DDL).write.option("compression", "zstd").option("parquet.enable.dictionary", "false")
    written.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS_DDL).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    The only rows that meet in one task are one sum per shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "_id", "local", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                counts = row["counts"]
                sums = [
                    zlib.crc32(unpack(row["payload"][a:b], row["bits"], n).tobytes())
                    for a, b, n in zip(row["offsets"], row["offsets"][1:], counts, strict=False)
                ]
                local = row["first"] + np.cumsum([0, *counts[:-1]])
                columns = [np.full(len(counts), row["shard"], np.int32), row["doc_ids"], local, counts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

    blocks = read_blocks(spark, folder)
    per_shard = blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("ids"))
    base = per_shard.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    found = blocks.mapInArrow(run, "shard int, _id long, local long, n_tokens long, ids_crc32 long")
    return found.join(base, "shard").select("_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """Random access: the ids of each row with this doc_id."""
    wanted = NO_ID if doc_id is None else doc_id
    # The range of a block is in the files' statistics, so that only blocks that may hold the document are read.
    near = (F.col("first_id") <= wanted) & (F.col("last_id") >= wanted)
    rows = read_blocks(spark, folder).where(near).orderBy("shard", "block").collect()
    return [
        unpack(bytes(r.payload[r.offsets[k] : r.offsets[k + 1]]), r.bits, r.counts[k])
        for r in rows
        for k, i in enumerate(r.doc_ids)
        if i == wanted
    ]


def round_trip(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write, read back and describe each document."""
    write_tokens(docs, path, folder, end_id)
    return read_tokens(docs.sparkSession, folder).select(id_back(), "start", "n_tokens", "ids_crc32")
