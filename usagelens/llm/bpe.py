"""Operator 6: byte-level BPE encoding and decoding.

Merges are found with a segment tree over the ranks of adjacent pairs: its root
holds the lowest rank and, among equal ranks, the leftmost place. A merge changes
three leaves, each in time logarithmic in the word's length, until the root says
that no mergeable pair is left. Short words of a batch are merged side by side,
one tree a row of a numpy array; long words have a tree of their own and stay
cheap however long they are.

Texts are first split as the vocabulary file says: special tokens, then the
byte-level pattern. A worker remembers a bounded number of words.

Null text: empty text, no ids. Equal rows give equal results, one row each. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from usagelens.llm import pieces

#: Above every key of a tree.
NONE = 1 << 62
#: Longest word, in bytes, that shares an array with others.
SHORT = 64
#: Texts that are encoded together.
TOGETHER = 128


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairTree:
    """A segment tree of keys (rank, place), the smallest at the root."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.nodes = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            left, right = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = left if left < right else right

    @property
    def root(self) -> int:
        return self.nodes[1]

    def update(self, place: int, key: int) -> None:
        nodes, i = self.nodes, place + self.size
        nodes[i] = key
        while i > 1:
            other = nodes[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if nodes[i] == key:
                return
            nodes[i] = key


class Vocabulary:
    """The vocabulary, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError("The file does not hold a byte-level BPE")
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        values = {letter: byte for byte, letter in letters.items()}
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.pair_rank = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_rank]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(values[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        before = spec["pre_tokenizer"]
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=before["add_prefix_space"], use_regex=before["use_regex"])
        self.plain = before["use_regex"] and not before["add_prefix_space"]
        self.words, self.parts = pieces.Memory(), pieces.Memory()

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Tree keys of pairs: rank and place, or NONE for pairs without a merge."""
        pair = left * self.size + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.pair_rank[at] * width + place, NONE)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The ids left when no adjacent pair can merge, with one tree."""
        n = len(symbols)
        if n < 2:
            return symbols
        found = np.array(symbols, np.int64)
        tree = PairTree(self.keys(found[:-1], found[1:], np.arange(n - 1), n).tolist())
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def key(i: int, j: int) -> int:
            return int(self.keys(np.array([symbols[i]]), np.array([symbols[j]]), np.array([i]), n)[0])

        while (top := tree.root) != NONE:
            rank, i = divmod(top, n)
            j = after[i]
            symbols[i], symbols[j] = int(self.merged[rank]), -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.update(j, NONE)
            if k < n:
                before[k] = i
            tree.update(i, key(i, k) if k < n else NONE)
            if before[i] >= 0:
                tree.update(before[i], key(before[i], i))
        return [s for s in symbols if s >= 0]

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes, each with its tree, side by side."""
        count = len(words)
        sizes = np.fromiter(map(len, words), np.int64, count)
        # One column more than places: where the last symbol's successor would be.
        symbols = np.full((count, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        symbols[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(width)
        tree = np.full((count, 2 * width), NONE, np.int64)
        tree[:, width:] = self.keys(symbols[:, :-1], symbols[:, 1:], np.broadcast_to(place, (count, width)), width)
        for low in (1 << k for k in reversed(range(width.bit_length() - 1))):
            tree[:, low : 2 * low] = tree[:, 2 * low : 4 * low].reshape(count, low, 2).min(axis=2)
        after = np.broadcast_to(np.arange(1, width + 2), (count, width + 1)).copy()
        np.minimum(after, width, out=after)
        before = np.broadcast_to(np.arange(-1, width), (count, width + 1)).copy()
        flat, sym, nxt, prv = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
        levels = width.bit_length() - 1

        def update(row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node, base = leaf + width, row * (2 * width)
            flat[base + node] = key
            for _ in range(levels):
                node >>= 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, i = np.divmod(flat[rows * (2 * width) + 1], width)
            base = rows * (width + 1)
            j = nxt[base + i]
            k = nxt[base + j]
            sym[base + i], sym[base + j] = self.merged[rank], -1
            nxt[base + i] = k
            prv[base + k] = i
            p = prv[base + i]
            update(rows, j, np.full(len(rows), NONE))
            update(rows, i, self.keys(sym[base + i], sym[base + k], i, width))
            has = p >= 0
            update(rows[has], p[has], self.keys(sym[(base + p)[has]], sym[(base + i)[has]], p[has], width))
            rows = rows[flat[rows * (2 * width) + 1] < NONE]
        left = symbols >= 0
        ids, stops = symbols[left].astype("<u4").tobytes(), 4 * np.cumsum(left.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        """Remembers the ids of short words and returns those of the others."""
        classes: dict[int, list[str]] = {}
        long = {}
        for word in words:
            n = len(word.encode())
            if n > SHORT:
                symbols = self.byte_ids[np.frombuffer(word.encode(), np.uint8)].tolist()
                long[word] = np.array(self.merge_long(symbols), "<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(word)
        for width, same in classes.items():
            self.words.young.update(zip(same, self.merge_short([w.encode() for w in same], width), strict=True))
        return long

    def _split(self, key: str) -> list[str]:
        """Words of the byte-level pattern in the part of a key."""
        if self.plain and (word := pieces.word_of(key)):
            return [" " + word, key[len(word) :]] if len(key) > len(word) else [" " + word]
        part = pieces.part(key)
        return [part[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(part)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = list(self.special)
        cut = [
            pieces.keys(t) if not any(s in t for s in special)
            else [k for s, marked in pieces.special_split(t, special) for k in ([pieces.FIRST + s] if marked else pieces.keys(s))]
            for t in texts
        ]
        return self.parts.looked_up(cut, self._learn_parts)

    def _learn_parts(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts by key."""
        split = {k: self._split(k) for k in new if pieces.part(k) not in self.special}
        missing = self.words.unknown({w for words in split.values() for w in words})
        long = self._learn_words(missing)
        held = self.words.young | long if long else self.words.young
        out = {k: b"".join([held[w] for w in words]) for k, words in split.items()}
        out.update((k, np.array([self.special[pieces.part(k)]], "<u4").tobytes()) for k in new if k not in split)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of each whole text."""

    def run(batches):
        v = vocabulary(path)
        for batch in _slices(batches):
            ids = v.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text they stand for."""

    def run(batches):
        v = vocabulary(path)
        for batch in _slices(batches):
            text = [v.decode(i) for i in batch.column("ids").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("ids"), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them.

    Encodes and decodes in one pass, so that ids need not travel between workers.
    """

    def run(batches):
        v = vocabulary(path)
        for batch in _slices(batches):
            ids = v.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(v.decode(i).encode()).hexdigest() for i in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
