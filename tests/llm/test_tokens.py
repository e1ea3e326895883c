"""Operators 4 and 6 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import data
from usagelens.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["a", "the", "Er", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "!", "###", "'", "'s", "'ll", "12", "é", "ñandú", "日本", " ",
         "\x1c", " ", "🎉", "<|endoftext|>", "-", "_", "\x00", "́", "Ⅷ", "ª"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_against_the_library(library):
    r = random.Random(7)
    texts = ["".join(r.choices(ATOMS, k=r.randint(0, 25))) for _ in range(8000)] + ["x" * 400 + " " + "ab" * 500, ""]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    v, e = bpe.Vocabulary(PATH), token_files.Encoder(PATH)
    for at in range(0, len(texts), 500):
        part = slice(at, at + 500)
        assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_batch(texts[part])] == expected[part]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.batch(texts[part])] == expected[part]


def test_memory_of_parts_stays_bounded(library):
    v = bpe.Vocabulary(PATH)
    v.parts.size = v.words.size = 50
    texts = [data.words(k, 80, 1 << 16) for k in range(30)]
    found = [v.encode_batch([t])[0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(v.parts.young) + len(v.parts.old) < 500


def test_long_and_short_merges_agree():
    v = bpe.Vocabulary(PATH)
    r = random.Random(3)
    words = ["".join(r.choices("aeinrst", k=r.randint(2, 60))) for _ in range(200)]
    v._learn_words(set(words))
    for w in words:
        long = v.merge_long(v.byte_ids[np.frombuffer(w.encode(), np.uint8)].tolist())
        assert np.frombuffer(v.words.young[w], "<u4").tolist() == long


def test_round_trip(spark, library):
    got = sorted(map(tuple, bpe.round_trip(data.docs(spark), PATH).collect()), key=str)
    expected = []
    for i, t in data.texts():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        decoded = library.decode(ids.tolist(), skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(data.docs(spark), PATH), PATH).where("doc_id is not null").collect()}
    assert decoded == {i: t or "" for i, t in data.texts() if i is not None}
    assert bpe.round_trip(data.empty(spark), PATH).collect() == []


def test_decoding_broken_bytes():
    v = bpe.Vocabulary(PATH)
    first = next(i for i, b in v.bytes_of.items() if b == b"\xc3")
    assert v.decode(np.array([first], "<u4").tobytes()) == "�"


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 7, 64, 1001):
        ids = r.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert token_files.unpack(raw, bits, n).tolist() == ids.tolist()
        if n and bits < 32:
            value = sum(int(x) << (bits * k) for k, x in enumerate(ids[:7]))
            assert raw[: len(ids[:7]) * bits // 8] == value.to_bytes(64, "little")[: len(ids[:7]) * bits // 8]


def test_token_files(spark, library, tmp_path):
    folder = str(tmp_path / "tokens")
    got = token_files.round_trip(data.docs(spark), PATH, folder).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i, _ in data.texts() if i is not None)
    assert None not in ids[: -sum(i is None for i, _ in data.texts())]
    start, texts = 0, {}
    for i, t in data.texts():
        texts.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(x.tobytes())) for x in texts[r.doc_id]}
        start += r.n_tokens
    assert start == sum(len(x) for held in texts.values() for x in held)
    assert [x.tolist() for x in token_files.read_document(spark, folder, 11)] == [texts[11][0].tolist()]
    assert len(token_files.read_document(spark, folder, 8)) == 2
    assert token_files.read_document(spark, folder, 999) == []
    bits = {r.bits for r in token_files.read_blocks(spark, folder).select("bits").collect()}
    assert bits == {16}


def test_token_files_of_an_empty_table(spark, tmp_path):
    assert token_files.round_trip(data.empty(spark), PATH, str(tmp_path / "none")).collect() == []
