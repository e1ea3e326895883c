"""Operators 1 and 7 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from usagelens.llm import names, substring_dedup, suffix_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_words(rows, length):
    """(doc_id, n_words, n_removed, kept) of each row; rows without id come last, each its own document."""
    seen, ordered = set(), sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    out = []
    for k in ordered:
        w = words_of(rows[k][1])
        gone = set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out.append((rows[k][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_bytes(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(hash(r[i : i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[hash(r[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def copied(seed, alphabet, count=120):
    """Texts stuck together from few pieces, with edits and repeats inside."""
    r = random.Random(seed)
    pieces = [" ".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(6)]
    rows = []
    for i in range(count):
        t = " ".join(r.choice(pieces) if r.random() < 0.6 else " ".join(r.choices(alphabet, k=r.randint(0, 9))) for _ in range(r.randint(0, 5)))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize(("length", "start"), [(20, 5), (7, 2), (5, 5), (9, 20)])
def test_words(spark, length, start):
    rows = copied(length, data.words(11, 300).split())
    got = substring_dedup.remove_repeats(data.docs(spark, rows), length, start).select("doc_id", "n_words", "n_removed", "text").collect()
    same(got, brute_words(rows, length))


def test_words_few_kinds(spark):
    rows = copied(5, ["ab", "ba"], 40)
    got = substring_dedup.remove_repeats(data.docs(spark, rows), 6, 3).select("doc_id", "n_words", "n_removed", "text").collect()
    same(got, brute_words(rows, 6))


def test_word_edges(spark):
    # Two rows without id hold the passage or nothing; which of equal ones is first does not show.
    rows = data.texts()
    got = substring_dedup.remove_repeats(data.docs(spark), 20).select("doc_id", "n_words", "n_removed", "text").collect()
    same(got, brute_words(rows, 20))
    assert substring_dedup.digest(substring_dedup.remove_repeats(data.empty(spark))).collect() == []


@pytest.mark.parametrize(("length", "gram"), [(40, 10), (64, 64), (17, 3)])
def test_bytes(spark, length, gram):
    rows = copied(length, data.words(12, 60).split())
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(data.docs(spark, rows), length, gram)).collect()
    same(got, brute_bytes(rows, length))


def test_bytes_in_small_pieces(spark, monkeypatch):
    rows = copied(3, ["aa", "ab"], 50)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 64)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(data.docs(spark, rows), 12, 4)).collect()
    same(got, brute_bytes(rows, 12))


def test_byte_edges(spark):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(data.docs(spark))).collect()
    same(got, brute_bytes(data.texts(), 400))
    assert suffix_dedup.remove_repeats(data.empty(spark)).collect() == []


def test_columns_and_characters_stay_whole(spark):
    rows = [(1, "é" * 30), (2, "x" + "é" * 30), (3, None), (4, "plain")]
    source = data.docs(spark, rows)
    cut = suffix_dedup.without_repeats(source, 21, 8)
    assert cut.columns == source.columns
    found = {r.doc_id: (r.text, r.n_words, r.null) for r in cut.collect()}
    assert found == {1: ("", "a", "j"), 2: ("x", "a", "j"), 3: (None, "a", "j"), 4: ("plain", "a", "j")}


def test_multikey_quicksort():
    import numpy as np

    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (700, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(rows)
    assert sorted(order.tolist()) == list(range(700))
    assert [tuple(x) for x in rows[order].tolist()] == sorted(map(tuple, rows.tolist()))


def test_names_ask_every_bucket():
    import numpy as np

    r = np.random.default_rng(1)
    chunks = [r.integers(0, 60, 80).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    held = [names.Names(c, 5, (c >> np.uint64(3)).astype(np.uint32)) for c in chunks]
    by = defaultdict(list)
    for k, n in enumerate(held):
        for row in [*n.filter_rows(k), *n.exact_rows(k, np.full(len(n.hashes), 10 - k))]:
            by[row[0]].append(row)
    replies = [names.answer(names.message(rows)) for rows in by.values()]
    counts = Counter(x for c in chunks for x in c.tolist())
    for k, n in enumerate(held):
        got = defaultdict(dict)
        for table in replies:
            for row in table.to_pylist():
                if row["chunk"] == k:
                    got[row["kind"]][row["bucket"]] = row["payload"]
        repeated = [counts[x] > 1 for x in n.hashes.tolist()]
        earlier = [any(x in chunks[j] for j in range(k + 1, 4)) for x in n.hashes.tolist()]
        assert n.answers(got[names.FILTER]).tolist() == repeated
        assert n.answers(got[names.EXACT], 0).tolist() == repeated
        assert n.answers(got[names.EXACT], 1).tolist() == earlier


@pytest.mark.parametrize(("fan", "hops"), [(6, 2), (3, 4)])
def test_repeats_over_relays(spark, monkeypatch, fan, hops):
    monkeypatch.setattr(names, "FAN", fan)
    assert names.Tree.over(32).hops == hops
    rows = copied(20, data.words(11, 300).split()) + data.texts()[:8]
    got = substring_dedup.remove_repeats(data.docs(spark, rows)).select("doc_id", "n_words", "n_removed", "text").collect()
    monkeypatch.setattr(names, "FAN", 4096)
    plain = substring_dedup.remove_repeats(data.docs(spark, rows)).select("doc_id", "n_words", "n_removed", "text").collect()
    same(got, list(map(tuple, plain)))
    rows = copied(40, data.words(12, 60).split())
    monkeypatch.setattr(names, "FAN", fan)
    got = substring_dedup.remove_repeats(data.docs(spark, rows), 12, 3).select("doc_id", "n_words", "n_removed", "text").collect()
    same(got, brute_words(rows, 12))
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(data.docs(spark, rows), 40, 10)).collect()
    same(got, brute_bytes(rows, 40))


def test_tree_reaches_every_bucket():
    for places in (32, 4096, 4097, 125_000, 12_500_000, 16_777_217):
        tree = names.Tree.over(places)
        assert tree.fan <= names.FAN and tree.fan**tree.hops >= places and (tree.hops == 1 or (tree.fan - 1) ** tree.hops < places)


def test_messages_grow_as_the_texts_do(spark, monkeypatch):
    """Four times the texts, of which every chunk has names in every range, take four times the rows, not sixteen."""
    monkeypatch.setattr(names, "FAN", 8)

    def asking(tree):
        def ask(table):
            held = names.Names(table.column("name").to_numpy().view(np.uint64), tree)
            return names.message(list(held.filter_rows(table.column("chunk")[0].as_py())))

        return ask

    sent = []
    for places in (64, 256):
        tree = names.Tree.over(places)
        rows = spark.range(places * 400).select((F.col("id") % places).cast("int").alias("chunk"), F.xxhash64("id").alias("name"))
        messages = rows.groupBy("chunk").applyInArrow(asking(tree), names.DDL)
        assert messages.count() <= places * tree.fan
        answers = names.ask(messages, tree=tree)
        found = answers.select("bucket", "chunk", "kind").collect()
        assert len(found) == len(set(found)) == messages.count() and {r.kind for r in found} == {names.FILTER}
        sent.append((messages.count(), tree.hops))
    assert [hops for _, hops in sent] == [2, 3] and sent[1][0] < 5 * sent[0][0]
