"""Operators 5 and 8 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm import data
from usagelens.llm import fingerprints, simhash
from usagelens.llm.components import components
from usagelens.session import materialize


def smallest(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rows = [(i, t) for i, t in data.texts() if i is not None] + [(100 + k, data.words(3, 120).replace("a", "A", k)) for k in range(30)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(data.docs(spark, rows)).collect()}
    marks = {i: plain_simhash(t) for i, t in rows}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2]
    groups = smallest(marks, links)
    assert got == {(i, f"{m:016x}"): groups[i] for i, m in marks.items()}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(data.docs(spark)).collect()
    assert len(got) == len(data.texts())
    # No words: linked like any other fingerprint, with the smallest id.
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {4}
    assert simhash.near_duplicates(data.empty(spark)).collect() == []


def clustered(seed, n, centres, flips):
    r = np.random.default_rng(seed)
    v = r.integers(0, 2**63, centres).astype(np.uint64)[r.integers(0, centres, n)]
    for _ in range(flips):
        v ^= (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) * (r.random(n) < 0.6).astype(np.uint64)
    return np.unique(v)


@pytest.mark.parametrize("runs", [1, 4, 300])
def test_bit_sliced_comparison(runs):
    v = np.random.default_rng(2).permutation(clustered(1, 900, 25, 3))
    keys = np.sort(np.random.default_rng(3).integers(0, runs, len(v)))
    near = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if keys[i] == keys[j] and int(v[i] ^ v[j]).bit_count() <= 2]
    expected = smallest(range(len(v)), near)
    got = simhash.close_pairs(v, keys, 2)
    assert smallest(range(len(v)), got) == expected
    assert len(got) == sum(expected[i] != i for i in expected)
    nearest = simhash.close_pairs(v, keys, 2, nearest=True)
    assert {i for p in nearest for i in p} == {i for p in near for i in p}
    assert set(nearest) <= set(near) and len(nearest) <= simhash.NEAREST * len(v)


def test_links_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 40)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    v = clustered(5, 1500, 12, 4)
    signed = v.view(np.int64).tolist()
    df = spark.createDataFrame([(x, x) for x in signed], "rep long, fp long")
    found = {r.node: r.component for r in components(simhash.links(df, 2)).collect()}
    near = [(signed[i], signed[j]) for i in range(len(v)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 2)).tolist()]
    expected = smallest(signed, near)
    assert found == {n: c for n, c in expected.items() if n != c}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 560)] + [(900, 900), (7, 901)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for p in links for n in p}
    expected = smallest(nodes, links)
    assert found == {n: c for n, c in expected.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rounds_over_few_links_write_few_files(spark, monkeypatch):
    """Each file written forks a process that counts as large as the executor; a round once wrote one for each partition."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "16")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = []

    def counted(*args):
        files.append(len((out := materialize(*args)).inputFiles()))
        return out

    monkeypatch.setattr("usagelens.llm.components.materialize", counted)
    chain = [(i, i + 1) for i in range(1, 60)]
    found = {r["node"]: r["component"] for r in components(session.createDataFrame(chain, "u long, v long")).collect()}
    assert found == dict.fromkeys(range(2, 61), 1)
    assert files[0] > 8 and len(files) > 2 and set(files[1:]) == {1}


def test_near_copies_keep_one_of_each_group(spark):
    r = random.Random(4)
    rows = []
    for k in range(25):
        base = data.words(100 + k, 150, 5000).split()
        rows.append((10 * k + 5, " ".join(base)))
        for c in range(3):
            new = list(base)
            for _ in range(2):
                new[r.randrange(len(new))] = f"edit{r.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(new)))
        rows.append((10 * k + 9, " ".join(base)))
    rows += [(1000 + k, data.words(900 + k, 80, 5000)) for k in range(40)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = smallest(sets, links)
    source = data.docs(spark, rows)
    kept = simhash.drop_near_copies(source)
    assert kept.columns == source.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in groups.items() if i == c)


def left(rows):
    """The smallest of each group at 0.8, by brute force."""
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = smallest(sets, links)
    return sorted(i for i, c in groups.items() if i == c)


def test_sub_clusters_of_one_group_are_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "ALL_PAIRS", 8)
    r = random.Random(8)
    rows = []
    for g in range(2):
        base = data.words(300 + g, 150, 5000).split()
        for c in range(20):
            original = list(base)
            for _ in range(2):
                original[r.randrange(len(base))] = f"own{r.randrange(10**6)}"
            for _ in range(10):
                new = list(original)
                new[r.randrange(len(base))] = f"edit{r.randrange(10**6)}"
                rows.append((len(rows), " ".join(new)))
    assert sorted(x.doc_id for x in simhash.drop_near_copies(data.docs(spark, rows)).collect()) == left(rows)


def test_tails_and_replaced_blocks_at_the_threshold(spark):
    rows = []
    for k in range(120):
        base = data.words(500 + k, 200, 5000).split()
        size = 34 + k % 14
        other = data.words(5000 + k, size, 5000).split()
        at = 10 + k % 90
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + other if k % 2 else base[:at] + other[: size // 2] + base[at + size // 2 :]))]
    expected = left(rows)
    assert 120 < len(expected) < 240
    assert sorted(x.doc_id for x in simhash.drop_near_copies(data.docs(spark, rows)).collect()) == expected


def test_near_copy_edges(spark):
    kept = simhash.drop_near_copies(data.docs(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids
    assert [i for i in (4, 5, 14) if i in ids] == [4]
    assert {1, 2, 3, 9, 10, 11, 12, 13, 15, -3} <= set(ids)
    assert simhash.drop_near_copies(data.empty(spark)).collect() == []


# --- fingerprints -----------------------------------------------------------


def test_fingerprint_query(spark):
    rows = [(i, t) for i, t in data.texts() if i is not None and not (i == 8)] + [(20 + k, data.words(k, 3 * k)) for k in range(40)]
    got = {r.doc_id: r for r in fingerprints.fingerprint(data.docs(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, following = t or "", following or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + following[:cut]
        a, b, c = fingerprints.sketches([x.encode() for x in (t, changed, following)])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == a.astype(">u2").tobytes().hex() and r.edited_fingerprint == b.astype(">u2").tobytes().hex()
        assert r.near_edited == fingerprints.likeness(a[None], b[None])[0] and r.near_next == fingerprints.likeness(a[None], c[None])[0]


def test_fingerprint_edges(spark):
    assert len(fingerprints.fingerprint(data.docs(spark)).collect()) == len(data.texts())
    assert fingerprints.fingerprint(data.empty(spark)).collect() == []
    (one,) = fingerprints.fingerprint(data.docs(spark, [(1, "abc abd")])).collect()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abc aab").hexdigest())


def test_likeness_follows_common_text_at_any_offset():
    base = data.words(1, 600, 3000)
    other = data.words(2, 600, 3000)
    marks = fingerprints.sketches([x.encode() for x in (base, "shifted by this " + base, base[: len(base) // 2] + other[len(other) // 2 :], other, "")])
    like = lambda k: float(fingerprints.likeness(marks[:1], marks[k : k + 1])[0])
    assert like(0) == 1 and like(1) > 0.85 and 0.25 < like(2) < 0.75 and like(3) < 0.2 and like(4) == 0


def test_one_text_has_one_fingerprint_in_any_company():
    texts = [data.words(k, 5 + 7 * k).encode() for k in range(60)] + [b"", b"a", b"aa" * 500, b"ab" * 300]
    together = fingerprints.sketches(texts)
    alone = np.concatenate([fingerprints.sketches([t]) for t in texts])
    assert (together == alone).all()


def test_levels_shrink_and_labels_differ():
    r = np.random.default_rng(0)
    symbols, owner = r.integers(0, 3, 5000).astype(np.uint8), np.zeros(5000, np.int32)
    while len(symbols) > 1:
        following, owner2 = fingerprints._level(symbols, owner)
        assert len(following) < len(symbols)
        symbols, owner = following, owner2
    heads = np.array([1, 2, 1, 3, 2, 5, 7, 1], np.uint64)
    labels = fingerprints._labels(heads, np.array([0]))
    assert (labels[1:] != labels[:-1]).all() and labels.max() < 6


def test_a_full_cell_is_compared_in_bounded_memory():
    """2,048 rows that are all alike give two million pairs, handed on block by block."""
    import tracemalloc

    rows = 2048
    columns = {"n": np.full(rows, 90), "side": np.zeros(rows, np.int64), "bits": np.zeros(rows, np.int64), "comp": np.arange(rows)}
    columns = {c: x.astype(np.int64) for c, x in columns.items()}
    tracemalloc.start()
    found = 0
    for i, j in simhash._cell_pairs(columns, 0.8, True):
        assert len(i) <= simhash.ROWS * simhash.CELL and (i != j).all()
        found += int((i < j).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == rows * (rows - 1) // 2
    assert peak < 16 << 20


def test_blocks_of_a_cell_give_every_pair_and_each_nearest():
    r = np.random.default_rng(5)
    rows = 700
    columns = {
        "n": r.integers(60, 120, rows), "side": r.integers(1, 3, rows), "bits": r.integers(0, 1 << 12, rows), "comp": r.integers(0, 40, rows)
    }
    columns = {c: x.astype(np.int64) for c, x in columns.items()}
    n, side, bits, comp = (columns[c].tolist() for c in ("n", "side", "bits", "comp"))
    fits = {
        (i, j) for i in range(rows) for j in range(rows)
        if comp[i] != comp[j] and side[i] != side[j] and (bits[i] ^ bits[j]).bit_count() <= simhash.BIN_BITS and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
    }
    every = {(min(a, b), max(a, b)) for i, j in simhash._cell_pairs(columns, 0.8, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert every == {(i, j) for i, j in fits if i < j}
    nearest = {a: b for i, j in simhash._cell_pairs(columns, 0.8, False) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert nearest.keys() == {i for i, _ in fits}
    for i, j in nearest.items():
        assert (i, j) in fits
        assert (bits[i] ^ bits[j]).bit_count() == min((bits[i] ^ bits[k]).bit_count() for a, k in fits if a == i)
