"""Operator 11 against a plain tree, and the layout of its subtrees."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from usagelens.llm import manifest
from usagelens.session import new_path

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, n long, digest string, _at string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    i, source, lang, n, text = row
    fields = [i, source, lang, None if n is None else n + more, text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    return [("" if at >> k ^ 1 >= len(level) else level[at >> k ^ 1], at >> k & 1) for k, level in enumerate(levels[:-1])]


def brute(rows, touched):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        own = sorted([r for r in rows if r[2] == lang], key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        order[lang], trees[lang] = own, levels_of([leaf_of(r) for r in own])
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, row in enumerate(order[lang]):
            way = siblings(trees[lang], at) + siblings(top, k)
            now = leaf_of(row, int(touched(row[0])))
            for other, side in way:
                now = sha(other + now if side else now + other)
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, sha("".join(x for x, _ in way)), now, now == root))
    return out


def touched(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def run(spark, rows, parts=3, height=10):
    docs = spark.createDataFrame([(*r, "t", 5, 6, "d", "a") for r in rows], DOCS).repartition(parts)
    seven = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    found = {"n_chars": F.col("n_chars") + F.when(seven, 1).otherwise(0)}
    made = manifest.write_manifest(docs, new_path(spark, "manifest"), found, height)
    return made, [tuple(r) for r in manifest.audit(spark, made).collect()]


def key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


def rows_of(seed, count):
    r = random.Random(seed)
    rows = [
        (r.choice([None, *range(-3, 4 * count)]), r.choice(["web", "", None]), r.choice([None, "", "de", "en", "Zz", "é"]), r.choice([None, 0, 7]), t)
        for t in (r.choice([None, "", "a", "ü🎉", data.words(k, 20)]) for k in range(count))
    ]
    return rows + rows[: count // 4]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_is_the_plain_tree(spark, height):
    """Small subtrees make several tables over documents and over languages."""
    rows = rows_of(height, 90)
    made, got = run(spark, rows, height=height)
    assert (made.trees, made.over) == {1: (5, 3), 2: (3, 2), 10: (1, 1)}[height]
    assert sorted(got, key=key) == sorted(brute(rows, touched), key=key)


def test_one_long_language_over_two_tables(spark):
    """More leaves than one subtree holds, the last subtree short."""
    rows = [(i, "s", "en", i, f"t{i}") for i in range(2 * 1024 + 1)]
    made, got = run(spark, rows, 7)
    assert made.trees == 2 and sorted(got) == sorted(brute(rows, touched))
    assert sum(not r[-1] for r in got) == sum(touched(i) for i in range(2049))


def test_manifest_of_no_row_and_of_one(spark):
    assert run(spark, [])[1] == []
    (only,) = run(spark, [(None, None, None, None, None)])[1]
    assert only == (None, sha("-----"), sha("-----"), sha("-----"), sha(""), sha("-----"), True)


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "s", "en", 1, "x")] * 5
    assert sorted(run(spark, rows)[1]) == sorted(brute(rows, touched))


def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 12):
        places = np.concatenate([manifest.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range((1 << levels) - 1))
    # Four levels: the upper two stand together, then each of the four lower trees.
    assert [manifest.address(4, d, np.arange(1 << d)).tolist() for d in range(4)] == [
        [0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]
    ]


def test_a_changed_sibling_does_not_fold_to_the_root():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    tree = manifest.Subtree(manifest.lay_out(leaves, 3), 5, 3)
    stands, beside = tree.ways()
    for leaf, s, b in zip(leaves, stands, beside, strict=True):
        assert manifest.fold(leaf, s, b) == tree.root()
        assert not b or manifest.fold(leaf, s, bytes([b[0] ^ 1]) + b[1:]) != tree.root()
