"""Operator 12 against a plain ranking."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tests.llm import data
from usagelens.llm import lexical

ITEMS = "item_id long, text string, doc_id string, n string, score string, rank string, terms string"


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, top=50):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in rows) if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms_of(text)) if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def search(spark, rows, items, top=50):
    queries = spark.createDataFrame([(i, t, "d", "n", "s", "r", "t") for i, t in items], ITEMS)
    return [tuple(r) for r in lexical.search(data.docs(spark, rows), queries, top).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus(seed, count):
    """Few words, so that bags and lengths often agree; some texts many times."""
    r = random.Random(seed)
    texts = [" ".join(r.choices(["a", "B", "c1", "ü", "dd", "x-y", "?", "zz"], [9, 5, 4, 3, 2, 2, 1, 1], k=r.randrange(1, 9))) for _ in range(count)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[0]) for k in range(count // 3)]
    return rows + [(None, texts[1]), (None, None), (5000, ""), (5001, "?!"), (7, texts[2]), (7, texts[2])]


QUERIES = [(1, "A b"), (2, "dd zz zz ü"), (3, "nothing here"), (4, ""), (5, None), (1, "c1"), (2, "dd zz zz ü"), (None, "x y"), (9, "?")]


@pytest.mark.parametrize("top", [3, 50])
def test_search_is_the_plain_ranking(spark, top):
    rows = corpus(top, 150)
    got = search(spark, rows, QUERIES, top)
    assert sorted(got, key=key) == sorted(brute(rows, QUERIES, top), key=key)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 4)
    rows = corpus(5, 120)
    assert sorted(search(spark, rows, QUERIES, 5), key=key) == sorted(brute(rows, QUERIES, 5), key=key)


def test_search_over_the_edge_texts(spark):
    items = [(1, "日本語 a"), (2, data.words(3, 12)), (3, data.words(1, 40, 1 << 20)), (4, "x y end")]
    assert sorted(search(spark, data.texts(), items), key=key) == sorted(brute(data.texts(), items), key=key)


def test_search_of_empty_tables(spark):
    assert search(spark, corpus(1, 5), []) == []
    assert search(spark, [(1, None), (2, "?")], [(1, "a")]) == []
    queries = spark.createDataFrame([(1, "a", "", "", "", "", "")], ITEMS)
    assert lexical.search(data.empty(spark), queries).collect() == []


def test_long_queries_add_integers_where_doubles_end(spark):
    """The scorer adds the same either way."""
    import numpy as np

    r = random.Random(2)
    numbers = [sorted(r.sample(range(40), 15)) for _ in range(6)]
    weights = np.array([r.randrange(10**4) for _ in range(40)], np.int64)
    found = [np.array(sorted((t, r.randrange(1, 9)) for t in r.sample(range(40), 5)), "<u4").tobytes() for _ in range(20)]
    m = np.arange(50, 70)
    fast, slow = lexical.Scorer(numbers, weights), lexical.Scorer(numbers, weights)
    slow.exact = False
    assert fast.exact and (fast(found, m) == slow(found, m)).all()


def test_classes_hold_equal_bags_only(spark):
    """Bags of one hash stay apart: classes are grouped by the bag itself."""
    plan = lexical.bags(data.docs(spark, corpus(1, 30)), {b"a": 0, b"b": 1})
    rows = [(bytes(r.bag), r.n) for r in plan.collect()]
    expected = [(Counter(t for t in terms_of(x) if t in "ab"), len(terms_of(x))) for _, x in corpus(1, 30)]
    unpacked = [({"ab"[t]: c for t, c in np_pairs(b)}, n) for b, n in rows]
    assert sorted(map(str, unpacked)) == sorted(str((dict(sorted(c.items())), n)) for c, n in expected)


def np_pairs(bag):
    import numpy as np

    return np.frombuffer(bag, "<u4").reshape(-1, 2).tolist()
