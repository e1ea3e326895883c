"""Operator 13 against plain sharing and the same pivots in Python."""

from __future__ import annotations

import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash

from tests.llm import data
from usagelens.llm import mixing

DOCS = "doc_id long, text string, source string, size string, key string, target string, pos string, n string, _source string, p string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Sharing as it is told: stop what is above, share what is over among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        all_ = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / all_
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        free = {s for s in free if target[s] < most * sizes[s]}
        target = {s: min(t, most * sizes[s]) for s, t in target.items()}
    return target


def hash_of(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def named(source):
    return "" if source is None else "=" + source


def key_of(doc_id, text, source, seed="mix"):
    whole = "\n".join([seed, "-" if doc_id is None else str(doc_id), named(source), text or ""])
    return struct.unpack("<q", struct.pack("<Q", hash_of(whole.encode())))[0]


def pivots(docs):
    """(docs with 0 or 1, one left) of a group; docs are [key, id, size, p]."""
    carry, done = docs[0], []
    for new in docs[1:]:
        (x, a), (y, b) = (carry[3], float(carry[2])), (new[3], float(new[2]))
        up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
        draw = (hash_of(struct.pack("<q", carry[0]), struct.pack("<q", new[0])) >> 11) / 2.0**53
        moved = up if draw * (up + down) < down else -down
        first = (1 - x) * a <= y * b if draw * (up + down) < down else x * a <= (1 - y) * b
        full = first == (draw * (up + down) < down)
        done.append(((carry if first else new)[1:3], int(full)))
        carry = [*new[:3], min(1.0, max(0.0, y - moved / b))] if first else [*carry[:3], min(1.0, max(0.0, x + moved / a))]
    return done, carry


def brute(rows):
    sizes, own = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        sizes[source] += size_of(text)
        own[source].append([key_of(i, text, source), i, size_of(text)])
    out = []
    for source, target in targets_of(sizes).items():
        times = target / sizes[source] if sizes[source] else 0.0
        whole, p = int(times), times - int(times)
        settled = [((i, n), 0) for _, i, n in own[source] if not n or not p]
        left = sorted([[k, i, n, p] for k, i, n in own[source] if n and p], key=lambda d: (-d[2], d[0]))
        while len(left) > 1:
            groups = [pivots(left[k : k + mixing.GROUP]) for k in range(0, len(left), mixing.GROUP)]
            settled += [s for done, _ in groups for s in done]
            left = [g[1] for g in groups]
        settled += [((i, n), int(q >= 0.5)) for _, i, n, q in left]
        out += [(i, n, sizes[source], target, (whole + up) * n) for (i, n), up in settled]
    return out


def mixed(spark, rows, parts=3, **more):
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in rows], DOCS).repartition(parts)
    return [tuple(r) for r in mixing.mix(docs, **more).drop("copies").collect()]


def key(row):
    return tuple((x is None, round(x, 6) if x is not None else 0) for x in row)


def corpus(seed, count):
    """A source with a third of all rows, copies, small and null sources."""
    r = random.Random(seed)
    text = lambda: data.words(r.randrange(99), r.choice([0, 1, 5, 30, 30, 80, 400]))
    rows = [(k, text(), r.choice(["hot"] * 4 + ["a", "b", "Z", "é", "", None])) for k in range(count)]
    return rows + [(None, "one two", "a"), (None, None, None), (count, "same text here", "b"), (count, "same text here", "b"), (-1, "x", "tiny")]


@pytest.mark.parametrize("group", [3, 64])
def test_mix_is_the_plain_one(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = corpus(group, 260)
    got, expected = sorted(mixed(spark, rows), key=key), sorted(brute(rows), key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])


def test_taken_words_come_near_the_targets(spark):
    """Half the largest document of a source at most is missed; no document is taken more than twice."""
    rows = corpus(7, 600)
    source = {}
    for i, text, s in rows:
        source.setdefault((i, size_of(text)), s)
    taken, wanted, largest = defaultdict(int), {}, defaultdict(int)
    for i, size, _, target, words in mixed(spark, rows):
        s = source[i, size]
        taken[s], wanted[s], largest[s] = taken[s] + words, target, max(largest[s], size)
        assert words <= 2 * size
    for s, words in taken.items():
        assert abs(words - wanted[s]) <= largest[s] / 2 + 1e-6
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(size_of(t) for _, t, _ in rows))


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = corpus(3, 150)
    assert sorted(mixed(spark, rows, 1), key=key) == sorted(mixed(spark, rows[::-1], 7), key=key)


def test_chances_follow_the_fraction(spark):
    """Over many sources of equal texts each place is taken as often as the fraction says."""
    rows = [(100 * s + k, data.words(k, 3 + 7 * k), f"s{s}") for s in range(150) for k in range(9)]
    counts = defaultdict(int)
    for i, size, _, target, words in mixed(spark, rows, weights=(1,)):
        counts[i % 100] += words // size
        assert target == pytest.approx(1.5 * sum(3 + 7 * k for k in range(9)))
    assert len(counts) == 9 and all(abs(c / 150 - 1.5) < 0.16 for c in counts.values())


def test_mix_of_no_words_and_no_rows(spark):
    assert mixed(spark, []) == []
    assert sorted(mixed(spark, [(1, "", "a"), (2, None, None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_one_source_is_taken_one_and_a_half_times(spark):
    rows = [(k, "a b c d", "s") for k in range(101)]
    got = mixed(spark, rows)
    assert sum(r[4] for r in got) in (604, 608) and {r[3] for r in got} == {606.0}


def test_a_large_share_stops_every_source(spark):
    got = mixed(spark, [(1, "a b", "s"), (2, "c", "t")], share=9.0)
    assert sorted((r[0], r[3], r[4]) for r in got) == [(1, 4.0, 4), (2, 2.0, 2)]


def test_no_python_runs_on_the_main_path(spark):
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in corpus(1, 90)], DOCS)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
