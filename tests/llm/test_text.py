"""Operators 2, 3, 9 and 10."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm import data
from usagelens.llm import chat, decontaminate, licenses, quality

# --- 3: licences ------------------------------------------------------------


def brute_licences(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases(spark):
    r = random.Random(1)
    atoms = ["cc", "by", "CC-BY", "General", "public", "license", "all", "rights", "reserved.", "é", "x_y", "GENERAL PUBLIC", "\n", "4.0"]
    rows = [(k, " ".join(r.choices(atoms, k=r.randint(0, 40)))) for k in range(150)]
    rows += [r for r in data.texts() if r[0] is None or r[0] < 0]
    got = licenses.scan_licenses(data.docs(spark, rows)).collect()
    expected = sorted(((i, *brute_licences(t)) for i, t in rows), key=str)
    assert sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got), key=str) == expected
    assert all(set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in got)
    assert licenses.scan_licenses(data.empty(spark)).collect() == []
    assert len(licenses.scan_licenses(data.docs(spark)).collect()) == len(data.texts())


def test_automaton_holds_every_run_of_words():
    r = random.Random(2)
    sequences = [[r.randrange(4) for _ in range(r.randint(1, 25))] for _ in range(12)]
    a = licenses.Automaton(sequences)
    runs = {}
    for n, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                runs.setdefault(tuple(s[i:j]), set()).add((n, j - 1))
    for run, places in runs.items():
        state = 0
        for word in run:
            state = a.next[state][word]
        assert set(a.ends[state]) == places
    text = [r.randrange(5) for _ in range(300)]
    longest = [max((n for n in range(1, 26) if tuple(text[i - n + 1 : i + 1]) in runs and n <= i + 1), default=0) for i in range(len(text))]
    found = {end: length for end, length, _ in a.matches(text)}
    for i, n in enumerate(longest):
        if n and (i + 1 == len(text) or longest[i + 1] <= n):
            assert found[i] == n


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("we use this software under sun and license plates", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files "
         "(the Software), to deal in the Software without restriction", "mit"),
    ],
)
def test_labels_of_the_method(text, labels):
    assert licenses.scanner(licenses.TEMPLATES, licenses.LEAST, licenses.COVERED).scan(text.encode())[5] == labels


def _scanned(text, templates=licenses.TEMPLATES, covered=licenses.COVERED):
    return licenses.scanner(templates, licenses.LEAST, covered).scan(text.encode())


@pytest.mark.parametrize("distance", range(0, 61, 3))
def test_a_stray_start_does_not_take_over_a_licence(distance):
    """The licence keeps its label and its place, whatever fragment of it stands before."""
    mit = licenses.TEMPLATES[2][1].split()
    broken = [w for k, word in enumerate(mit) for w in ([word, "zq"] if k % 5 == 4 else [word])]
    alone = _scanned(" ".join(broken))
    words = [*mit[:4], *["filler"] * distance, *broken]
    found = _scanned(" ".join(words))
    assert alone[5] == found[5] == "mit"
    assert found[6] >= alone[6] >= licenses.COVERED
    (span,) = found[7]
    assert (span["label"], span["end_word"]) == ("mit", len(words))
    assert span["first_word"] <= 4 + distance and span["covered"] == found[6]


def test_every_place_of_a_licence_is_a_span():
    text = "x released under the mit license y y Released under the MIT License, z licensed under cc by 4.0"
    spans = [(s["label"], s["first_word"], s["end_word"], s["covered"]) for s in _scanned(text)[7]]
    # Words from 0; the part of a template that stands there.
    assert [s for s in spans if s[0] == "mit"] == [("mit", 1, 6, 1.0), ("mit", 8, 13, 1.0)]
    assert ("cc-by", 14, 20, 1.0) in spans
    assert _scanned("nothing of that kind")[7] == [] and _scanned("")[7] == []


def brute_cover(words, template, least):
    """Most template words in order, over all ways to put anchors together; anchors cannot be made longer forwards."""
    anchors = set()
    for end in range(1, len(words) + 1):
        fits = [n for n in range(1, end + 1) if any(template[p : p + n] == words[end - n : end] for p in range(len(template) - n + 1))]
        if fits:
            anchors.add((end - max(fits), max(fits)))
    grown = {(a, n) for a, n in anchors if (a, n + 1) not in anchors and n >= least}
    places = sorted((a, p, n) for a, n in grown for p in range(len(template) - n + 1) if template[p : p + n] == words[a : a + n])
    best = 0

    def extend(start, text_end, end, covered):
        nonlocal best
        best = max(best, covered)
        for a, p, n in places:
            if a >= text_end and p >= end and a + n - start <= 2 * len(template):
                extend(start, a + n, p + n, covered + n)

    for a, p, n in places:
        if n <= 2 * len(template):
            extend(a, a + n, p + n, n)
    return best / len(template)


def test_chains_equal_brute_force():
    r = random.Random(11)
    template = [f"w{k}" for k in (0, 1, 2, 3, 4, 1, 2, 5, 6, 7, 8, 9)]
    found = set()
    for _ in range(250):
        words = []
        while len(words) < 40:
            cut = r.randrange(len(template))
            words += template[cut : cut + r.randrange(1, 8)] + ["zz"] * r.randrange(0, 6)
        got = _scanned(" ".join(words), (("own", " ".join(template)),))[6]
        assert got == pytest.approx(brute_cover(words, template, licenses.LEAST))
        found.add(got)
    assert len(found) > 3


# --- 2: quality -------------------------------------------------------------


def test_quality_learns_rules(spark):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        good = r.random() < 0.7
        text = data.words(k, r.randint(5, 60))
        rows.append((k, text if good else re.sub(" ", r.choice([" ### ", "!! ", " | "]), text)))
        if k % 2 == 0 or zlib.crc32(str(k).encode()) % 5 == 0:
            labels.append((k, int(good), 0))
    docs = data.docs(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, table)
    assert 0 < len(model.rules) < 400
    found = {x.doc_id: x for x in quality.score(docs, model).collect()}
    truth = dict((k, q) for k, q, _ in labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and found[k].predicted == int(found[k].score >= 0.3) for k in found)
    assert sum(found[k].predicted == truth[k] for k in held) / len(held) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, x in found.items() if x.predicted}


def test_compiled_rules_score_like_numpy(spark):
    r = np.random.default_rng(0)
    x = r.random((500, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    z = model.intercept + sum(w * rule.holds(x) for w, rule in model.rules)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], list(quality.STATISTICS))
    assert np.allclose([v[0] for v in df.select(model.score()).collect()], 1 / (1 + np.exp(-z)))
    assert ((z > 0) == (y > 0)).mean() > 0.97


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(data.docs(spark), none)
    found = quality.score(data.docs(spark), model).collect()
    assert len(found) == len(data.texts()) and {round(x.score, 6) for x in found} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    assert all(x.score > 0.9 for x in quality.score(data.docs(spark), quality.train(data.docs(spark), one)).collect())
    assert quality.score(data.empty(spark), model).collect() == []
    assert quality.train(data.empty(spark), one).rules == ()


# --- 9: decontamination -----------------------------------------------------

ITEMS = [
    (1, "A train leaves the station at 40 km per hour and reaches Springfield after 3 hours so how far did the train travel in total"),
    (2, "seven short words stand in this item"),
    (3, "too short"),
    (None, "items without any id are found all the same when somebody copies them into a text"),
    (4, None),
]


def leaks(spark, rows, items=ITEMS):
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, slots string, _id int")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(data.docs(spark, rows), benchmark).collect()}


def test_leaks(spark):
    copy = ITEMS[0][1]
    other = copy.replace("40", "65").replace("3 hours", "9 hours").replace("Springfield", "Riverton")
    mixed = "The runner needs 12 km and 12 minutes; " + copy.replace("40 km", "7 miles").replace("3", "5")
    clean = "A train leaves the station " + data.words(1, 30) + " how far did the train travel"
    rows = [(1, data.words(2, 30) + " " + copy + " " + data.words(3, 30)), (2, other), (3, mixed), (4, clean), (5, "x " + ITEMS[1][1] + " y"),
            (6, "too short"), (7, None), (8, ITEMS[3][1].upper()), (None, copy)]
    found = leaks(spark, rows)
    assert set(found) == {(1, 1), (2, 1), (3, 1), (5, 2), (8, None), (None, 1)}
    assert not found[1, 1].reparameterised and found[2, 1].reparameterised and found[1, 1].exact_words >= 20


def test_slots_must_agree(spark):
    item = [(1, "add 5 apples to 5 pears and then give away 5 of them to a friend who likes fruit")]
    same = "add 8 apples to 8 pears and then give away 8 of them to a friend who likes fruit"
    mixed = "add 8 apples to 9 pears and then give away 4 of them to a"
    assert set(leaks(spark, [(1, same), (2, mixed)], item)) == {(1, 1)}


def test_names_do_not_depend_on_the_words_before(spark):
    items = [
        (1, "What is the capital of France?"),
        (2, "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now?"),
        (3, "Photosynthesis turns light into what kind of stored energy?"),
    ]
    rows = [
        (1, "Quiz\nWhat is the capital of France?"), (2, "Quiz\nWhat is the capital of Spain?"),
        (3, "Ann has 3 apples. Ann buys 5 more. How many apples does Ann have now?"), (4, "Ann has 3 apples. Bob buys 5 more. How many apples does Eve have now?"),
        (5, "Quiz, Photosynthesis turns light into what kind of stored energy?"), (6, "Paris is the capital of France."),
        (7, "quiz: what is the capital of france"),
    ]
    assert set(leaks(spark, rows, items)) == {(1, 1), (2, 1), (3, 2), (5, 3), (7, 1)}


def test_items_of_many_placeholders_are_found_word_for_word(spark):
    item = [(1, "Which number comes next 2 4 8 16 32 64 128")]
    found = leaks(spark, [(1, "Puzzle: " + item[0][1] + " ?"), (2, "Which number comes next 3 6 9 12 15 18 21")], item)
    assert set(found) == {(1, 1)} and found[1, 1].exact_words == 11


def test_leak_edges(spark):
    assert leaks(spark, data.texts()) == {}
    assert leaks(spark, []) == {} and leaks(spark, [(1, ITEMS[0][1])], []) == {}
    benchmark = spark.createDataFrame([(1, data.texts()[1][1])], "item_id long, text string")
    source = data.docs(spark)
    kept = decontaminate.drop_leaks(source, benchmark)
    assert kept.columns == source.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 3} & set(ids) and ids.count(8) == 2 and ids.count(None) == 2


def brute_readings(text):
    """By reading: the canonical words of a text and the values of its placeholders, None for other words."""
    raw = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    cores = [re.sub(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$", b"", w) or w for w in raw]
    low = [c.lower() for c in cores]
    number = [bool(re.fullmatch(rb"[0-9][0-9.,:/]*", c)) or w in decontaminate.NUMBER_WORDS for c, w in zip(cores, low, strict=True)]
    out = [[(w, None) for w in low], [], []]
    for k, (core, word) in enumerate(zip(cores, low, strict=True)):
        unit = k > 0 and number[k - 1] and not number[k] and word in decontaminate.UNITS
        capital = bool(re.fullmatch(rb"[A-Z][a-z]+", core)) and not number[k] and not unit
        opens = k == 0 or bool(re.search(rb"[.!?:]$|[.!?:][\"')\]]$", raw[k - 1]))
        for reading, name in ((1, capital and not opens), (2, capital and word not in decontaminate.OPENERS)):
            kind = b"<number>" if number[k] else b"<unit>" if unit else b"<name>" if name else None
            out[reading].append((kind, word) if kind else (word, None))
    return out


def brute_leaks(rows, items):
    """Every document with every item, window by window."""
    out = {}
    for doc_id, text in rows:
        theirs = brute_readings(text)
        for item_id, wording in items:
            mine = brute_readings(wording)
            n = len(mine[0])
            size = min(n, decontaminate.WINDOW)
            lines = {}
            for reading, (a, b) in enumerate(zip(theirs, mine, strict=True)):
                for at in range(n - size + 1):
                    b_window = b[at : at + size]
                    slots = sum(v is not None for _, v in b_window)
                    if reading and not 0 < slots <= size * (1 - decontaminate.LITERAL):
                        continue
                    for place in range(len(a) - size + 1):
                        a_window = a[place : place + size]
                        if [w for w, _ in a_window] == [w for w, _ in b_window] and sum(v is not None for _, v in a_window) == slots:
                            values = [(x, y) for (_, x), (_, y) in zip(a_window, b_window, strict=True) if x is not None]
                            lines.setdefault((reading, place - at), []).append((at, values))
            covered, exact = set(), set()
            for met in lines.values():
                pairs = {p for _, values in met for p in values}
                agree = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
                for at, values in met:
                    same = all(x == y for x, y in values)
                    covered |= set(range(at, at + size)) if same or agree else set()
                    exact |= set(range(at, at + size)) if same else set()
            if n >= decontaminate.SHORTEST and len(covered) >= min(decontaminate.COVER, n):
                held = out.get((doc_id, item_id), (0, 0))
                out[doc_id, item_id] = (max(held[0], len(exact)), max(held[1], len(covered)))
    return out


def _question(r):
    name, other = r.sample(["Tom", "Ann", "Bob", "Eve"], 2)
    a, b = r.sample(["2", "3", "four", "10", "7.5"], 2)
    unit = r.choice(["km", "hours", "dollars", "apples"])
    return r.choice([
        f"{name} walks {a} {unit} and then {other} walks {b} {unit} more. How far did {name} walk?",
        f"What is the name of the town where {name} lived for {a} {unit}?",
        f"What is the name of the river that {name} saw?",
        f"Is {a} larger than {b}?", f"{name} has {a} {unit} left", "Which of these words is a verb?", f"Name {a} {b} {a} {b} {a} {b} of them",
    ])


def test_leaks_equal_brute_force(spark):
    """Many items share wordings, many documents hold several of them, close together and far apart, some twice."""
    r = random.Random(9)
    items = [(k, _question(r)) for k in range(40)] + [(40, None), (41, "too short"), (3, "Bob has seven hours left today")]
    rows = []
    for k in range(160):
        parts = []
        for _ in range(r.randrange(1, 5)):
            question = r.choice(items[:40])[1] if r.random() < 0.4 else _question(r)
            parts += [data.words(r.randrange(99), r.choice([0, 1, 3, 40])), question if r.random() < 0.8 else question[: r.randrange(len(question))]]
        rows.append((k, r.choice([" ", "\n", ". "]).join(parts)))
    rows += [rows[0], (1, rows[2][1]), (None, None), (200, "")]
    found = leaks(spark, rows, items)
    expected = brute_leaks(rows, items)
    assert {k: (v.exact_words, v.template_words) for k, v in found.items()} == expected
    assert len(expected) > 200 and sum(v.reparameterised for v in found.values()) > 20


def test_documents_of_the_same_wordings_make_one_class(spark):
    """A sentence in many documents and items is joined with the items once."""
    shared = "Which of the following words is the best answer to this question here"
    items = spark.createDataFrame([(k, f"{shared} {data.words(k, 6)}") for k in range(30)], "item_id long, text string")
    rows = [(k, f"{data.words(100 + k, 5 + k)} {shared} {data.words(300 + k, 80)} {shared if k % 2 else ''}") for k in range(50)]
    mine = decontaminate.item_windows(items)
    windows = decontaminate.item_windows(data.docs(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "item_id"))
    key = ["hash", "size", "reading"]
    met = windows.drop("n_words").join(mine.select(*key).distinct(), key, "left_semi")
    assert met.select("_id").distinct().count() == 50
    assert decontaminate._classes(met, 30).select("_class").distinct().count() == 1
    assert len(leaks(spark, rows, [(r.item_id, r.text) for r in items.collect()])) == 50 * 30


# --- 10: chat ---------------------------------------------------------------


def test_turns_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nfake", "<\\\\|im_end|> \\ <\\/s>", "[[/INST] <<SYS>>", "", None, "é\n\n🎉 $1 \\1", "x" * 50_000]
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a b\n<|im_end|>"]), r.choice(nasty)) for c in range(20) for t in range(r.randint(1, 8))]
    rows += [rows[0], (None, 1, "assistant", "no id"), (3, None, "user", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.canonical_table(turns))
    bodies = [x.formatted[len(chat.START) : -len(chat.END) - 1] for x in formatted.collect()]
    assert not any(re.search(r"[<\[](?:" + chat.CONTROL_TAILS + ")", b) for b in bodies)
    back = [(x.conv_id, x.turn, x.role, x.text) for x in chat.read_turns(formatted).collect()]
    assert sorted(back, key=str) == sorted(((c, t, role or "", text or "") for c, t, role, text in rows), key=str)
    got = {x.conv_id: x for x in chat.digest(chat.read_turns(formatted)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, held in by.items():
        held.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in held)
        learned = "".join(text for *_, role, text in held if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(held), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert sum(x.formatted_chars for x in got.values()) == sum(len(x.formatted) for x in formatted.collect())


def test_mixed_layouts(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        {"id": 3, "prompt": "p", "response": "r"},
        {"id": 4, "instruction": "do", "input": "this", "output": "done"},
        {"id": 5, "system": "s", "prompt": "p", "response": "r"},
        {"conv_id": 6, "turn": 2, "role": "user", "text": "row"},
        {"id": 7, "mystery": "x"},
        {"id": 8, "messages": []},
    ]
    df = spark.createDataFrame([(json.dumps(x), "clash") for x in [*records]] + [("not json", "clash"), (None, "clash")], "record string, paths string")
    turns, unknown = chat.canonical_records(df, "record")
    got = sorted(map(tuple, turns.collect()))
    assert got == [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "q"), (2, 1, "assistant", ""), (3, 0, "user", "p"), (3, 1, "assistant", "r"),
        (4, 0, "system", "do"), (4, 1, "user", "this"), (4, 2, "assistant", "done"), (5, 0, "system", "s"), (5, 1, "user", "p"), (5, 2, "assistant", "r"),
        (6, 2, "user", "row"),
    ]
    assert len(unknown.collect()) == 4


def test_records_that_only_look_like_a_layout_stay_apart(spark):
    """Names inside other objects, ids and texts of other kinds, names with dots; nulls are of any kind."""
    strange = [
        {"id": 1, "prompt": {"response": "hidden"}}, {"id": 1, "a": {"b": {"prompt": "p", "response": "r"}}}, {"id": "abc", "prompt": "p", "response": "r"},
        {"id": 1, "prompt": ["p"], "response": "r"}, {"id": 1.5, "prompt": "p", "response": "r"}, {"id": 1, "messages.role": "x", "messages[].content": "y"},
        {"id": 1, "messages": [{"role": "user", "content": "x"}, {"role": "user", "content": 7}]}, {"id": 1 << 70, "prompt": "p", "response": "r"},
        {"id": 1, "messages": [{"role": "user", "content": {}}]}, {"id": True, "prompt": "p", "response": "r"}, [1], 5,
    ]
    texts = [json.dumps(x) for x in strange] + ['{"id": NaN, "prompt": "p", "response": "r"}', "[" * 100_000]
    plain = [{"id": None, "prompt": None, "response": "r"}, {"id": 9, "messages": [{"role": None, "content": None}, {"role": "gpt", "content": "x"}]}]
    df = spark.createDataFrame([(x,) for x in texts + [json.dumps(x) for x in plain]], "record string")
    turns, unknown = chat.canonical_records(df, "record")
    assert sorted(r.record for r in unknown.collect()) == sorted(texts)
    got = sorted(map(tuple, turns.collect()), key=str)
    assert got == [(9, 0, "", ""), (9, 1, "assistant", "x"), (None, 0, "user", ""), (None, 1, "assistant", "r")]
    deep = unknown.where("record like '%\"b\"%'").first()
    assert deep.paths == ["a.b.prompt:text", "a.b.response:text", "id:integer"]


def test_every_layout_has_fingerprints_of_its_own():
    marks = [m for layout in chat.LAYOUTS for m in layout.record_fingerprints]
    assert len(marks) == len(set(marks))


def test_chat_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_turns(chat.format_turns(chat.canonical_table(empty)))).collect() == []
    with pytest.raises(ValueError):
        chat.canonical_table(data.empty(spark))
