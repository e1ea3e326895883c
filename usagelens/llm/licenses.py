"""Operator 3: licence scans with a generalised suffix automaton.

The automaton holds every run of words of all licence templates. A text's words
stream through it and give matching statistics: at each word, how many words that
end there stand in some template. Matches that cannot grow and have at least
``LEAST`` words are anchors; for each template, anchors that keep their order are
chained, and the part of the template that the chain covers says how sure the
label is. A chain's words are the span of the licence; all spans come out. Long stretches without two neighbouring template words are passed over
with numpy, as no match can be there.

Base phrases are counted at every place where their words stand one after the
other. Null text: empty, no words, no labels. Equal rows give equal results, one
row each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from usagelens.llm.common import per_batch, raw_texts

#: Phrases and the labels they give, fixed by contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence wording and its labels; a label may have several templates.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Shortest match that may join a chain, in words.
LEAST = 3
#: Part of a template that must be covered for its label.
COVERED = 0.8

_LETTERS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words: digits, ASCII letters and everything beyond ASCII."""
    return raw.translate(_LETTERS).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``ends[state]`` lists (template, end) of the state's words.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((number, place))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if self.link[state] > 0:
                ends[self.link[state]].extend(ends[state])
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, length: int, moves: dict[int, int], link: int, ends: list) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, ends: list) -> int:
        """The state of p's longest words followed by word, split off if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        state = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, ends)
        return state

    def matches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) of each match that cannot be made longer."""
        out, state, length = [], 0, 0
        for at, word in enumerate(words):
            before, long = state, length
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state, length = 0, 0
            if long and length <= long:
                out.append((at - 1, long, before))
        if length:
            out.append((len(words) - 1, length, state))
        return out


class Scanner:
    """The automaton with the numbering of words."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: int, covered: float):
        self.least, self.covered = least, covered
        self.labels = [label for label, _ in templates]
        sequences = [text.split() for _, text in templates]
        phrases = {label: phrase.split() for phrase, label in BASE.items()}
        known = sorted({w for s in [*sequences, *phrases.values()] for w in s})
        self.ids = {w.encode(): i + 1 for i, w in enumerate(known)}
        numbers = [[self.ids[w.encode()] for w in s] for s in sequences]
        self.phrases = {label: [self.ids[w.encode()] for w in p] for label, p in phrases.items()}
        self.sizes = list(map(len, sequences))
        self.automaton = Automaton(numbers)
        pairs = np.zeros((len(known) + 1,) * 2, bool)
        for s in numbers:
            pairs[s[:-1], s[1:]] = True
        self.pairs = pairs

    def chains(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Template -> (first word, end, covered words) of the chains of its anchors."""
        near = self.pairs[ids[:-1], ids[1:]]
        if not near.any():
            return {}
        edges = np.diff(np.concatenate([[0], near.view(np.int8), [0]]))
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True):
            if stop - start + 1 < self.least:
                continue
            for end, length, state in self.automaton.matches(ids[start : stop + 1].tolist()):
                if length < self.least:
                    continue
                for number, place in self.automaton.ends[state]:
                    anchors.setdefault(number, []).append((int(start) + end + 1 - length, place + 1 - length, length))
        return {number: list(self._chain(sorted(set(found)), self.sizes[number])) for number, found in anchors.items()}

    def _chain(self, anchors: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
        """Chains of anchors in order, within twice the template's length of text.

        An anchor ends several chains: one that began later may outlive one that
        covers more, so each keeps all that no other one beats in both. They cover
        different numbers of words, so there are at most ``size`` of them. Anchors
        too far back leave, so the work follows the template's size.
        """
        reachable: list[tuple[int, int, list[tuple[int, int]]]] = []
        for at, place, length in anchors:
            stop, reach = at + length, 2 * size
            reachable = [r for r in reachable if stop - r[2][0][0] <= reach]
            latest = {length: at}
            for text_end, end, ways in reachable:
                if text_end <= at and end <= place:
                    for began, covered in ways:
                        if stop - began <= reach:
                            latest[covered + length] = max(began, latest.get(covered + length, -1))
            # From the latest start on, each with more words than those before it.
            ways = []
            for covered, began in sorted(latest.items(), key=lambda w: (-w[1], -w[0])):
                if not ways or covered > ways[-1][1]:
                    ways.append((began, covered))
            reachable.append((stop, place + length, ways))
            yield from ((began, stop, covered) for began, covered in ways)

    def spans(self, chains: dict[int, list[tuple[int, int, int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered part) of sure places; those of one template do not overlap, the fullest and shortest first choice."""
        out = []
        for number, found in chains.items():
            size, taken = self.sizes[number], []
            sure = [c for c in found if c[2] >= self.covered * size]
            for start, stop, covered in sorted(set(sure), key=lambda c: (-c[2], c[1] - c[0], c[0])):
                near = bisect.bisect_left(taken, (start, stop))
                if (near == 0 or taken[near - 1][1] <= start) and (near == len(taken) or stop <= taken[near][0]):
                    taken.insert(near, (start, stop))
                    out.append((self.labels[number], start, stop, covered / size))
        return sorted(set(out), key=lambda s: (s[1], s[2], s[0], s[3]))

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
        words = words_of(raw)
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        places, base = [], []
        for label, phrase in self.phrases.items():
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = np.logical_and.reduce([ids[k : k + n] == w for k, w in enumerate(phrase)])
                if hit.any():
                    places.append(np.flatnonzero(hit))
                    base.append(label)
        chains = self.chains(ids)
        spans = self.spans(chains)
        starts = np.concatenate(places) if places else None
        labels = {*base, *(label for label, *_ in spans)}
        return (
            len(words),
            0 if starts is None else len(starts),
            None if starts is None else int(starts.min()),
            None if starts is None else int(starts.max()),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            max((c[2] / self.sizes[number] for number, found in chains.items() for c in found), default=0.0),
            [dict(zip(SPAN, span, strict=True)) for span in spans],
        )


@functools.lru_cache(maxsize=2)
def scanner(templates: tuple, least: int, covered: float) -> Scanner:
    """One per worker and set of templates."""
    return Scanner(templates, least, covered)


SPAN = ("label", "first_word", "end_word", "covered")
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct(list(zip(SPAN, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))))),
])


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """Licence labels of each whole text, with the places of base phrases and of licences.

    ``score`` is the largest covered part of any template; ``spans`` holds the words
    that each licence found stands on, its end excluded.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner(templates, least, covered)
        rows = [s.scan(raw) for raw in raw_texts(batch)]
        columns = [batch.column("doc_id"), *(list(c) for c in zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", spans array<struct<label: string, first_word: long, end_word: long, covered: double>>"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(per_batch(run), schema)
