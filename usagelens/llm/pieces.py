"""Cutting a text where byte-level BPE can never join tokens.

The byte-level pattern lets a token start with one space but never hold a space
behind other characters than white space. So a text may be cut before any space
that a character other than white space follows; the ids of the parts, one after
the other, are the ids of the whole. Parts repeat a lot and are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Parts that one generation of a worker's memory holds, about, unless given; there are two.
REMEMBERED = 200_000
#: Longer parts are not remembered.
LONGEST = 64


#: Starts the key of a part without a leading space; no valid text holds it.
FIRST = "\ud800"
_BREAK = FIRST + "\n"
_BLANKS = re.compile(r"\s\s")


def keys(text: str) -> list[str]:
    """The text cut at safe places: keys of its parts.

    A key is the part without its leading space, or ``FIRST`` and the part where it
    has none. Without white space side by side, every space and line break is safe.
    """
    if _BLANKS.search(text) is None:
        out: list[str] = []
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(_BREAK)
            first, *rest = line.split(" ")
            if first:
                out.append(FIRST + first)
            out += rest
        return out
    first, *rest = text.split(" ")
    out = [FIRST + first] if first else []
    for piece in rest:
        if out and (not piece or piece[0].isspace()):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def has_blanks(text: str) -> bool:
    """Whether white space stands side by side anywhere."""
    return _BLANKS.search(text) is not None


def plain_parts(raws: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Parts of texts without white space side by side, each its number among the different ones, and the parts of each text.

    A part starts at a space, at a line break and behind it, and where a text starts.
    """
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    line = data == 0x0A
    starts = line | (data == 0x20)
    starts[1:] |= line[:-1]
    starts[ends[ends < len(data)]] = True
    starts[:1] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data)).astype(np.int32)
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return parts.dictionary_encode(), np.diff(np.searchsorted(at, ends), prepend=0)


def key_of(part: bytes) -> str:
    """The key of a part."""
    return part[1:].decode() if part[:1] == b" " else FIRST + part.decode()


def part(key: str) -> str:
    """The part of a key; all parts of a text, joined, give the text again."""
    return key[1:] if key.startswith(FIRST) else " " + key


#: Punctuation that the byte-level pattern always cuts from a word before it.
_ENDINGS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def word_of(key: str) -> str:
    """The word of a key that is one word of Latin letters and an ending; else nothing."""
    word = key.rstrip(_ENDINGS)
    return word if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)) else ""


class Memory:
    """part -> its ids, of a bounded number of parts: those used of late.

    Parts in use are in ``young``. When that is full it becomes ``old``, and a part
    of the old generation comes back with its next use.
    """

    def __init__(self, size: int = REMEMBERED) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, parts: set[str]) -> set[str]:
        """The parts that are not remembered; the others are in ``young`` from here on."""
        self.turn()
        missing, old = parts.difference(self.young), self.old
        back = {p: old[p] for p in missing if p in old}
        self.young.update(back)
        return missing.difference(back)

    def turn(self) -> None:
        """Starts a new generation when the young one is full."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def each(self, parts: list[str], learn: Callable[[set[str]], dict[str, bytes]]) -> list[bytes]:
        """The ids of each of different parts."""
        self.turn()
        found = list(map(self.young.get, parts))
        gap = [i for i, ids in enumerate(found) if ids is None]
        old = self.old
        now = {p: old[p] for i in gap if (p := parts[i]) in old}
        if len(now) < len(gap):
            now |= learn({parts[i] for i in gap}.difference(now))
        for i in gap:
            found[i] = now[parts[i]]
        self.young.update([(p, ids) for p, ids in now.items() if len(p) <= LONGEST])
        return found

    def looked_up(self, cut: list[list[str]], learn: Callable[[set[str]], dict[str, bytes]]) -> list[bytes]:
        """The ids of each list of parts; ``learn`` finds those that are not remembered."""
        self.turn()
        get = self.young.get
        found = [list(map(get, parts)) for parts in cut]
        gaps = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        missing = {parts[i] for parts, gap in zip(cut, gaps, strict=True) for i in gap}
        old = self.old
        back = {p: old[p] for p in missing if p in old}
        new = learn(missing.difference(back)) if len(back) < len(missing) else {}
        now = back | new
        for parts, f, gap in zip(cut, found, gaps, strict=True):
            for i in gap:
                f[i] = now[parts[i]]
        self.young.update([(p, ids) for p, ids in now.items() if len(p) <= LONGEST])
        return [b"".join(f) for f in found]


def special_split(text: str, special: list[str]) -> list[tuple[str, bool]]:
    """(part, whether it is a special token's string), leftmost and longest first."""
    if not any(s in text for s in special):
        return [(text, False)]
    out, at = [], 0
    while at < len(text):
        found = min(((i, -len(s), s) for s in special if (i := text.find(s, at)) >= 0), default=None)
        if found is None:
            break
        start, _, token = found
        if start > at:
            out.append((text[at:start], False))
        out.append((token, True))
        at = start + len(token)
    return out + [(text[at:], False)] * (at < len(text))
