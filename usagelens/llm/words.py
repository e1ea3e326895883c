"""Word bounds of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from usagelens.llm.common import TOGETHER, raw_texts

#: Bytes that are looked at together.
SLICE = (1 << 20) - 8192

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes; a longer text has one of its own."""
    at = 0
    while at < len(raws):
        stop, size = at, 0
        while stop < len(raws) and (stop == at or size + len(raws[stop]) < SLICE):
            size += len(raws[stop]) + 1
            stop += 1
        yield at, stop
        at = stop


def bounds(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where words start, where they stop, words of each text).

    Words are what stands between spaces and the control characters 9 to 13.
    """
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1))
    starts, stops = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return data, starts, stops, np.diff(np.searchsorted(starts, ends), prepend=0)


def row_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch and their texts; null is empty."""
    for start in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(start, TOGETHER)
        raws = raw_texts(part, column)
        for at, stop in slices(raws):
            yield part.slice(at, stop - at), raws[at:stop]
