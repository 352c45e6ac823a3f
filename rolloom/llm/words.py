"""Words between ASCII white space, as exact numbers, for a batch of texts.

A word is a maximal run of bytes other than the space and the five controls
from tab to carriage return; in UTF-8 that is the same as a run of characters.
Words are numbered by their bytes, not by a hash: equal numbers mean equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from rolloom.llm.common import chunks

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


class Words(NamedTuple):
    """The words of the rows ``first`` to ``first + len(bounds) - 2`` of a batch."""

    first: int
    data: np.ndarray  # bytes of the rows, one after the other
    offsets: np.ndarray  # first byte of every row, and the end
    words: pa.Array  # the words of all rows
    bounds: np.ndarray  # first word of every row, and their number


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of ``inside``; a run ends at each of ``bounds``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = inside[start]
    return start[keep], end[keep]


def pieces(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as an Arrow array."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def numbers(values: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal values."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def words(texts: pa.Array) -> Iterator[Words]:
    """Cuts a batch of texts into chunks of whole rows and their words."""
    for first, _, data, offsets in chunks(texts):
        inside = ~SPACE[data]
        start, end = runs(inside, offsets)
        found = pieces(data[inside], np.r_[0, np.cumsum(end - start)])
        yield Words(first, data, offsets, found, np.searchsorted(start, offsets, "left"))
