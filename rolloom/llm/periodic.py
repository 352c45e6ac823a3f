"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of words with smallest period q, at least ``POWER * q`` and
``LEAST`` words long, that no neighbouring word extends. Every word of a run
occurs in it at least ``POWER`` times. So a word that occurs less often within a
segment of the text is in no run and splits the segment; the parts are counted
again until they are stable (see ``SHRINK``). Prose falls apart within a few
counts.

In what is left, a run of period q holds at least ``m = length - q`` words that
equal the word q further on, and so a whole block of ``(m + 1) // 2`` words cut
at multiples of that width. For each lag only these blocks are compared, by
prefix hashes modulo a prime, which makes ``n log n`` comparisons in a segment
of n words; blocks that agree are widened to their maximal stretch, and every
stretch is checked word by word before it counts.

Rows are independent: no shuffle, and memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import session
from rolloom.llm.words import SPACE, numbers, runs, words

POWER = 4
LEAST = 6
# A segment is counted again only if a count took one word in so many out of
# it. That bounds the counting of any text; the scan is exact on any segment.
SHRINK = 64
# Block comparisons of one vectorised step.
STEP = 1 << 20

_PRIME = (1 << 31) - 1
_BASES = (48271, 1_220_703_125)


def split_by_frequency(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments that may hold runs.

    ``bounds`` are the first words of the rows; no segment crosses one.
    """
    n = len(ids)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    place = np.arange(n)
    # words in order of number, then place: a segment's words stay together
    order = np.argsort(ids, kind="stable")
    segment = np.zeros(n, np.int64)
    settled = [place[:0]]
    while len(place):
        edge = np.r_[True, (place[1:] != place[:-1] + 1) | first[place[1:]]]
        number = np.cumsum(edge) - 1
        size = np.bincount(number)
        segment[place] = number
        of, word = segment[order], ids[order]
        cut = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])])
        times = np.diff(np.r_[cut, len(order)])
        rare = np.repeat(times < POWER, times)
        lost = np.bincount(of[rare], minlength=len(size))
        out = np.zeros(n, bool)
        out[order[rare]] = True
        again = (lost * SHRINK >= size) & (lost > 0) & (size >= LEAST)
        stays = ~out[place]
        settled.append(place[stays & ((size >= LEAST) & ~again)[number]])
        place = place[stays & again[number]]
        order = order[~rare & again[of]]
    place = np.sort(np.concatenate(settled))
    if not len(place):
        return place, place
    edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | first[place[1:]]])
    start, end = place[edge], place[np.r_[edge[1:], len(place)] - 1] + 1
    long = end - start >= LEAST
    return start[long], end[long]


class Prefixes:
    """Hashes of stretches: whether two stretches of equal length may be equal."""

    def __init__(self, ids: np.ndarray, base: int):
        n = len(ids)
        self.power = np.ones(n + 1, np.int64)
        have, factor = 1, base
        while have <= n:
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * factor % _PRIME
            have, factor = have + more, factor * factor % _PRIME
        self.sums = np.zeros(n + 1, np.int64)
        np.cumsum((ids + 1) * self.power[:n] % _PRIME, out=self.sums[1:])

    def same(self, at: np.ndarray, width: np.ndarray, lag: np.ndarray) -> np.ndarray:
        here = (self.sums[at + width] - self.sums[at]) % _PRIME
        there = (self.sums[at + lag + width] - self.sums[at + lag]) % _PRIME
        return here * self.power[lag] % _PRIME == there


def _furthest(most: np.ndarray, holds) -> np.ndarray:
    """The largest x of 0 to ``most`` with ``holds(x)``, which holds up to some x."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _least_length(q):
    return np.maximum(LEAST, POWER * q)


def _cuts(count: np.ndarray) -> Iterator[slice]:
    """Slices of at most STEP together, or of one value."""
    ends = np.cumsum(count)
    low = 0
    while low < len(count):
        done = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, done + STEP, "right")), low + 1)
        yield slice(low, high)
        low = high


def _ranges(count: np.ndarray) -> np.ndarray:
    """0 to c - 1 for every c, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _smallest(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the smallest q of every stretch, and which rows have a multiple of it."""
    order = np.lexsort((q, e, s))
    a, b = s[order], e[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
    multiple = np.empty(len(order), bool)
    multiple[order] = q[order] % q[order][new][np.cumsum(new) - 1] == 0
    return order[new], multiple


def _exact(ids, s, e, q, low, high) -> np.ndarray:
    """Which stretches have period q and cannot be extended within low to high."""
    good = np.ones(len(s), bool)
    for part in _cuts(e - s):
        count = (e - q - s)[part]
        at = np.repeat(s[part], count) + _ranges(count)
        differ = ids[at] != ids[at + np.repeat(q[part], count)]
        good[part] &= np.bincount(np.repeat(np.arange(len(count)), count)[differ], minlength=len(count)) == 0
    left = np.flatnonzero(s > low)
    good[left] &= ids[s[left] - 1] != ids[s[left] - 1 + q[left]]
    right = np.flatnonzero(e < high)
    good[right] &= ids[e[right]] != ids[e[right] - q[right]]
    return good


def _plain_lag(ids, low: int, high: int, q: int):
    """Maximal stretches of one lag by comparing every word."""
    differ = np.flatnonzero(ids[low : high - q] != ids[low + q : high]) + low
    s, e = np.r_[low, differ + 1], np.r_[differ, high - q] + q
    long = e - s >= _least_length(q)
    return s[long], e[long]


def scan_lags(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs inside the segments."""
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    hashes = [Prefixes(ids, base) for base in _BASES]
    lags = (end - start) // POWER
    owner = np.repeat(np.arange(len(start)), lags)
    lag = _ranges(lags) + 1
    width = (_least_length(lag) - lag + 1) // 2
    count = (end[owner] - start[owner] - lag) // width
    found = []
    for part in _cuts(count):
        c, k = count[part], _ranges(count[part])
        which = np.repeat(np.arange(len(c)), c)
        q, w = lag[part][which], width[part][which]
        at = start[owner[part]][which] + k * w
        hit = np.flatnonzero(hashes[0].same(at, w, q))
        hit = hit[hashes[1].same(at[hit], w[hit], q[hit])]
        if not len(hit):
            continue
        # blocks of one lag that follow each other are one stretch
        new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])]
        head, tail = hit[new], hit[np.r_[np.flatnonzero(new)[1:], len(hit)] - 1]
        q, w, of = q[head], w[head], owner[part][which[head]]
        a, b = at[head], at[tail] + w

        def alike(at, width):
            return hashes[0].same(at, width, q) & hashes[1].same(at, width, q)

        left = _furthest(np.minimum(w - 1, a - start[of]), lambda x: alike(a - x, x))
        right = _furthest(np.minimum(w - 1, end[of] - q - b), lambda x: alike(b, x))
        s, e = a - left, b + right + q
        long = e - s >= _least_length(q)
        found.append((s[long], e[long], q[long], of[long]))
    if not found:
        return none, none, none
    every = tuple(np.concatenate(x) for x in zip(*found))
    keep, multiple = _smallest(*every[:3])
    s, e, q, of = (x[keep] for x in every)
    good = _exact(ids, s, e, q, start[of], end[of])
    # segments where both hashes agreed on different words: a stretch can only
    # have become too long, so reading the lags found there word by word decides
    doubted = np.union1d(of[~good], every[3][~multiple])
    if len(doubted):
        sure = ~np.isin(of, doubted)
        more = [(s[sure], e[sure], q[sure])]
        again = np.isin(every[3], doubted)
        for i, x in sorted({*zip(every[3][again].tolist(), every[2][again].tolist())}):
            a, b = _plain_lag(ids, int(start[i]), int(end[i]), x)
            more.append((a, b, np.full(len(a), x)))
        s, e, q = (np.concatenate(x) for x in zip(*more))
        keep, _ = _smallest(s, e, q)
        s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def periodic_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in rows of words, by start, then period."""
    return scan_lags(ids, *split_by_frequency(ids, bounds))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, where a row is made to repeat.

    One id in ten repeats the words from a place on with a period; both come
    from the checksum of its decimal id. A row without an id stays as it is.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


def _strongest(s, e, q) -> int:
    """The run of greatest length/period; ties to the first by start and period."""
    power = (e - s) / q
    near = np.flatnonzero(power >= power.max() * (1 - 1e-9))
    return int(max(near, key=lambda i: (Fraction(int(e[i] - s[i]), int(q[i])), -i)))


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _rows(plant: bool):
    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in words(batch.column(1)):
                found, bounds = part.words, part.bounds
                mine = ids[part.first : part.first + len(bounds) - 1]
                if plant:
                    at = np.arange(len(found))
                    for row, doc_id in enumerate(mine):
                        low, high = bounds[row], bounds[row + 1]
                        moved = planted(int(high - low), doc_id)
                        if moved is not None:
                            at[low:high] = low + moved
                    found = found.take(pa.array(at))
                yield _digest(mine, found, bounds)

    return rows


def _digest(mine: list, found: pa.Array, bounds: np.ndarray) -> pa.RecordBatch:
    s, e, q = periodic_runs(numbers(found), bounds)
    # words of a run after its first period
    depth = np.zeros(len(found) + 1, np.int64)
    np.add.at(depth, s + q, 1)
    np.add.at(depth, e, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, bounds), pa.int32()), found.take(pa.array(kept)))
    left = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    at = np.searchsorted(s, bounds)
    out = []
    for row, doc_id in enumerate(mine):
        low, high, base = at[row], at[row + 1], int(bounds[row])
        a, b, p = s[low:high] - base, e[low:high] - base, q[low:high]
        best = (None,) * 4
        if high > low:
            i = _strongest(a, b, p)
            length, period = int(b[i] - a[i]), int(p[i])
            best = (int(a[i]), length, period, 1000 * length // period)
        text = "".join(f"{x},{y - x},{z}\n" for x, y, z in zip(a.tolist(), b.tolist(), p.tolist()))
        n = int(bounds[row + 1]) - base
        stay = int(np.searchsorted(kept, bounds[row + 1]) - np.searchsorted(kept, base))
        digests = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left[row].as_buffer()).hexdigest()
        out.append((doc_id, int(high - low), *best, *digests, n, n - stay))
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)


def run_report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row: number of runs, the strongest one, digests of all and of the rest.

    ``collapsed_sha256`` is of the words that stay when every run keeps its
    first period, joined by single spaces. A null or empty text has no words;
    rows that repeat an id are judged each for itself, and so is a row with a
    null id. Equal strengths go to the smallest start, then period. Other
    columns are ignored; an empty table gives an empty result. With ``plant``
    one id in ten is made to repeat first.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rows(plant), _OUT)


def _collapsed(text: int):
    def rows(batches):
        for batch in batches:
            out = []
            for part in words(batch.column(text)):
                s, e, q = periodic_runs(numbers(part.words), part.bounds)
                depth = np.zeros(len(part.words) + 1, np.int64)
                np.add.at(depth, s + q, 1)
                np.add.at(depth, e, -1)
                gone = np.cumsum(depth[:-1]) > 0
                # a dropped word goes with the white space after it
                starts = runs(~SPACE[part.data], part.offsets)[0]
                raw = part.data
                drop = np.zeros(len(raw) + 1, np.int64)
                ends = np.r_[starts[1:], len(raw)]
                row_end = part.offsets[np.searchsorted(part.offsets, starts, "right")]
                np.add.at(drop, starts[gone], 1)
                np.add.at(drop, np.minimum(ends, row_end)[gone], -1)
                stays = np.cumsum(drop[:-1]) == 0
                for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
                    out.append(raw[a:b][stays[a:b]].tobytes().decode())
            new = pa.array(out, pa.string())
            new = pc.if_else(pc.is_null(batch.column(text)), pa.scalar(None, pa.string()), new)
            columns = [*batch.columns]
            columns[text] = new
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of ``text`` cut to its first period.

    A dropped word goes with the white space behind it; other white space, other
    columns and null texts stay. An empty table gives an empty table.
    """
    session(docs)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(*[text if c == "text" else docs[c] for c in docs.columns])
    return rows.mapInArrow(_collapsed(rows.columns.index("text")), rows.schema)
