"""Helpers of the corpus operators: stage tables, Arrow batches, word hashes.

Words are maximal runs of letters, digits and non-ASCII characters of the
lower-cased text. All hashes are 64 bits wide and depend on content alone, so
that a repeated task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rolloom.session import ship, work_dir
from rolloom.sources import folders

# Rows of one Arrow batch: a batch of long texts must fit a Python worker.
BATCH_ROWS = 256
# Bytes of text that one vectorised step takes.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


# Joins of whole texts with a few wanted ones: Spark builds a Bloom filter of
# bounded size from the wanted side and drops other texts before the shuffle.
# Shuffle files go when the query that made them has ended, not when the driver
# happens to collect its garbage: what is read again is a written table.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64m",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "2",
}


def session(rows: DataFrame) -> SparkSession:
    spark = rows.sparkSession
    ship(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stage(rows: DataFrame, label: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back: lineage ends here."""
    spark = rows.sparkSession
    path = work_dir(spark, label)
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes tables that ``stage`` wrote; nothing may read them afterwards."""
    for table in tables:
        folders.remove(table.sparkSession, table.staged)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers(int(_BASE))


def sums_before(data: np.ndarray) -> np.ndarray:
    """``s[i]``: the polynomial hash of the first ``i`` values."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start (inclusive) to end (exclusive)."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string array: first row, last row, bytes, row offsets."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, bounds: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; with ``marks`` also of every run of marks.

    ``bounds`` are offsets at which a word ends in any case.
    """
    kind = WORD[data].view(np.uint8)
    if marks:
        kind = kind + 2 * ((kind == 0) & (data > 32))
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = kind[start] > 0
    return start[keep], end[keep]


def word_hashes(data: np.ndarray, bounds: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of every word in order."""
    start, end = tokens(data, bounds, marks)
    return range_hash(sums_before(data), start, end), start


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one owner, and the owner of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), owner[:0]
    count = len(hashes) - n + 1
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + count]
    inside = owner[:count] == owner[n - 1 :]
    return mix(out[inside]), owner[:count][inside]


def segments(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of every run of equal owners, and the owners."""
    if not len(owner):
        return np.zeros(0, np.int64), owner
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return first, owner[first]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.r_[0, np.cumsum(lengths)].astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows that are sorted by ``keys``, also across batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is not None and any(c[0] != v for c, v in zip(columns, last))
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < batch.num_rows and change[a] and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
        last = [c[-1] for c in columns]
    if held:
        yield pa.concat_tables(held)


class Forest:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
