"""Byte-exact dedup of repeated passages by two-stage suffix sorting.

A byte goes if a ``LENGTH``-byte string that covers it also starts elsewhere,
in any document or the same one. The work is cut so that no step holds more
than a bounded stretch of text:

1. Every window of ``LENGTH`` bytes is named by its anchor, the smallest hash
   among the ``GRAM``-byte strings inside it. Equal windows have equal anchors.
   Neighbouring windows share an anchor, so a document has about one anchor in
   75 bytes; with the bytes of all its windows it forms a *context*.
2. Anchors that occur once are unique, and so are their windows. If all
   contexts of an anchor are equal, all their windows are repeated.
3. Only anchors with different contexts are left. The distinct contexts of an
   anchor come together in one task, which sorts their suffixes in two stages
   and looks for adjacent suffixes with a common prefix of ``LENGTH`` bytes. An
   anchor with more than ``CROWD`` distinct contexts is split first: half of
   its windows reach further to the left, half further to the right, and what
   those have in common names the part.

Suffix sorting directly sorts only the suffixes that are smaller than their
successor; a scan over the buckets of first bytes, in order, puts every other
suffix behind the successors that were placed before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import chunks, grouped, mix, range_hash, session, signed, stage, sums_before

LENGTH = 200
GRAM = 48
CROWD = 8192
# Bytes of contexts that are sorted at once.
SORTED_BYTES = 1 << 21
# Bits of an anchor's key that hold its place: texts of up to 2**28 bytes.
PLACE_BITS = 28


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of a chunk: row, anchor hash, context hash, place, first and last window."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    sums = sums_before(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = range_hash(sums, at, at + GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = sliding_least((grams & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)
    row = np.searchsorted(offsets, np.arange(len(best)), "right") - 1
    start = np.flatnonzero(np.arange(len(best)) + LENGTH <= offsets[row + 1])
    if not len(start):
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    place = (best[start] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    s0, s1, p = start[first], start[last], place[first]
    context = mix(range_hash(sums, s0, s1 + LENGTH) ^ (p - s0).astype(np.uint64))
    return row[s0], grams[p], context, p, s0, s1


def _pack(p, s0, s1):
    return s0 << 16 | (p - s0) << 8 | (s1 - s0)


def _scan(batches):
    for batch in batches:
        for first, _, data, offsets in chunks(batch.column(1)):
            row, v, c, p, s0, s1 = anchors(data, offsets)
            if len(row):
                base = offsets[row]
                t = batch.column(0).take(pa.array(row + first))
                at = pa.array(_pack(p - base, s0 - base, s1 - base))
                yield pa.RecordBatch.from_arrays([t, pa.array(signed(v)), pa.array(signed(c)), at], ["t", "v", "c", "at"])


def _contexts(batches):
    for batch in batches:
        vs, cs, off, run, out = [], [], [], [], []
        for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode()
            for w in wanted:
                s0, o, r = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                vs.append(w["v"])
                cs.append(w["c"])
                off.append(o)
                run.append(r)
                out.append(raw[s0 : s0 + r + LENGTH])
        arrays = [pa.array(vs, pa.int64()), pa.array(cs, pa.int64()), pa.array(off, pa.int32()), pa.array(run, pa.int32()), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["v", "c", "off", "run", "ctx"])


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros behind the end."""
    out = np.zeros(len(text), np.uint64)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)].astype(np.uint64)
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one behind them; the last is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.zeros(n, bool)
    # the next place where a byte differs from its successor decides
    ahead = np.searchsorted(change, np.arange(n))
    inside = ahead < len(change)
    out = np.zeros(n, bool)
    at = change[ahead[inside]]
    out[inside] = text[at] < text[at + 1]
    return out


def direct_order(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the first ``depth`` bytes of the suffixes, eight at a time."""
    padded = np.r_[words, np.zeros(depth + 8, np.uint64)]
    order = at[np.argsort(padded[at], kind="stable")]
    key = padded[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(order) else np.zeros(0, np.int64)
    left = np.arange(len(order))
    for d in range(8, depth, 8):
        g = group[left]
        tied = np.zeros(len(left), bool)
        same = g[1:] == g[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        left = left[tied]
        if not len(left):
            break
        g, part = group[left], order[left]
        key = padded[part + d]
        by = np.lexsort((key, g))
        order[left], key, g = part[by], key[by], g[by]
        # members of a group keep its first place as their number, split by the new key
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        group[left] = left[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least (default: all)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    small = smaller_than_successor(text)
    direct = direct_order(words_at(text), np.flatnonzero(small), depth)
    where = np.searchsorted(text[direct], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix has only the end behind it: it comes first among its byte
    front[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        placed = 0
        while placed < len(front[c]):
            part = front[c][placed]
            placed += 1
            out.append(part)
            _induce(text, small, part, front)
        part = direct[where[c] : where[c + 1]]
        out.append(part)
        _induce(text, small, part, front)
    return np.concatenate(out)


def _induce(text, small, part, front) -> None:
    """Hands the larger predecessors of a sorted part to their buckets, in order."""
    before = part[part > 0] - 1
    before = before[~small[before]]
    if not len(before):
        return
    first = text[before]
    by = np.argsort(first, kind="stable")
    cuts = np.flatnonzero(np.r_[True, first[by][1:] != first[by][:-1]])
    for piece in np.split(before[by], cuts[1:]):
        front[text[piece[0]]].append(piece)


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which valid starts share ``length`` bytes with another valid start."""
    order = suffix_array(text, length + 8)
    order = order[valid[order]]
    words = words_at(text)
    left = np.arange(len(order) - 1)
    for d in range(0, length - 7, 8):
        left = left[words[order[left] + d] == words[order[left + 1] + d]]
    for d in range(length - length % 8, length):
        left = left[text[order[left] + d] == text[order[left + 1] + d]]
    out = np.zeros(len(text), bool)
    out[order[left]] = True
    out[order[left + 1]] = True
    return out


def _sort_contexts(rows):
    """Marks of the windows of each context row: (c, v, starts that are repeated)."""
    contexts, off, run = rows.column("ctx").to_pylist(), rows.column("off").to_numpy(), rows.column("run").to_numpy()
    lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    size = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(size) - size
    # no byte of UTF-8 is 255, so adding one leaves zero as a border
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
    valid = np.zeros(len(text), bool)
    for b, o, r, x, y in zip(begin, off, run, lo, hi):
        valid[b + max(0, o - y) : b + min(r, o - x) + 1] = True
    marks = repeated_starts(text, valid)
    starts = [np.flatnonzero(marks[b : b + r + 1]).astype(np.int32) for b, r in zip(begin, run)]
    offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in starts])].astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts)))
    return pa.RecordBatch.from_arrays([rows.column("v").combine_chunks(), rows.column("c").combine_chunks(), lists], ["v", "c", "starts"])


def _tasks(batches):
    held, size = [], 0
    for table in grouped(batches, ["key"]):
        if table.num_rows < 2:
            continue
        held.append(table)
        size += table.nbytes
        if size >= SORTED_BYTES:
            yield _sort_contexts(pa.concat_tables(held).combine_chunks())
            held, size = [], 0
    if held:
        yield _sort_contexts(pa.concat_tables(held).combine_chunks())


def _uncrowded(rows: DataFrame, crowd: int) -> DataFrame:
    """Splits keys of more than ``crowd`` rows by what half of their windows share."""
    whole, left = None, rows
    while True:
        sizes = left.groupBy("key").agg(F.count("*").alias("n"))
        many = stage(sizes.where((F.col("n") > crowd)).select("key"), "crowded")
        if many.isEmpty():
            return left if whole is None else whole.unionAll(left)
        calm = left.join(many, "key", "left_anti")
        whole = calm if whole is None else whole.unionAll(calm)
        hot = left.join(many, "key", "left_semi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("hi").alias("b"))))
        split = hot.select("*", halves.alias("half")).where("half.a <= half.b")
        # keep the rows that have a window in the half
        split = split.where((F.col("half.a") <= F.col("off")) & (F.col("half.b") >= F.col("off") - F.col("run")))
        shared = F.expr(f"substring(ctx, off - half.a + 1, {LENGTH} - half.b + half.a)")
        split = split.withColumn("key", F.xxhash64("key", "half.a", "half.b", shared))
        split = split.withColumn("lo", F.col("half.a")).withColumn("hi", F.col("half.b")).drop("half")
        # rows alike in all of one window need no comparison: keep two of them
        left = stage(split, "halves")
        same = left.where("lo = hi")
        if not same.isEmpty():
            numbered = same.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
            marked = same.join(numbered.select("key"), "key", "left_semi")
            whole = whole.unionAll(marked.withColumn("key", F.xxhash64("key", "c")).withColumn("twin", F.lit(True)))
            left = left.where("lo < hi")


def repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(t, spans)`` for texts (by their hash) with repeated bytes: pieces to remove.

    ``spans`` are start and end of repeated stretches; they may overlap.
    """
    session(docs)
    rows = docs.where(F.octet_length("text") >= LENGTH).select(F.xxhash64("text").alias("t"), "text")
    found = rows.mapInArrow(_scan, "t long, v long, c long, at long")
    shared = found.groupBy("v").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    shared = stage(shared.select("v", (F.col("c0") != F.col("c1")).alias("mixed")), "anchors")
    hits = stage(found.join(shared, "v"), "hits")
    mixed = hits.where("mixed").groupBy("v", "c").agg(F.count("*").alias("n"), F.min_by("at", F.struct("t", "at")).alias("at"), F.min("t").alias("t"))
    mixed = stage(mixed, "mixed")
    wanted = mixed.groupBy("t").agg(F.collect_list(F.struct("v", "c", "at")).alias("wanted"))
    # the filter lets Spark build a Bloom filter from the written table
    wanted = stage(wanted, "wanted").where(F.size("wanted") > 0)
    contexts = rows.join(wanted, "t").select("wanted", "text").mapInArrow(_contexts, "v long, c long, off int, run int, ctx binary")
    contexts = stage(contexts.dropDuplicates(["v", "c"]), "contexts")
    ready = contexts.select(F.col("v").alias("key"), "*", F.lit(0).alias("lo"), F.lit(LENGTH).alias("hi"), F.lit(False).alias("twin"))
    parts = _uncrowded(ready, crowd)
    twins = parts.where("twin").select("v", "c", F.array((F.col("off") - F.col("lo")).cast("int")).alias("starts"))
    sorted_ = parts.where("NOT twin").drop("twin").repartition("key").sortWithinPartitions("key")
    marked = sorted_.mapInArrow(_tasks, "v long, c long, starts array<int>")
    starts = marked.unionAll(twins).where(F.size("starts") > 0).groupBy("v", "c").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    judged = mixed.select("v", "c", "n").join(starts, ["v", "c"], "left")
    # a context that occurs twice is repeated in all its windows
    judged = judged.select("v", "c", F.when(F.col("n") == 1, F.coalesce("starts", F.array().cast("array<int>"))).alias("starts"))
    judged = stage(judged, "judged")
    begin = F.shiftright("at", 16)
    run = F.col("at").bitwiseAND(F.lit(255))
    whole = F.array(F.struct(begin.alias("s"), (begin + run + LENGTH).alias("e")))
    each = F.transform("starts", lambda s: F.struct((begin + s).alias("s"), (begin + s + LENGTH).alias("e")))
    sure = hits.where("NOT mixed").select("t", whole.alias("spans"))
    rest = hits.where("mixed").join(judged, ["v", "c"]).select("t", F.when(F.col("starts").isNull(), whole).otherwise(each).alias("spans"))
    every = sure.unionAll(rest).where(F.size("spans") > 0).distinct()
    return every.groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _digests(batches):
    for batch in batches:
        total, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
            raw = text.encode()
            at, count, out, gone = 0, 0, [], 0
            if spans.is_valid:
                pairs = np.stack([spans.values.field("s").to_numpy(), spans.values.field("e").to_numpy()], axis=1)
                for s, e in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                    if s > at or count == 0:
                        out.append(raw[at:s])
                        count += 1
                        gone += e - s
                        at = e
                    elif e > at:
                        gone += e - at
                        at = e
            out.append(raw[at:])
            total.append(len(raw))
            removed.append(gone)
            runs.append(count)
            kept.append(hashlib.sha256(b"".join(out)).hexdigest())
        arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (total, removed, runs)], pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def passages(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text is empty; texts of fewer than ``LENGTH`` bytes lose nothing.
    Rows with a null id are returned too. Rows that repeat are documents of
    their own, so both lose what they share. Other columns are ignored; an empty
    table gives an empty result.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = repeats(rows.select("text"), crowd)
    joined = rows.withColumn("t", F.xxhash64("text")).join(found, "t", "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(_digests, out)
