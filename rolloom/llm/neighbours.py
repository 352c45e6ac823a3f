"""Nearest neighbours by a permutation index.

Pivots are vectors of the table, drawn by a hash of their ids. A vector is
represented by the order of its nearest pivots; each of them posts it, with its
place, in the pivot's inverted file. A query reads the files of its own nearest
pivots and ranks what it meets by the footrule distance of the two orders,
where a pivot beyond the prefix counts as standing just behind it. The best
``RERANK``, with all that tie with the last of them, are ranked again by exact
cosine; equal cosines go by vec_id, in the shard as in the end.

Over prefixes of length m the footrule distance is a constant less twice the
sum of ``m - max(place, place')`` over the pivots that both prefixes hold, so
a sum over the matching posts gives the rank.

The index is dealt into shards of about ``SHARD`` entries, each with the
inverted files of its entries, and the queries into blocks. Every shard answers
every block: it ranks and reranks its own entries, and hands on the best few of
each query. Equal vectors are one entry with their smallest ids, so a
vector that fills a third of the table is one post in each file.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import grouped, lists, session, stage

QUERY_EVERY = 50
K = 5
PIVOTS = 256
PREFIX = 64
# Entries of a shard, queries of a block, entries reranked for each of both.
SHARD = 8192
BLOCK = 1024
RERANK = 1000


def _usable(batches):
    """Vectors without nulls, zeros and non-finite parts: key, id, vector as doubles."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        keep, keys = [], []
        vectors = []
        for i, v in enumerate(column):
            v = v.values
            if v is None or not len(v) or v.null_count:
                continue
            x = v.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x + 0.0  # one zero for both signs
            keep.append(i)
            vectors.append(x)
            keys.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True))
        if keep:
            offsets = np.r_[0, np.cumsum([len(x) for x in vectors])].astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(vectors)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids.take(pa.array(keep)), array], ["v", "vec_id", "x"])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector is filled with zeros."""
    values, offsets = lists(column)
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - offsets[row]] = values
    return out


def _prefixes(pivots, width: int, m: int):
    """Represents each vector by its ``m`` nearest pivots in order."""

    def orders(batches):
        table = pivots.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = np.argsort(-(x @ table.T), axis=1, kind="stable")[:, :m].astype(np.int32)
            offsets = pa.array(np.arange(len(near) + 1, dtype=np.int32) * m)
            order = pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, order], ["v", "x", "least", "pivots"])

    return orders


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    # scaled first, so that squares neither overflow nor vanish
    left = left / np.abs(left).max(axis=1, keepdims=True)
    right = right / np.abs(right).max(axis=1, keepdims=True)
    dot = (left * right).sum(axis=1)
    return dot / np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))


def _answers(width: int, m: int, k: int, rerank: int):
    """One shard against one block of queries: the ``k`` best of each query."""

    def search(batches):
        for table in grouped(batches, ["shard", "block"]):
            table = table.combine_chunks()
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            keys, least = table.column("v").to_numpy(), table.column("least").to_numpy()
            x = _matrix(table.column("x").combine_chunks(), width)
            order = lists(table.column("pivots").combine_chunks())[0].reshape(-1, m)
            entries, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(entries) or not len(queries):
                continue
            # inverted files: for every pivot its entries and their places
            pivot = order[entries].ravel()
            by = np.argsort(pivot, kind="stable")
            entry, place = by // m, by % m
            cuts = np.searchsorted(pivot[by], np.arange(pivot.max() + 2))
            own, limit = x[entries], min(rerank, len(entries))
            qs, vs, scores = [], [], []
            for q in queries.tolist():
                shared = np.zeros(len(entries))
                for at, p in enumerate(order[q].tolist()):
                    if p < len(cuts) - 1:
                        file = slice(cuts[p], cuts[p + 1])
                        shared[entry[file]] += m - np.maximum(place[file], at)
                # all entries of the last rank that is still among the limit
                best = np.flatnonzero(shared >= np.partition(shared, len(shared) - limit)[len(shared) - limit])
                c = cosines(np.broadcast_to(x[q], (len(best), width)), own[best])
                # every id of an entry is at least its smallest one
                top = np.lexsort((least[entries[best]], -c))[:k]
                qs.append(np.full(len(top), keys[q]))
                vs.append(keys[entries[best[top]]])
                scores.append(c[top])
            arrays = [pa.array(np.concatenate(a)) for a in (qs, vs, scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["q", "v", "score"])

    return search


def nearest(rows: DataFrame, every: int = QUERY_EVERY, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: int = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query.

    Queries are the rows of ``rows(vec_id, embedding)`` whose id is divisible by
    ``every``; candidates are all others. Ties go to the smaller id. Vectors
    that are null, zero or hold a null or non-finite part, and rows with a null
    id, take no part. A shorter vector counts as filled up with zeros. Rows that
    repeat an id are candidates each; a query is matched by no row of its own
    id, and rows that repeat a query give its result once. With fewer than ``k``
    candidates all are returned. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = session(rows)
    given = rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    usable = stage(given.mapInArrow(_usable, "v long, vec_id long, x array<double>"), "vectors")
    # the k + 1 smallest ids of equal vectors are all that can be returned
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = usable.select("v", "vec_id").withColumn("place", place).where(F.col("place") <= k + 1)
    ids = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stage(usable.groupBy("v").agg(F.first("x").alias("x")).join(ids, "v"), "entries")
    n, width = entries.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    m = min(prefix, n, pivots)
    # at most PIVOTS vectors
    drawn = entries.orderBy(F.xxhash64("v", F.lit(3)), "v").limit(pivots).select("x").toArrow().column("x").combine_chunks()
    table = _matrix(drawn, width)
    table = table / np.abs(table).max(axis=1, keepdims=True)
    table = spark.sparkContext.broadcast(table / np.linalg.norm(table, axis=1, keepdims=True))
    shown = entries.select("v", "x", F.get("ids", F.lit(0)).alias("least"))
    index = shown.mapInArrow(_prefixes(table, width, m), "v long, x array<double>, least long, pivots array<int>")
    index = stage(index, "index")
    asking = usable.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    wanted = stage(asking.select("v").distinct(), "queries")
    shards, blocks = math.ceil(n / SHARD), max(1, math.ceil(wanted.count() / BLOCK))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    in_shard = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(shards)).cast("int").alias("shard")
    in_block = F.pmod(F.xxhash64("v", F.lit(6)), F.lit(blocks)).cast("int").alias("block")
    posts = index.select(in_shard, each_block, F.lit(False).alias("asks"), "v", "x", "least", "pivots")
    reads = index.join(wanted, "v", "left_semi").select(each_shard, in_block, F.lit(True).alias("asks"), "v", "x", "least", "pivots")
    dealt = posts.unionAll(reads).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks", "v")
    scored = dealt.mapInArrow(_answers(width, m, k + 1, rerank), "q long, v long, score double")
    scored = scored.join(entries.select("v", "ids"), "v")
    # own id, then k others: of each entry only its smallest ids can be among them
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists_ = stage(top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top")), "top")
    answers = asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(lists_, "q")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("place", "t"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score"))
