"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

A document is the set of its hashed words, neighbouring pairs and pairs one
word apart. FTRL-proximal keeps for each coordinate the sum of its squared
gradients, which sets its rate, and a lazily regularised weight: below the L1
bound it is exactly zero, so few weights remain and the model can be broadcast.

Labels are learned from a bounded sample of rows whose crc32 of the id is not a
multiple of five. The sample is dealt into shards; each task runs the
sequential learner over its shard, and the shards' weights are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import chunks, grouped, lowered, mix, range_hash, session, stage, sums_before, tokens

SLOTS = 1 << 18
SAMPLE = 30_000
# Rows of one shard: a learner needs thousands of rows to find rare words.
SHARD_ROWS = 10_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
SEED = 5


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def documents_slots(texts: pa.Array):
    """Per chunk: first row, rows, slot and row of each distinct feature."""
    mask = np.uint64(SLOTS - 1)
    for first, last, data, offsets in chunks(lowered(texts)):
        start, end = tokens(data, offsets)
        hashes = range_hash(sums_before(data), start, end)
        owner = np.searchsorted(offsets, start, "right") - 1
        slots, rows = [hashes & mask], [owner]
        for gap, salt in ((1, 3), (2, 5)):
            inside = owner[gap:] == owner[:-gap]
            pair = mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])
            slots.append(pair[inside] & mask)
            rows.append(owner[gap:][inside])
        slot = np.concatenate(slots).astype(np.int64)
        row = np.concatenate(rows)
        both = np.unique(row * SLOTS + slot)
        yield first, last - first, both % SLOTS, both // SLOTS


def _features(batches):
    for batch in batches:
        for first, rows, slot, row in documents_slots(batch.column(2)):
            offsets = np.searchsorted(row, np.arange(rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(slot.astype(np.int32)))
            at = pa.array(np.arange(first, first + rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists], ["doc_id", "toxic", "slots"])


class Ftrl:
    """The learner; slot ``SLOTS`` is the intercept, which is not regularised by L1."""

    def __init__(self):
        self.z = np.zeros(SLOTS + 1)
        self.n = np.zeros(SLOTS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        bound = np.where(np.asarray(at) == SLOTS, 0.0, L1)
        return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, y: float) -> None:
        at = np.r_[slots, SLOTS]
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _train(batches):
    for table in grouped(batches, ["shard"]):
        slots = [np.asarray(x, np.int64) for x in table.column("slots").to_pylist()]
        labels = table.column("toxic").to_pylist()
        learner = Ftrl()
        for _ in range(EPOCHS):
            for x, y in zip(slots, labels):
                learner.learn(x, float(y))
        w = learner.weights(np.arange(SLOTS + 1))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["slot", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Averaged weights; zeros without labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # at most SAMPLE rows of two numbers: a size to broadcast
    known = F.broadcast(stage(known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample), "labels"))
    shards = max(1, round(known.count() / SHARD_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")
    x = rows.select("doc_id", "toxic", "text").mapInArrow(_features, "doc_id long, toxic int, slots array<int>")
    order = F.xxhash64("doc_id", F.lit(SEED + 1))
    x = x.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("o"), "toxic", "slots")
    dealt = x.repartition(shards, "shard").sortWithinPartitions("shard", "o", "slots").select("shard", "toxic", "slots")
    found = dealt.mapInArrow(_train, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros(SLOTS + 1)
    out[found.slot.to_numpy(np.int64)] = found.w.to_numpy() / shards
    return out


def _scorer(model):
    def score(batches):
        slots, values = model.value
        w = np.zeros(SLOTS + 1)
        w[slots] = values
        for batch in batches:
            sums = np.full(batch.num_rows, w[SLOTS])
            for first, rows, slot, row in documents_slots(batch.column(1)):
                sums[first : first + rows] += np.bincount(row, weights=w[slot], minlength=rows)
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``.

    A null or empty text has the score of the intercept. Rows with a null id
    are scored, never learned from, and not held out. Rows that repeat are
    scored each; an id labelled twice is toxic if any label says so. Without
    labels every score is 0.5. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = session(docs)
    w = fit(docs, labels, sample)
    some = np.flatnonzero(w)
    model = spark.sparkContext.broadcast((some, w[some]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
