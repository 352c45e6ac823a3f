"""Quality by importance resampling: two hashed n-gram models, Gumbel top-k.

Words, runs of marks and their neighbouring pairs are hashed into buckets. One
generative model counts them over documents labelled good, another over all
documents; the log ratio of a document under the two is its importance weight.
Adding Gumbel noise to the log weights and keeping the k largest draws k
documents without replacement in proportion to the weights. k is the number of
documents at or above the weight that best separates the labelled ones.

The raw model counts every document. Labels come from a bounded sample of
``LABELS`` documents, chosen by a hash of their ids; only that sample and the
``2 * SLOTS`` weights are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rolloom.llm.common import chunks, lowered, mix, range_hash, session, stage, sums_before, tokens

SLOTS = 1 << 12
LABELS = 20_000
# Pseudo-counts by which the target model leans to the raw one.
LEAN = float(SLOTS)
# A good document rejected weighs as much as so many bad ones kept.
GOOD_COST = 3
SEED = 29

_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(texts: pa.Array):
    """Per chunk: first row, rows, slot of each feature and its row.

    Single tokens take the lower half of the slots, neighbouring pairs the
    upper half. A token followed by itself is one and the same pair whatever
    the token.
    """
    for first, last, data, offsets in chunks(lowered(texts)):
        start, end = tokens(data, offsets, marks=True)
        hashes = range_hash(sums_before(data), start, end)
        owner = np.searchsorted(offsets, start, "right") - 1
        mask = np.uint64(SLOTS - 1)
        one = (hashes & mask).astype(np.int64)
        pair = np.where(hashes[1:] == hashes[:-1], _REPEAT, mix(hashes[:-1] * np.uint64(3) + hashes[1:]))
        inside = owner[1:] == owner[:-1]
        two = (pair[inside] & mask).astype(np.int64) + SLOTS
        yield first, last - first, np.r_[one, two], np.r_[owner, owner[1:][inside]]


def _counts(batches):
    raw, target = np.zeros(2 * SLOTS, np.int64), np.zeros(2 * SLOTS, np.int64)
    for batch in batches:
        good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
        good &= batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        for first, _, slot, owner in features(batch.column(0)):
            raw += np.bincount(slot, minlength=2 * SLOTS)
            target += np.bincount(slot[good[first + owner]], minlength=2 * SLOTS)
    some = np.flatnonzero(raw)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["slot", "raw", "target"])


def log_ratios(labelled: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each slot, from ``(text, quality, learn)``."""
    counts = labelled.mapInArrow(_counts, "slot long, raw long, target long").groupBy("slot")
    found = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(2 * SLOTS), np.zeros(2 * SLOTS)
    raw[found.slot] = found.raw
    target[found.slot] = found.target
    out = np.zeros(2 * SLOTS)
    for half in (slice(0, SLOTS), slice(SLOTS, 2 * SLOTS)):
        p = (raw[half] + 0.1) / (raw[half] + 0.1).sum()
        q = (target[half] + LEAN * p) / (target[half].sum() + LEAN)
        out[half] = np.log(q / p)
    return out


def _scorer(weights, text: int):
    """Appends the log weight of column number ``text`` to every row."""

    def score(batches):
        table = weights.value
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for first, rows, slot, owner in features(batch.column(text)):
                sums[first : first + rows] = np.bincount(owner, weights=table[slot], minlength=rows)
            names = [*batch.schema.names, "_llm_score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names)

    return score


def with_scores(rows: DataFrame, weights) -> DataFrame:
    """All columns of ``rows`` and ``_llm_score``, the log weight of ``text``."""
    schema = StructType([*rows.schema.fields, StructField("_llm_score", DoubleType())])
    return rows.mapInArrow(_scorer(weights, rows.columns.index("text")), schema)


def noisy(score: Column, doc_id: Column, seed: int) -> Column:
    """The score with Gumbel noise from a hash of seed and id."""
    unit = (F.xxhash64(doc_id.cast("long"), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    return score - F.log(-F.log(unit))


def sample_labels(labels: DataFrame, size: int = LABELS) -> DataFrame:
    """At most ``size`` labelled ids; an id labelled twice has its worse label.

    ``learn`` marks the half the target model counts; the other half, which it
    has not seen, sets the cut.
    """
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    learn = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)) == 0
    return some.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(size).withColumn("learn", learn)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut of least cost on the sample; among equals the one that keeps most."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.r_[0, np.cumsum(good)] * GOOD_COST
    kept = (~good).sum() - np.r_[0, np.cumsum(~good)]
    # a cut lies between different scores
    able = np.r_[True, scores[1:] != scores[:-1], True]
    cost = np.where(able, lost + kept, np.inf)
    best = int(cost.argmin())
    if best == 0:
        return -np.inf
    if best == len(scores):
        return np.inf
    return float((scores[best - 1] + scores[best]) / 2)


def kth_largest(rows: DataFrame, column: str, k: int, collect: int = 10_000) -> float:
    """The k-th largest value, exactly, without a global sort.

    Approximate quantiles bracket it between two values of the table. One count
    of the rows above, at, between, at and below the two says where the k-th is:
    at one of them it is found, else the rows of that part are gone on with. The
    two values themselves are out of every part, so each round ends with fewer
    values, however often they repeat.
    """
    x = F.col(column)
    left, above = rows.select(x), 0
    while True:
        n = left.count()
        if n <= collect:
            values = sorted((r[0] for r in left.collect()), reverse=True)
            return values[k - above - 1]
        at = 1 - (k - above) / n
        low, high = left.approxQuantile(column, [max(0.0, at - 0.002), min(1.0, at + 0.002)], 0.001)
        parts = [x > high, x == high, (x < high) & (x > low), (x == low) & (x < high), x < low]
        counts = left.agg(*[F.count_if(p) for p in parts]).first()
        for part, count, value in zip(parts, counts, (None, high, None, low, None)):
            if k - above <= count:
                break
            above += count
        if value is not None:
            return value
        left = left.where(part)


def fitted(docs: DataFrame, labels: DataFrame, sample: int, seed: int):
    """Scores of all rows, the broadcast weights, and the least key selected."""
    spark = session(docs)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most LABELS rows of three values: a size to broadcast
    known = F.broadcast(stage(sample_labels(labels, sample), "labels"))
    labelled = rows.join(known, "doc_id", "left").select("doc_id", "text", "quality", "learn")
    weights = spark.sparkContext.broadcast(log_ratios(labelled.select("text", "quality", "learn")))
    scores = with_scores(labelled, weights).select("doc_id", "quality", "learn", F.col("_llm_score").alias("score"))
    scores = stage(scores.withColumn("key", noisy(F.col("score"), F.col("doc_id"), seed)), "scores")
    marked = scores.where("quality IS NOT NULL AND NOT learn").select("score", "quality").limit(sample).toPandas()
    good = marked.quality.to_numpy() == 1
    cut = best_cut(marked.score.to_numpy(), good) if good.any() and not good.all() else -np.inf
    k = scores.where(F.col("score") >= F.lit(float(cut))).count()
    return scores, weights, kth_largest(scores, "key", k) if k else np.inf


def resampled(docs: DataFrame, labels: DataFrame, sample: int = LABELS, seed: int = SEED) -> DataFrame:
    """Per row: ``doc_id, score`` (log weight), ``key`` (with noise), ``selected``.

    Null and empty texts have no features and the score 0. Rows with a null id
    take no part. Rows that repeat an id are scored each for itself, with the
    same noise; keys equal to the k-th are all selected. Without labels of
    both kinds all documents are selected. Other columns are ignored; an empty
    table gives an empty result.
    """
    scores, _, least = fitted(docs, labels, sample, seed)
    return scores.select("doc_id", "score", "key", (F.col("key") >= F.lit(float(least))).alias("selected"))


def selected(docs: DataFrame, labels: DataFrame, sample: int = LABELS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``resampled`` selects, and those with a null id."""
    _, weights, least = fitted(docs, labels, sample, seed)
    key = noisy(F.col("_llm_score"), F.col("doc_id"), seed)
    stays = F.col("doc_id").isNull() | (key >= F.lit(float(least)))
    return with_scores(docs, weights).where(stays).select(*docs.columns)
