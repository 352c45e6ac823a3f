"""Importance resampling to a target: array scores, then a distributed radix sort.

Features are the words of a text and its pairs of neighbouring words, hashed by
their checksum into ``BUCKETS`` buckets. One array of that fixed size holds the
gain of every bucket: how much more often it occurs in the target texts than in
all documents. A document's weight is the mean gain of its features; with
Gumbel noise from its id, the highest scores are a draw without replacement.

The order is made by an LSD radix sort of the key (score downwards, id). Each
pass looks at one digit: rows are counted per block of positions and digit,
prefix sums over digits and blocks say where the rows of a block with that digit
begin, and a row's place among them completes its new position. Passes are
stable, so after the last digit the position is the rank. A block is a bounded
range of positions, so no task ever holds more than a block of one digit,
whatever the keys look like, and each pass is written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import session, stage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Bits of one digit, and positions of one block: a block of a million rows is
# reduced to at most 4096 counts.
DIGIT_BITS = 12
BLOCK = 1 << 20
# Bytes of a text that are cut into words at once.
PIECE = 1 << 20

# Fixed: which bytes are part of a word, after A-Z became a-z.
_PLAIN = bytes(c if c >= 128 or re.match(b"[0-9a-z]", bytes([c])) else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded stretch of it at a time."""
    clean = text.lower().translate(_PLAIN)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def checksums(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Checksums of the words and of the neighbouring pairs of a text."""
    last: list[int] = []
    for words in pieces(text):
        if not words:
            continue
        one = list(map(crc32, words))
        two = [crc32(b" " + w, c) for w, c in zip(words[1 - len(last) :], last + one)]
        yield np.array(one, np.int64), np.array(two, np.int64)
        last = one[-1:]


def _texts(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def _counts(batches):
    found = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in _texts(batch.column(0)):
            for one, two in checksums(text):
                found += np.bincount(one % BUCKETS, minlength=BUCKETS) + np.bincount(two % BUCKETS, minlength=BUCKETS)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; one row per bucket and task is shuffled."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found.bucket] = found.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed frequencies, per bucket."""
    s, t = raw.astype(float), target.astype(float)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(table):
    def weigh(batches):
        gain = table.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, text in enumerate(_texts(batch.column(1))):
                for one, two in checksums(text):
                    n_words[i] += len(one)
                    n_features[i] += len(one) + len(two)
                    weight[i] += gain[one % BUCKETS].sum() + gain[two % BUCKETS].sum()
            # whole numbers: floor division rounds down
            mean = weight // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(mean)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: ``doc_id, n_words, n_features, weight, score``; null id, null score."""
    spark = session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the array has a fixed size of BUCKETS numbers
    table = spark.sparkContext.broadcast(gains(bucket_counts(rows), bucket_counts(target)))
    out = rows.mapInArrow(_weigher(table), "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _unsigned(key: Column) -> Column:
    """Bits that order as unsigned numbers do, from a signed number."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def sort_positions(rows: DataFrame, keys: dict[str, bool], name: str, block: int = BLOCK) -> DataFrame:
    """Adds ``name``, the 0-based position of each row in the order of the keys.

    ``keys`` maps columns of whole numbers without nulls, most significant
    first, to whether they descend. Rows with equal keys start in one block in the
    order of their other columns, and stay in it. The passes cover the bits in
    which the keys differ at all.
    """
    high = [_unsigned(F.col(k)) if not down else F.bitwise_not(_unsigned(F.col(k))) for k, down in keys.items()]
    # least and greatest of each key as unsigned numbers, and the number of rows
    ends = [f(k.bitwiseXOR(F.lit(-(1 << 63)))) for k in high for f in (F.min, F.max)]
    n, *ends = rows.agg(F.count("*"), *ends).first()
    blocks = max(1, -(-n // block))
    digits = []
    for at in reversed(range(len(keys))):
        bits = ((ends[2 * at] ^ ends[2 * at + 1]) & ((1 << 64) - 1)).bit_length() if n else 0
        for shift in range(0, bits, DIGIT_BITS):
            mask = (1 << min(DIGIT_BITS, bits - shift)) - 1
            digits.append(F.shiftrightunsigned(high[at], shift).bitwiseAND(F.lit(mask)).cast("int"))
    now = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("long"))
    order = [F.col(c) for c in rows.columns]
    # without a difference in any key one pass over a constant digit counts the rows
    for digit in digits or [F.lit(0)]:
        now = stage(_pass(now.withColumn("_digit", digit), order), "radix")
        now = now.withColumn("_block", F.floor(F.col("_at") / F.lit(block)).cast("long"))
        order = [F.col("_at")]
    return now.select(*rows.columns, F.col("_at").alias(name))


def _pass(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One stable counting pass: the position of every row by its digit."""
    count = rows.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 2 ** DIGIT_BITS digits are summed in one window
    digits = count.groupBy("_digit").agg(F.sum("_n").alias("_n")).select("_digit", before(Window.orderBy("_digit")).alias("_base"))
    inside = count.select("_digit", "_block", before(Window.partitionBy("_digit").orderBy("_block")).alias("_skip"))
    starts = inside.join(digits, "_digit").select("_digit", "_block", (F.col("_base") + F.col("_skip")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy(*order)) - 1
    kept = [c for c in rows.columns if c not in ("_digit", "_block", "_at")]
    placed = rows.withColumn("_place", place).join(starts, ["_digit", "_block"])
    return placed.select(*kept, (F.col("_start") + F.col("_place")).cast("long").alias("_at"))


def drawn(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, block: int = BLOCK
) -> DataFrame:
    """Per row: ``doc_id, n_features, weight, score, rank`` and ``n_words``.

    ``percent`` of the documents with at least ``least`` words are drawn; ranks
    count from 1, other rows have none. A null or empty text has no features
    and the weight 0. Rows with a null id are counted in the corpus but have
    neither score nor rank. Rows that repeat an id are drawn each for itself;
    of equal scores and ids the row with fewer words comes first. Other columns
    are ignored; an empty table gives an empty result, and an empty target
    makes common features rare ones.
    """
    every = stage(scored(docs, target, seed), "scored")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least)
    ranked = sort_positions(every.where(able), {"score": True, "doc_id": False}, "at", block)
    n = every.where(able).count() * percent // 100
    rank = F.when(F.col("at") < F.lit(n), F.col("at") + 1)
    rest = every.where(~able).withColumn("at", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The checksum works on the list of a feature's bytes, each followed by eight
# marks that stand for one shift of the polynomial.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
e AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf) x),
c AS (SELECT f, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(0, len(h) // 2),
        lambda i: list_concat([CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) % {BUCKETS} AS k FROM e),
s AS (SELECT k, count(*) AS s FROM df JOIN c USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN c USING (f) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS sn, (SELECT coalesce(sum(t), 0) FROM t) AS tn),
g AS (SELECT k, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (sn + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (tn + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (k), n),
w AS (SELECT rid, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN c USING (f) JOIN g USING (k) GROUP BY rid),
a AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM a),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS m FROM z WHERE n_words >= {LEAST_WORDS} AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * m // 100 THEN rank END AS rank, n_words FROM z LEFT JOIN r USING (rid)
"""
