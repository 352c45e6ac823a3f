"""Benchmark items inside documents, by size-partitioned MinHash containment.

An item is the set of its five-word shingles. Items fall into partitions by the
size of that set, in powers of two. Each partition has its own sketch length
and its own number of hits to ask for: an item keeps its smallest hashes, and a
document that holds 0.8 of the item holds at least so many of them, but for one
case in ``MISS``. A document's side of the sketch is every shingle hash up to
the largest one any sketch holds, so the length of a document does not dilute
an item of fifteen words.

Candidates are then verified: the item's whole shingle set against the
document's. Everything is built from DataFrame functions; hits are found before
any shuffle when the sketch is small enough for Spark to broadcast it (it is a
written table, so Spark knows its size), by a shuffled join otherwise.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import stage

WORDS = 5
# Containment of 0.8 as a fraction of whole numbers.
PART, WHOLE = 4, 5
MISS = 1e-4
SKETCH = 8
CLASSES = 31


def sketch_length(size_class: int) -> int:
    """Hashes kept by items of ``2**size_class`` shingles and more."""
    return SKETCH + max(0, size_class - 3) * 2


def needed_hits(size_class: int) -> int:
    """Hits that a containment of 0.8 gives in all but ``MISS`` of the cases."""
    m, missed, hits = sketch_length(size_class), 0.0, 0
    while True:
        missed += comb(m, hits) * (PART / WHOLE) ** hits * (1 - PART / WHOLE) ** (m - hits)
        if missed > MISS:
            return max(hits, 1)
        hits += 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(rows: DataFrame, key: str) -> DataFrame:
    """``(key, h)``: one row per position of a five-word shingle."""
    split = rows.select(F.col(key), words(F.col("text")).alias("w"))
    # explode_outer: the plain one adds a filter that would split every text twice
    place = F.when(F.size("w") >= WORDS, F.sequence(F.lit(0), F.size("w") - WORDS))
    placed = split.select(key, "w", F.explode_outer(place).alias("i")).where("i IS NOT NULL")
    return placed.select(key, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(WORDS)]).alias("h"))


def item_sets(items: DataFrame) -> DataFrame:
    """``(item_id, h, n_item, size_class)``: distinct shingles with the item's count."""
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sets = shingles(texts, "item_id").distinct()
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sizes = sizes.withColumn("size_class", F.floor(F.log2(F.col("n_item") + F.lit(0.5))).cast("int"))
    return sets.join(sizes, "item_id")


def sketches(sets: DataFrame) -> DataFrame:
    """The smallest hashes of every item, and the hits to ask for."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    lengths = F.array(*[F.lit(sketch_length(c)) for c in range(CLASSES)])
    hits = F.array(*[F.lit(needed_hits(c)) for c in range(CLASSES)])
    kept = sets.withColumn("place", place).where(F.col("place") <= F.get(lengths, F.col("size_class")))
    # an item shorter than its sketch is known whole: ask for 0.8 of it
    whole = F.ceil(F.col("n_item") * F.lit(PART) / F.lit(WHOLE))
    ask = F.when(F.col("n_item") <= F.get(lengths, F.col("size_class")), whole).otherwise(F.get(hits, F.col("size_class")))
    return kept.select("h", "item_id", ask.cast("int").alias("needed"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shared, n_item`` with containment of 0.8 or more.

    Containment is the share of the item's distinct five-word shingles that the
    document holds; words are runs of letters, marks and digits of the
    lower-cased text. Items of fewer than five words have no shingles and are
    never found; nor is anything in a null or empty text. Rows with a null id
    on either side take no part. Rows that repeat an id count as one document
    or item with all their shingles. Other columns are ignored; an empty table
    on either side gives no pairs.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(item_sets(items), "items")
    sketch = stage(sketches(sets), "sketches")
    largest = F.lit(sketch.agg(F.max("h")).first()[0])
    probe = shingles(docs, "doc_id").where(F.col("h") <= largest)
    hits = probe.join(sketch, "h").groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("h").alias("hits"))
    found = stage(hits.where("hits >= needed").select("doc_id", "item_id"), "candidates")
    some = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = shingles(some, "doc_id").join(sets.select("h", "item_id", "n_item"), "h")
    counts = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    held = counts.where(F.col("n_shared") * WHOLE >= F.col("n_item") * PART)
    return held.join(found, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    leaky = stage(contained(docs, items).select(F.col("doc_id").alias("_llm_id")).distinct(), "leaky")
    return docs.join(leaky, docs["doc_id"].cast("long") == F.col("_llm_id"), "left_anti")


# Exact containment in SQL; the operator must agree with it.
SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
its AS (
  SELECT DISTINCT item_id, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
sizes AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM its JOIN ds USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) * 5 >= any_value(n_item) * 4
"""
