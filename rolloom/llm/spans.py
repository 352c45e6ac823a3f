"""Rows with spans: shared by the operators that mark stretches of a text.

A span is ``(start, kind, end)`` in code points, the end exclusive; ``kind`` is
the place of its name in a list, base kinds first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind:int,end:int>>"


def written(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(text, ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the text (null as empty), other columns, and a row number ``rid``.

    ``rid`` is stable only once written, which the callers do at once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *columns, text)


def report(rows: DataFrame, added: DataFrame, kinds: list[str], base: int, *more: Column) -> DataFrame:
    """The digest per row of ``rows(rid, doc_id, base)`` and ``added(rid, added)``."""
    joined = rows.join(added, "rid", "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(SPANS)))
    counts = [count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(kinds[:base])]
    digest = F.sha2(written(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256")
    return joined.select("doc_id", *counts, digest, written(every, kinds).alias("spans"), *more)
