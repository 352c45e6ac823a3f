"""Flat and nested rollouts, request/answer joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest list built for one key. A key with more rows gets several parts, so
# no task ever holds an unbounded group; every row stays in exactly one part.
PART = 512


def flatten_lists(nested: DataFrame, keys: list[str], lists: list[str], index: str = "resp_idx") -> DataFrame:
    """Parallel lists to one row per element, numbered by position."""
    zipped = F.arrays_zip(*[F.col(c) for c in lists])
    rows = nested.select(*keys, F.posexplode(zipped).alias(index, "_item"))
    return rows.select(*keys, index, *[F.col(f"_item.{c}").alias(c) for c in lists])


def regroup(rows: DataFrame, key: str, index: str, values: list[str], part_size: int = PART) -> DataFrame:
    """Rows back to per-key lists in index order, in parts of bounded length.

    Keys of ordinary size give one row with ``part`` 0.
    """
    part = F.floor(F.col(index) / part_size).cast("int")
    items = F.array_sort(F.collect_list(F.struct(index, *values)))
    grouped = rows.groupBy(key, part.alias("part")).agg(items.alias("_items"))
    return grouped.select(key, "part", *[F.col(f"_items.{c}").alias(c) for c in values])


def answers_in_order(requests: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Every request with its answer, or the empty text where none came."""
    joined = requests.join(outputs, keys, "left")
    return joined.withColumn("response", F.coalesce("response", F.lit("")))


def split_by_method(rows: DataFrame, method: str, on_stdio: Column, on_function: Column, name: str) -> DataFrame:
    """Different treatment per test method (function by default), one pass."""
    is_stdio = F.coalesce(F.col(method), F.lit("function")) == "stdio"
    return rows.withColumn(name, F.when(is_stdio, on_stdio).otherwise(on_function))


def missing(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Required keys that were not found."""
    return required.join(found.select(key).distinct(), key, "left_anti")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose chunk has no finished output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all parts, matched by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def distinct_in_order(ids: Column) -> Column:
    """Distinct values, first occurrence first."""
    return F.array_distinct(ids)


def single_stop_ids(stops: DataFrame, key: str, ids: str) -> DataFrame:
    """Distinct stop ids of stops that are one token long, per key."""
    return stops.filter(F.size(ids) == 1).select(key, F.col(ids)[0].alias("stop_id")).dropDuplicates()


def metric_keys(rows: DataFrame, run: str, worker: str, metric: str) -> DataFrame:
    """Metrics that at least one worker of a run reports, with their number."""
    return rows.groupBy(run, metric).agg(F.count_distinct(worker).alias("workers"))


def with_source(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.withColumn(source, F.coalesce(source, F.lit("student")))
