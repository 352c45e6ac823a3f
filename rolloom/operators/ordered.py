"""Order-dependent operators without a window over a whole table.

Positions come from ranges of the order that hold about as many rows each.

A running total or a fill-forward inside a key takes an order without large
gaps, as steps and line numbers are. Rows are cut into buckets of the order
column, each bucket is reduced to one row, and the same operator runs over the
bucket rows to give every bucket its starting value. A window then spans one
bucket of at most ``WIDTH`` order values, however much one key holds, and the
last one the buckets of a key: 1.5 million rows for 10**11 order values.
``levels`` adds further rounds of buckets for still longer keys.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.session import work_dir

WIDTH = 65536


def running_sums(
    rows: DataFrame, keys: list[str], order: str, values: list[str], levels: int = 1, width: int | None = None
) -> DataFrame:
    """Adds ``<value>_before``: the sum over all rows of the key that precede.

    ``order`` is an integer column, unique within the keys. With ``levels``
    bucket levels the last window sees ``n / width**levels`` rows per key.
    """
    width = width or WIDTH
    before = [f"{v}_before" for v in values]
    own = Window.partitionBy(*keys).orderBy(order)
    if levels == 0:
        prior = own.rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(v).over(prior), F.lit(0)).alias(b) for v, b in zip(values, before)]
        return rows.select("*", *sums)
    bucket = f"{order}_b{levels}"
    cut = rows.withColumn(bucket, F.floor(F.col(order) / width))
    totals = cut.groupBy(*keys, bucket).agg(*[F.sum(v).alias(v) for v in values])
    starts = running_sums(totals, keys, bucket, values, levels - 1, width).select(
        *keys, bucket, *[F.col(b).alias(f"{b}_start") for b in before]
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [
        (F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{b}_start")).alias(b)
        for v, b in zip(values, before)
    ]
    return cut.join(starts, [*keys, bucket]).select(*rows.columns, *sums)


def positions(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the dense 0-based position of each row in the given order.

    The rows are dealt by ranges of the order columns and sorted inside their
    range, which is one shuffle and no window: the place inside a range comes
    with the sorted row, and the rows before a range from one count per range.
    Ranges are cut by rank, so neither sparse values nor one that holds a third
    of all rows makes a large one; only rows that are equal in all columns of
    the order stay together. They are told apart by their place in the written
    table, which every later reader shares.

    ``parts`` is the number of ranges, by default the session's shuffle
    partitions. The driver sees one number for each of them.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    path = work_dir(spark, "positions")
    marked = dealt.withColumn("_at", F.monotonically_increasing_id())
    marked.write.parquet(path)
    placed = spark.read.schema(marked.schema).parquet(path)
    # such an id holds the number of the range above bit 33, the place below
    part = F.shiftrightunsigned("_at", 33)
    counts = dict(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    numbers = sorted(counts)
    before = accumulate((counts[p] for p in numbers[:-1]), initial=0)
    starts = spark.createDataFrame(list(zip(numbers, before)), "_p bigint, _before bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row of two numbers for each range
    found = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return found.select(*rows.columns, (F.col("_before") + place).alias(name))


def dense_index(rows: DataFrame, major: str, minor: str, name: str = "gi", parts: int | None = None) -> DataFrame:
    """Dense 0-based position in (major, minor) order."""
    return positions(rows, [major, minor], name, parts)


def keyed_index(
    rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None
) -> DataFrame:
    """Dense 0-based position in the given order inside each key.

    A key's rows are consecutive in the order of keys and ``order``, so their
    positions less the smallest of them count from 0. The smallest is a partial
    aggregate; a key with a third of all rows is spread over many ranges.
    """
    placed = positions(rows, [*keys, *order], name, parts)
    if not keys:
        return placed
    renamed = [f"_key{i}" for i in range(len(keys))]
    first = placed.groupBy(*[F.col(k).alias(r) for k, r in zip(keys, renamed)]).agg(F.min(name).alias("_first"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)])
    return placed.join(first, same).select(*rows.columns, (F.col(name) - F.col("_first")).alias(name))


def last_seen(
    rows: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    levels: int = 1,
    width: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Adds the latest non-NULL ``value`` of an earlier row (or the same one).

    This is an as-of join of a log with itself: each line takes the most
    recent header.
    """
    width = width or WIDTH
    end = 0 if inclusive else -1
    marked = rows.withColumn(name, value)
    kept = [c for c in rows.columns if c != name]

    def fill(*parts: str) -> Column:
        w = Window.partitionBy(*keys, *parts).orderBy(order)
        return F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))

    if levels == 0:
        return marked.select(*kept, fill().alias(name))
    bucket = f"{order}_b{levels}"
    cut = marked.withColumn(bucket, F.floor(F.col(order) / width))
    ends = cut.groupBy(*keys, bucket).agg(
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_end")
    )
    start = f"_start{levels}"
    starts = last_seen(ends, keys, bucket, F.col("_end"), start, levels - 1, width, inclusive=False)
    starts = starts.select(*keys, bucket, start)
    filled = F.coalesce(fill(bucket), F.col(start))
    return cut.join(starts, [*keys, bucket]).select(*kept, filled.alias(name))
