"""Incremental forms: new files are scored once, counters survive restarts."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.sources import folders

# Folders that the driver lists at once.
LISTED = 16


def new_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Stream over JSON-lines files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def append_scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Score what is new and append it exactly once.

    The checkpoint records the files read, the sink's log the files written;
    a restarted job goes on behind both.
    """
    query = (
        score(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, sink: str) -> dict[int, list[tuple[int, str]]]:
    """Finished generations of every bucket, newest first, with their folders.

    A generation is finished when its write is: then it holds ``_SUCCESS``.
    """
    done = {os.path.dirname(p) for p in folders.matching(spark, f"{sink}/generation=*/_SUCCESS")}
    out: dict[int, list[tuple[int, str]]] = {}
    for path in folders.matching(spark, f"{sink}/generation=*/bucket=*"):
        parent, name = os.path.split(path)
        if parent in done:
            out.setdefault(int(name.split("=")[1]), []).append((int(parent.rsplit("=", 1)[1]), path))
    return {bucket: sorted(found, reverse=True) for bucket, found in out.items()}


def _prune(spark: SparkSession, sink: str, spare: int) -> None:
    """Removes what more than ``spare`` newer generations of its bucket replace."""
    kept = set()
    for found in _generations(spark, sink).values():
        for generation, path in found[spare + 1 :]:
            folders.remove(spark, path)
        kept |= {generation for generation, _ in found[: spare + 1]}
    for path in folders.matching(spark, f"{sink}/generation=*/_SUCCESS"):
        parent = os.path.dirname(path)
        if int(parent.rsplit("=", 1)[1]) not in kept:
            folders.remove(spark, parent)


def _unmatched(rows: DataFrame, others: DataFrame, ids: list[str]) -> DataFrame:
    """Rows whose ids the others do not hold; a null is an id like any other."""
    names = [f"_other{i}" for i in range(len(ids))]
    others = others.select(*[F.col(c).alias(n) for c, n in zip(ids, names)])
    return rows.join(others, reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(ids, names)]), "left_anti")


def running_totals(
    stream: DataFrame, key: str, values: list[str], sink: str, checkpoint: str, buckets: int = 16, spare: int = 1
) -> None:
    """Totals per key over all files so far, kept across restarts.

    The stream's state holds one row per key. The sink is a snapshot in buckets
    of the key. A trigger reads the buckets in which keys changed, replaces these
    keys and writes the buckets as a generation of its own number; when that is
    finished, older generations of the same buckets go, but for ``spare`` ones
    that readers may still be at. So the sink holds every key at most
    ``1 + spare`` times, however many triggers there were.

    A trigger that is repeated after a failure finds its generation finished,
    and has only to remove what is old, or writes it again from the generations
    before it, which are still there: totals replace, they are not added. Sink
    and checkpoint belong together: a new checkpoint needs a new sink.
    """
    totals = stream.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{sink}/generation={number}"
        # read in any case: the stream's state is written as the batch is read
        changed = batch.withColumn("bucket", _bucket([key], buckets)).persist()
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]
        if touched and not folders.exists(spark, f"{target}/_SUCCESS"):
            folders.remove(spark, target)
            before = _generations(spark, sink)
            paths = [before[b][0][1] for b in touched if b in before]
            rows = changed
            if paths:
                held = spark.read.schema(batch.schema).parquet(*paths).withColumn("bucket", _bucket([key], buckets))
                rows = _unmatched(held, changed, [key]).unionByName(changed)
            rows.repartition("bucket").write.partitionBy("bucket").parquet(target)
        changed.unpersist()
        _prune(spark, sink, spare)

    query = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def latest_totals(spark: SparkSession, sink: str, key: str, values: list[str]) -> DataFrame:
    """Current totals: the newest finished generation of every bucket."""
    paths = [found[0][1] for found in _generations(spark, sink).values()]
    if not paths:
        raise ValueError(f"no finished generation in {sink}")
    return spark.read.parquet(*paths).select(key, *values)


def append_distinct(
    stream: DataFrame, ids: list[str], sink: str, checkpoint: str, by: list[str] | None = None, buckets: int = 64
) -> None:
    """Rows whose ids the sink does not hold yet, however late they come.

    A repeat is recognised by its ids alone, so a new row with an old time stamp
    is kept and a repeat with a new one is dropped. ``by`` names those of the
    ids that say where a row belongs, as run and step do; without it the ids are
    hashed into ``buckets``. The sink is partitioned by them, and a batch reads
    the ids of just the partitions its own rows fall into: a batch of one step
    costs one step, however much the sink holds and however old the step is.

    The rows of a partition are brought together before they are written, so the
    number of files grows with the partitions of a batch and not with its tasks.
    Inside a partition every batch has a folder of its own, which a replay
    replaces, and is compared with earlier batches only, so a replay writes the
    same rows. Null ids are ids like any other; an empty text in a column of
    ``by`` becomes null, as in every partitioned table.
    """
    parts = by or ["bucket"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*[F.nullif(c, F.lit("")).alias(c) if c in parts and t == "string" else c for c, t in batch.dtypes])
        rows = rows if by else rows.withColumn("bucket", _bucket(ids, buckets))
        fresh = rows.dropDuplicates(ids).persist()
        # one row for each partition that the batch itself writes
        touched = fresh.select(*[F.col(c).cast("string") for c in parts]).distinct().collect()
        with ThreadPoolExecutor(LISTED) as pool:
            found = pool.map(lambda row: _earlier(spark, sink, row.asDict(), number), touched)
            paths = [p for earlier in found for p in earlier]
        if paths:
            held = spark.read.option("basePath", sink).schema(rows.select(*ids).schema).parquet(*paths)
            kept = _unmatched(fresh, held, ids)
        else:
            kept = fresh
        # about a file for each partition, or several where there are fewer of them than tasks
        slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)))
        kept = kept.repartition(*parts, _bucket(ids, slices))
        out = kept.withColumn("batch", F.lit(number)).write.partitionBy(*parts, "batch")
        out.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(sink)
        fresh.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _earlier(spark: SparkSession, sink: str, values: dict, number: int) -> list[str]:
    """Folders of the batches before ``number`` in one partition of the sink."""
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    place = "/".join([sink.rstrip("/"), *[named(column, value) for column, value in values.items()]])
    return [p for p in folders.matching(spark, f"{place}/batch=*") if int(p.rsplit("=", 1)[1]) < number]
