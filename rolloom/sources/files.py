"""Readers and writers for problem, rollout and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_bad"


def read_json_arrays(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Files that hold one JSON array each.

    Such a file is one task here. ``arrays.read_large_arrays`` reads one large
    array by many tasks, ``arrays.to_parquet`` converts a set once.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def read_json_lines(spark: SparkSession, paths, schema: str, keep_bad: bool = False) -> DataFrame:
    """Shards of JSON lines; blank lines are skipped.

    A line that does not parse fails the read. With ``keep_bad`` all rows are
    returned and such a line stands whole in ``_bad``.
    """
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    full = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    reader = spark.read.schema(full).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def read_parquet(spark: SparkSession, paths) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def write_dataset(rows: DataFrame, path: str, by: list[str], form: str = "parquet") -> None:
    """Partitioned dataset; each partition is written by the tasks that hold it."""
    rows.write.mode("overwrite").partitionBy(*by).format(form).save(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def solution_lines(rollouts: DataFrame) -> DataFrame:
    """(task_id, solution) per candidate; rows without a task are skipped."""
    return rollouts.filter(F.col("task_id").isNotNull()).select(
        "task_id", F.explode("full_output").alias("solution")
    )


def merged_chunks(chunks: DataFrame, expected: DataFrame, order: list[str]) -> DataFrame:
    """All chunks in order; reading the result fails if an expected one has no rows.

    ``expected`` names the chunks that were asked for. The guard is part of the
    plan: the absent chunks, reduced to one row, stand beside every row, and a
    row beside absent ones raises. Nothing runs before the result is read. Where
    chunks are folders, ``chunk_id`` comes from their names, and the guard reads
    no data. A result without any row has a row of its own to raise from.
    """
    asked = expected.select(F.col("chunk_id").alias("_asked")).where("_asked IS NOT NULL").distinct()
    found = chunks.select(F.col("chunk_id").alias("_found")).distinct()
    absent = asked.join(found, F.col("_asked") == F.col("_found"), "left_anti")
    # one row, whatever is absent; the message names the smallest and their number
    state = absent.agg(F.count("*").alias("_absent"), F.min("_asked").cast("string").alias("_first"))
    message = F.concat(F.lit("missing chunks: "), F.col("_absent").cast("string"), F.lit(", the first is "), F.col("_first"))
    # about both sides at once, so that the row of an empty result is kept and seen
    stays = F.when(F.col("_absent") > 0, F.raise_error(message).cast("boolean")).otherwise(F.col("_row").isNotNull())
    beside = chunks.withColumn("_row", F.lit(True)).join(F.broadcast(state), F.lit(True), "right")
    return beside.where(stays).select(*chunks.columns).orderBy(*order)


RUN_META = "current_epoch int, last_save_name string"


def run_steps(docs: DataFrame, text: str, schema: str = RUN_META) -> DataFrame:
    """Parsed metadata documents; unreadable ones give a NULL step."""
    meta = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return docs.select(*[c for c in docs.columns if c != text], meta.alias("meta"))


def read_run_catalogue(spark: SparkSession, path: str, schema: str = RUN_META) -> DataFrame:
    """One metadata file per run."""
    docs = spark.read.option("wholetext", True).text(path)
    return run_steps(docs.withColumn("file", F.input_file_name()), "value", schema)
