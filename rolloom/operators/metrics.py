"""Metrics read from logs, run catalogues and worker counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import text as tx
from rolloom.operators.ordered import last_seen

RESULT = r"\Atrain step: ([0-9]+)"
HEADER = r"\A  Dataset: *"


def header_name(line: Column) -> Column:
    """Dataset named by a header line, NULL for other lines."""
    bare = F.regexp_replace(F.regexp_replace(line, HEADER, ""), r" +\([^\n]*\z", "")
    return F.when(F.startswith(line, F.lit("  Dataset:")), bare)


def metric_value(line: Column, name: str) -> Column:
    """Value of ``name: value`` among fields two blanks apart."""
    return tx.first_match(line, rf"(?:\A|  ){name}: *([0-9.]+)").try_cast("double")


def paired_results(log: DataFrame, result: str = "train step: 1") -> DataFrame:
    """First result line after each header, with the header's dataset.

    ``log`` has (shard, line_no, line). Lines that start with ``result`` are
    result lines; all others than these and the headers are passed over.
    Result lines without a header of their own are dropped, headers without a
    result too.
    """
    is_header = F.startswith("line", F.lit("  Dataset:"))
    is_result = F.startswith("line", F.lit(result))
    here = F.when(is_header, F.struct(F.col("line_no").alias("at"), header_name(F.col("line")).alias("dataset")))
    marked = last_seen(log.filter(is_header | is_result), ["shard"], "line_no", here, "header")
    results = marked.filter(is_result & F.col("header").isNotNull())
    first = results.groupBy("shard", F.col("header.at").alias("at")).agg(
        F.min_by(F.struct("line_no", "line", "header.dataset"), "line_no").alias("r")
    )
    line = F.col("r.line")
    return first.select(
        "shard",
        F.col("r.line_no").alias("line_no"),
        F.col("r.dataset").alias("dataset"),
        tx.first_match(line, RESULT).cast("int").alias("step"),
        metric_value(line, "acc").alias("acc"),
        metric_value(line, "avg length").alias("avg_len"),
        metric_value(line, "avg tok/step").alias("tok_per_step"),
    )


def best_accuracy(results: DataFrame, step: int) -> DataFrame:
    """Best accuracy of each dataset at a step, then the mean over datasets."""
    best = results.filter(F.col("step") == step).groupBy("dataset").agg(F.max("acc").alias("acc"))
    return best.agg(F.avg("acc").alias("mean_best"), F.count("*").alias("datasets"))


def fixed(c: Column, places: int) -> Column:
    """Plain decimal text with the given number of places."""
    return F.format_string(f"%.{places}f", c)


def results_table(results: DataFrame) -> DataFrame:
    """One line per result: dataset, accuracy, length and tokens per step as text."""
    return results.select(
        "dataset",
        fixed(F.col("acc"), 4).alias("acc"),
        fixed(F.col("avg_len"), 1).alias("avg_len"),
        fixed(F.col("tok_per_step"), 3).alias("tok_per_step"),
    )


def valid_checkpoint(has_config: Column, has_weights: Column, has_adapter: Column) -> Column:
    return has_config & (has_weights | has_adapter)


def latest_run(runs: DataFrame, group: str | None = None, prefix: str | None = None) -> DataFrame:
    """Most recently saved run with a readable step, per group."""
    known = runs.filter(F.col("current_epoch").isNotNull())
    if prefix:
        known = known.filter(F.startswith("run", F.lit(prefix)))
    newest = F.max_by(F.struct("run", "current_epoch"), "mtime").alias("r")
    grouped = known.groupBy(group) if group else known.groupBy()
    picked = grouped.agg(newest)
    keys = [group] if group else []
    return picked.select(*keys, F.col("r.run").alias("run"), F.col("r.current_epoch").alias("step"))


def resume_plan(runs: DataFrame) -> DataFrame:
    """Resume only runs with a readable step and a usable checkpoint."""
    usable = F.col("current_epoch").isNotNull() & valid_checkpoint(
        F.col("has_config"), F.col("has_weights"), F.col("has_adapter")
    )
    usable = F.coalesce(usable, F.lit(False))
    return runs.select("run", usable.alias("resume"), F.when(usable, F.col("current_epoch") + 1).alias("next_step"))


def tenths(part: Column, whole: Column) -> Column:
    """Share in tenths from whole counts, halves to the even tenth.

    Binning the counts avoids rounding a binary fraction that only looks like
    a tie.
    """
    return F.bround(part * F.lit(10) / F.greatest(whole, F.lit(1)), 0).cast("int")


def loss_by_masked_share(rows: DataFrame, loss: str, masked: str, total: str) -> DataFrame:
    """Mean loss and number of rows per tenth of masked response tokens."""
    return rows.groupBy(tenths(F.col(masked), F.col(total)).alias("tenth")).agg(
        F.avg(loss).alias("loss"), F.count("*").alias("n")
    )


def weighted_means(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Means over workers: sums of value times weight over sums of weight."""
    return rows.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias("mean"),
        F.sum(weight).alias("count"),
    )


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)
