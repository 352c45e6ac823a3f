"""Rewards per prompt, difficulty filter and accuracy roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.session import work_dir

MARGIN = 5  # fixed value: tokens below the cap that still count as cut off


def capped(correct: Column, n_tokens: Column, cap: Column) -> Column:
    """Wrong if the response ran into the token cap.

    A NULL or non-positive cap means no cap.
    """
    hit = (cap > 0) & (n_tokens >= cap - MARGIN)
    return correct & ~F.coalesce(hit, F.lit(False))


def narrowed(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Keys and verdicts alone, worked out once and written to the shared folder.

    Statistics of a key are joined back to its rows, so these are read twice.
    Where a verdict comes from a long text, that text would be read and searched
    twice as well; from here on only the narrow rows are.
    """
    narrow = rows.select(*columns)
    path = work_dir(rows.sparkSession, "narrow")
    narrow.write.parquet(path)
    return rows.sparkSession.read.schema(narrow.schema).parquet(path)


def z_scored(rows: DataFrame, key: str, value: str, name: str = "reward") -> DataFrame:
    """Value minus the key's mean, over its population deviation; 0 if constant.

    Mean and deviation are partial aggregates joined back, not a window: a
    key with very many rows is reduced before the shuffle, and the join back
    can be split by adaptive execution.
    """
    v = F.col(value).cast("double")
    stats = rows.groupBy(key).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    score = F.coalesce((v - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(0.0))
    return rows.join(stats, key).withColumn(name, score).drop("_mean", "_sd")


def solved_share(rows: DataFrame, key: str, correct: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(F.col(correct).cast("int")).alias("share"), F.count("*").alias("n"))


def by_difficulty(rows: DataFrame, key: str, correct: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Rows of prompts whose share of correct responses lies in the bounds."""
    kept = solved_share(rows, key, correct).filter(F.col("share").between(low, high)).select(key)
    return rows.join(kept, key, "left_semi")


def difficulty_report(rows: DataFrame, key: str, correct: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Kept and total number of prompts, and of responses kept."""
    inside = F.col("share").between(low, high)
    return solved_share(rows, key, correct).agg(
        F.count_if(inside).alias("kept"),
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("samples"),
    )


def training_records(rows: DataFrame) -> DataFrame:
    """The columns a training job reads."""
    return rows.select("sample_id", "resp_idx", "prompt", "question", "reward", "response", "step_map")


def accuracy(rows: DataFrame, correct: str = "correct", scorable: str = "scorable") -> DataFrame:
    """Accuracy over scorable rows: overall, by domain, category, subdivision.

    One pass with grouping sets. Subdivisions appear only if there are at
    least two. Result: (level, label, n_correct, n, accuracy).
    """
    sets = ["domain", "category", "subdivision"]
    used = rows.filter(scorable)
    grouped = used.groupingSets([[], *[[c] for c in sets]], *sets).agg(
        F.grouping_id().alias("_gid"), F.count_if(correct).alias("n_correct"), F.count("*").alias("n")
    )
    # grouping_id has one bit per column, set where it is aggregated away
    level = (
        F.when(F.col("_gid") == 0b111, "all")
        .when(F.col("_gid") == 0b011, "domain")
        .when(F.col("_gid") == 0b101, "category")
        .otherwise("subdivision")
    )
    label = F.coalesce(*sets)
    # The data is aggregated by now: this window sees one row per label.
    labels = F.count("label").over(Window.partitionBy("level"))
    return (
        grouped.select(
            level.alias("level"),
            label.alias("label"),
            "n_correct",
            "n",
            (F.col("n_correct") / F.greatest("n", F.lit(1))).alias("accuracy"),
        )
        .withColumn("_labels", labels)
        .filter((F.col("level") == "all") | F.col("label").isNotNull())
        .filter((F.col("level") != "subdivision") | (F.col("_labels") > 1))
        .drop("_labels")
    )


def length_report(rows: DataFrame, n_tokens: str = "n_tokens", scorable: str = "scorable") -> DataFrame:
    return rows.agg(
        F.avg(n_tokens).alias("mean_length"),
        (F.count_if(scorable) / F.greatest(F.count("*"), F.lit(1))).alias("scorable_share"),
    )


def tokens_per_step(rows: DataFrame, step_map: str = "step_map") -> DataFrame:
    """Mean over responses of length by number of distinct steps."""
    size = F.size(step_map)
    return rows.filter(size > 0).agg(
        F.coalesce(F.avg(size / F.size(F.array_distinct(step_map))), F.lit(0.0)).alias("tokens_per_step")
    )


def reward_report(rows: DataFrame, reward: str = "reward") -> DataFrame:
    return rows.agg(
        F.avg(reward).alias("mean"),
        F.min(reward).alias("least"),
        F.max(reward).alias("most"),
        F.stddev_pop(reward).alias("deviation"),
    )
