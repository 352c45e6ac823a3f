"""Recorded test verdicts: joins, error reports and code metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import text as tx


def attach_status(candidates: DataFrame, status: DataFrame) -> DataFrame:
    """Status rows of an external evaluation; a missing row is a failure."""
    keys = ["task_id", "resp_idx"]
    known = status.select(*keys, "base_status", "plus_status", F.lit(True).alias("known"))
    base = F.coalesce(F.col("base_status") == "pass", F.lit(False))
    plus = F.coalesce(F.col("plus_status") == "pass", F.lit(False))
    return candidates.join(known, keys, "left").select(
        *keys,
        base.alias("base_pass"),
        plus.alias("plus_pass"),
        F.when(F.col("known").isNull(), "missing").when(base, "pass").otherwise("fail").alias("result"),
    )


def error_report(rows: DataFrame, code: str, detail: str) -> DataFrame:
    """Name of the error, and its detail cut in the middle for display."""
    return rows.select(
        "*",
        ck.error_name(F.col(code)).alias("error"),
        tx.middle_truncate(F.col(detail), 300).alias("shown"),
        tx.middle_truncate(F.col(detail), 200).alias("output"),
    )


def cross_tests(candidates: DataFrame, tests: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every candidate of a problem with every test of that problem."""
    return candidates.join(tests, key)


def per_candidate(verdicts: DataFrame) -> DataFrame:
    """Passed tests and overall verdict of each candidate.

    A verdict that was never recorded counts as a failed test. The partial
    aggregation runs before the shuffle, so a hot problem costs one row per
    task and candidate.
    """
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return verdicts.groupBy("sample_id", "resp_idx").agg(
        F.count_if(passed).alias("n_passed"),
        F.count("*").alias("n_tests"),
        F.bool_and(passed).alias("solved"),
    )


def per_problem(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if("solved").alias("c")
    )


def pass_at(n: Column, c: Column, k: int, scale: float = 100.0) -> Column:
    """Unbiased chance that one of k draws without repetition is correct.

    The product runs over the k draws, not over the correct samples, so its
    length does not grow with the number of samples.
    """
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, j: acc * (F.lit(1.0) - c / F.when(n > j, n - j)),
    )
    return F.when(n - c < k, F.lit(scale)).otherwise(scale * (F.lit(1.0) - miss))


def pass_at_table(problems: DataFrame, ks: list[int], scale: float = 100.0) -> DataFrame:
    """Mean pass@k for each k that every problem has enough samples for."""
    columns = [F.min("n").alias("least")]
    columns += [F.avg(pass_at(F.col("n"), F.col("c"), k, scale)).alias(f"k{k}") for k in ks]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("value")) for k in ks])
    return (
        problems.agg(*columns)
        .select("least", F.explode(entries).alias("e"))
        .filter(F.col("least") >= F.col("e.k"))
        .select("e.k", "e.value")
    )


def first_candidate_by_platform(verdicts: DataFrame) -> DataFrame:
    """Accuracy in percent of the first candidate of each problem."""
    first = (
        verdicts.filter(F.col("resp_idx") == 0)
        .groupBy("sample_id")
        .agg(F.min("platform").alias("platform"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("solved"))
    )
    return first.groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform")).agg(
        F.count_if("solved").alias("solved"),
        F.count("*").alias("n"),
        (100 * F.count_if("solved") / F.count("*")).alias("accuracy"),
    )


def first_recorded_pair(items: DataFrame, order: str) -> DataFrame:
    """The first recorded base and plus shares, as they were reported.

    ``recorded`` is a struct of both; items without one are passed over. One
    row, or none if no item has a pair.
    """
    some = items.where(F.col("recorded").isNotNull()).agg(F.min_by("recorded", order).alias("r"))
    return some.where("r IS NOT NULL").select("r.base", "r.plus")


def base_plus_summary(candidates: DataFrame) -> DataFrame:
    """Share of candidates that pass the base and the extended tests."""
    return candidates.agg(
        F.avg(F.col("base_pass").cast("int")).alias("base"), F.avg(F.col("plus_pass").cast("int")).alias("plus")
    )
