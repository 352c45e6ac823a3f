"""The registered query of each operator, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolloom.llm import (
    contamination,
    decisions,
    jaccard,
    lines,
    mixing,
    neighbours,
    periodic,
    pii,
    quality,
    radix,
    secrets,
    suffixes,
    toxicity,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op3_ownership_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op4_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_suffix_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.passages(table(spark, folder, "documents"))


def op7_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op8_hierarchical_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op9_fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resampled(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_radix_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return radix.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_report(table(spark, folder, "documents"), plant=True)


QUERIES = [
    op1_permutation_index,
    op2_ngram_jaccard_join,
    op3_ownership_secrets,
    op4_ftrl_toxicity,
    op5_benchmark_containment,
    op6_suffix_passages,
    op7_boosted_pii,
    op8_hierarchical_mixture,
    op9_fuzzy_line_dedup,
    op10_importance_resampling,
    op11_decision_list,
    op12_radix_resampling,
    op13_periodic_runs,
]
ORACLES = {"op5_benchmark_containment": contamination.SQL, "op8_hierarchical_mixture": mixing.SQL, "op12_radix_resampling": radix.SQL}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
