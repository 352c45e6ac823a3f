"""The two models of the log-probability rows."""

from __future__ import annotations

from rolloom.plans.base import Inputs


def test_the_second_model_is_the_next_vector(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 7), (2, [3.0, 4.0], 8), (3, [5.0, 6.0], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, Inputs(spark, str(tmp_path)).f_lp.collect()))
    assert got == [(7, 1, 0, 1.0, 3.0), (7, 1, 1, 2.0, 4.0), (8, 2, 0, 3.0, 5.0), (8, 2, 1, 4.0, 6.0), (9, 3, 0, 5.0, 1.0), (9, 3, 1, 6.0, 2.0)]
