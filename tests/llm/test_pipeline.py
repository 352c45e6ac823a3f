"""The pipeline stage by stage on the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
from rolloom.llm import queries
from rolloom.llm.common import stage


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, data), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    name, step = corpus_pipeline.STAGES[-1]
    mixed = step(spark, docs, data)
    assert mixed.join(docs, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, data).exceptAll(mixed).count() == 0


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_line_dedup_of_larger_tables(spark):
    """More than 2^20 pairs of lines by their lengths: near copies that share no word still go."""
    r, rows = random.Random(21), []
    for i in range(1700):
        words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(4, 7))) for _ in range(10)]
        rows.append(" ".join(words))
        if i < 20:
            rows.append(" ".join(w[:2] + "z" + w[3:] for w in words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    left = {d.doc_id for d in corpus_pipeline.dedup_lines(spark, docs, "").collect() if d.text}
    assert left == set(range(0, 40, 2)) | set(range(40, len(rows)))
