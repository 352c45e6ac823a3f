"""Plugged-in tokenizers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rolloom.functions import tokens


def test_ids_leave_in_pieces(spark, monkeypatch):
    """A batch of much text is encoded piece by piece; each text stays whole."""
    texts = [None, "", "é漢", "a" * 300, *["word " * (i % 50) for i in range(200)], None]
    encode = lambda t: list(t.encode())
    as_bytes = tokens.tokenizer(encode)
    monkeypatch.setitem(as_bytes.func.__globals__, "HELD", 256)
    pieces = list(as_bytes.func(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series([None, None])])))
    assert len(pieces) > 20
    got = [x for p in pieces for x in p]
    assert [None if t is None else encode(t) for t in [*texts, None, None]] == [x if isinstance(x, list) else None for x in got]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", as_bytes(F.col("t")).alias("ids")).orderBy("i").collect()
    assert [r.ids for r in rows] == [None if t is None else encode(t) for t in texts]
