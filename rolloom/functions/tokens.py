"""Pluggable tokenizer and token counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.functions import text as tx

# Characters of the texts whose ids a worker holds at once; a text stays whole.
HELD = 1 << 18


def tokenizer(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A Column function from any ``encode(text) -> ids``.

    The encoder is shipped to the executors with the function; texts arrive
    there in Arrow batches. Ids leave a worker in pieces of about ``HELD``
    characters of text, however much text a batch has.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ends = np.cumsum([len(t) if isinstance(t, str) else 1 for t in texts])
            cuts = np.flatnonzero(np.diff(ends // HELD)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
                yield texts.iloc[first:last].map(encode, na_action="ignore")

    return encoded


def split_words(c: Column) -> Column:
    """Default tokens: words between ASCII blanks."""
    return F.filter(F.split(c, "[ \\t\\n\\x0b\\f\\r]+", -1), lambda w: w != "")


def token_length(c: Column, pad: str, count: Callable[[Column], Column] | None = None) -> Column:
    """Number of tokens once the pad token's text is removed."""
    clean = tx.remove_all(c, [pad])
    return count(clean) if count else F.size(split_words(clean))
