"""Nested configuration documents as key/value rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(node, path: str) -> Iterator[tuple[str, str | None]]:
    items = node.items() if isinstance(node, dict) else enumerate(node)
    for key, value in items:
        name = f"{path}.{key}" if path else str(key)
        if isinstance(value, (dict, list)):
            yield from _leaves(value, name)
        else:
            text = value if isinstance(value, str) else None if value is None else json.dumps(value)
            yield name, text


def flattened(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """Dotted keys of the scalars in each JSON document, list items by number.

    Documents nest to any depth, so the walk is a small Python step over
    Arrow batches; documents stay whole and spread over tasks.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, name, value)
                for k, text in zip(batch[key], batch[doc])
                for name, value in _leaves(json.loads(text), "")
            ]
            yield pd.DataFrame(rows, columns=[key, "key", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, doc).mapInPandas(walk, f"{key} {kind}, key string, value string")


def layered(layers: DataFrame, run: str = "run") -> DataFrame:
    """The value of the strongest layer for every key of a run.

    ``layers`` has (run, priority, key, value); a higher priority wins.
    """
    return layers.groupBy(run, "key").agg(F.max_by("value", "priority").alias("value"))
