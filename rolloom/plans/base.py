"""Registry of named queries, their inputs and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolloom.plans.fixtures import FIXTURES
from rolloom.session import ship

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Schemas already read from file footers, by path.
_SCHEMAS: dict = {}


class Inputs:
    """Tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            raise AttributeError(name)
        return self.sql(FIXTURES[name][0])

    def documents(self) -> DataFrame:
        return self.table("documents")


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``.

    ``oracle`` is the equivalent SQL; fixture names in it become common table
    expressions.
    """

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = with_fixtures(oracle)
        return fn

    return add


def with_fixtures(text: str) -> str:
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", text)]
    if not used:
        return text.strip()
    head = ",\n".join(f"{n} AS ({FIXTURES[n][1].strip()})" for n in used)
    body = text.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Inputs(spark, folder))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
