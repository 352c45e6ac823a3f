"""Hooks for a user's own templates, extractors, checkers and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Template = Callable[[dict[str, Column]], Column]
Extractor = Callable[[dict[str, Column]], Column]
Checker = Callable[[Column, Column], Column]


class Plugins:
    """Named builders. Each gets the row as Columns and returns a Column."""

    def __init__(self) -> None:
        self.templates: dict[str, Template] = {}
        self.extractors: dict[str, Extractor] = {}
        self.checkers: dict[str, Checker] = {}

    def register_template(self, name: str, build: Template) -> None:
        self.templates[name] = build

    def register_extractor(self, name: str, build: Extractor) -> None:
        self.extractors[name] = build

    def register_checker(self, name: str, build: Checker) -> None:
        self.checkers[name] = build

    def _choose(self, builders: dict, name: Column, call, default: Column) -> Column:
        out = default
        for key, build in builders.items():
            out = F.when(name == key, call(build)).otherwise(out)
        return out

    def prompt(self, rows: DataFrame, name: str, default: Column) -> Column:
        row = {c: F.col(c) for c in rows.columns}
        return self._choose(self.templates, F.col(name), lambda b: b(row), default)

    def answer(self, rows: DataFrame, name: str, default: Column) -> Column:
        row = {c: F.col(c) for c in rows.columns}
        return self._choose(self.extractors, F.col(name), lambda b: b(row), default)

    def verdict(self, name: Column, pred: Column, gold: Column) -> Column:
        """Unknown names, NULL and failing checkers are all wrong."""
        out = F.lit(False)
        for key, build in self.checkers.items():
            mine = name == key
            # a Python checker is worked out for all rows: others reach it as NULL
            out = F.when(mine, build(F.when(mine, pred), F.when(mine, gold))).otherwise(out)
        return F.coalesce(out, F.lit(False))


def python_checker(judge: Callable[[str, str], bool]) -> Checker:
    """A checker from a Python function, over Arrow batches.

    An exception makes that answer wrong and never fails the job. Rows without
    an answer, which are those of other checkers too, never reach the function.
    """

    @F.pandas_udf(T.BooleanType())
    def check(pred: pd.Series, gold: pd.Series) -> pd.Series:
        out = np.zeros(len(pred), bool)
        some = np.flatnonzero(pred.notna().to_numpy())
        out[some] = [_guarded(judge, p, g) for p, g in zip(pred.to_numpy()[some], gold.to_numpy()[some])]
        return pd.Series(out)

    return check


def _guarded(judge, pred, gold) -> bool:
    try:
        return bool(judge(pred, gold))
    except Exception:  # a scorer's failure is a wrong answer
        return False


def scored_by_frames(rows: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], name: str = "correct") -> DataFrame:
    """Judge whole Arrow batches with one call each, for a scorer of many rows.

    A batch that fails is judged again row by row, so an exception makes its own
    row wrong and no other. NULL verdicts are wrong.
    """

    def verdicts(batch: pd.DataFrame) -> np.ndarray:
        return np.asarray(pd.Series(judge(batch)).fillna(False), bool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = verdicts(batch)
            except Exception:  # some row's failure: find out which
                found = [_guarded(lambda r, _: verdicts(r)[0], batch.iloc[i : i + 1], None) for i in range(len(batch))]
            yield batch.assign(**{name: found})

    schema = T.StructType(rows.schema.fields + [T.StructField(name, T.BooleanType())])
    return rows.mapInPandas(run, schema)


def scored_in_batches(rows: DataFrame, judge: Callable[[dict], bool], name: str = "correct") -> DataFrame:
    """Judge whole rows with a Python function; executors are the pool."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = [_guarded(lambda r, _: judge(r), r, None) for r in batch.to_dict("records")]
            yield batch.assign(**{name: verdicts})

    schema = T.StructType(rows.schema.fields + [T.StructField(name, T.BooleanType())])
    return rows.mapInPandas(run, schema)


class ExpandRounds:
    """SQL face of round expansion: yields (round, target, noise) per row."""

    def eval(self, step_map: list[int], k: int, size: int):
        rounds = []
        for i, step in enumerate(step_map):
            block = step_map[i // size * size : (i // size + 1) * size]
            rounds.append(sum(s < step for s in set(block)) // k + 1)
        for t in range(1, max(rounds, default=0) + 1):
            yield t, [r == t for r in rounds], [r >= t for r in rounds]


def register_table_functions(spark: SparkSession) -> None:
    """Make ``expand_rounds(step_map, k, size)`` callable from SQL."""
    kind = "round int, target array<boolean>, noise array<boolean>"
    spark.udtf.register("expand_rounds", F.udtf(ExpandRounds, returnType=kind))
