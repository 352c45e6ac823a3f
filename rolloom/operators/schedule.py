"""Sampling, partition assignment, ledgers and step schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.hashing import FAST, Draws
from rolloom.operators.ordered import positions, running_sums


# --- order of prompts --------------------------------------------------------
def epoch_chunks(
    rows: DataFrame, key: str, chunk: int, epochs: int, seed: int, draws: Draws = FAST
) -> DataFrame:
    """Shuffled passes over the prompts, cut into steps of ``chunk``.

    The orders of all epochs are one sequence: a step that reaches the end of
    an epoch is filled up from the reshuffled next one. There are
    ``ceil(n / chunk) * epochs`` steps, so the last may draw on one or more
    further epochs. Adds epoch, position and step, all from 1.
    """
    n = rows.agg(F.count("*").alias("n")).scalar()
    steps = (F.ceil(n / chunk) * epochs).cast("bigint")
    passes = F.greatest(F.ceil(steps * chunk / n), F.lit(1)).cast("int")
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), passes)))
    each = each.withColumn("_h", draws.order(seed, F.col("epoch"), F.col(key)))
    placed = positions(each, ["epoch", "_h", key], "_i")
    position = F.col("_i")
    out = placed.withColumn("position", position + 1).withColumn(
        "step", (F.floor(position / chunk) + 1).cast("bigint")
    )
    return out.filter(F.col("step") <= steps).drop("_i", "_h")


def sample(rows: DataFrame, key: str, k: int, seed: int, step: int = 0, draws: Draws = FAST) -> DataFrame:
    """k rows without replacement (all if there are fewer), by hashed order."""
    return rows.orderBy(draws.order(f"{seed}:{step}", F.col(key)), key).limit(k)


# --- assignment --------------------------------------------------------------
def ceil_chunk(index: Column, n: Column, parts: int) -> Column:
    """Contiguous chunks of ``ceil(n / parts)``; the last may be short."""
    size = F.ceil(n / parts)
    return F.floor(index / F.greatest(size, F.lit(1))).cast("int")


def balanced_chunk(index: Column, n: Column, parts: int) -> Column:
    """Chunk c holds the positions from ``n*c // parts`` on."""
    # the largest c with floor(n*c / parts) <= index
    return F.floor(((index + 1) * parts - 1) / n).cast("int")


def front_loaded_chunk(index: Column, n: Column, parts: int) -> Column:
    """The first ``n % parts`` chunks hold one position more."""
    size, extra = F.floor(n / parts), n % parts
    head = extra * (size + 1)
    return (
        F.when(index < head, F.floor(index / (size + 1)))
        .otherwise(extra + F.floor((index - head) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def strided(index: Column, world: int) -> Column:
    return F.pmod(index, F.lit(world)).cast("int")


# --- ledgers -----------------------------------------------------------------
def step_totals(ledger: DataFrame, values: list[str]) -> DataFrame:
    """Counters of all workers added up per run and step."""
    return ledger.groupBy("run", "step").agg(*[F.sum(v).alias(v) for v in values])


def cumulative(totals: DataFrame, values: list[str]) -> DataFrame:
    """Adds ``total_<value>``: the sum up to and including the step."""
    sums = running_sums(totals, ["run"], "step", values)
    return sums.select(
        *totals.columns, *[(F.col(v) + F.col(f"{v}_before")).alias(f"total_{v}") for v in values]
    )


def compute_ledger(
    totals: DataFrame, student: float, teacher: float, divisor: float = 1e18
) -> DataFrame:
    """Floating-point work from cumulative tokens: 6PT to train, 2PT forward.

    ``divisor`` scales the unit; the default keeps the customary figures.
    """
    loss, rollout = F.col("total_loss_tokens"), F.col("total_rollout_tokens")
    train = 6 * F.lit(student) * loss / F.lit(divisor)
    watch = 2 * F.lit(teacher) * loss / F.lit(divisor)
    return totals.select(
        "*",
        train.alias("student_work"),
        watch.alias("teacher_work"),
        (2 * F.lit(student) * rollout / F.lit(divisor)).alias("rollout_work"),
        (train + watch).alias("total_work"),
    )


# --- schedules ---------------------------------------------------------------
def _shape(progress: Column, kind: str) -> Column:
    if kind == "linear":
        return progress
    if kind == "sin":
        return F.sin(F.lit(math.pi / 2) * progress)
    if kind == "cos":
        return 1.0 - F.cos(F.lit(math.pi / 2) * progress)
    raise ValueError(f"unknown schedule type: {kind}")


def scheduled_budget(step: Column, start: float, end: float, ramp: int, kind: str = "sin", block: int = 4) -> Column:
    """Token budget of a step, ramped and rounded to whole blocks."""
    progress = F.least(step / ramp, F.lit(1.0))
    value = start + (end - start) * _shape(progress, kind)
    blocks = F.bround(value / block, 0) * block
    return F.greatest(blocks.cast("int"), F.lit(block))


def scheduled_threshold(
    step: Column, start: float, end: float, hold: int, ramp: int | None, total: int | None = None, kind: str = "linear"
) -> Column:
    """Threshold of a step: held, ramped, then constant.

    Without ``ramp`` it runs from the end of the hold to the last step.
    """
    if ramp is None or ramp <= 0:
        if total is None or total <= hold:
            raise ValueError("an automatic ramp needs a total step count above the hold")
        ramp = total - hold
    progress = F.least((step - hold) / ramp, F.lit(1.0))
    moved = start + (end - start) * _shape(progress, kind)
    return F.when(step <= hold, F.lit(float(start))).otherwise(moved)


def schedule_table(steps: DataFrame, budget, threshold=None) -> DataFrame:
    """One row for each step: its token budget and, if asked for, its threshold.

    ``steps`` holds the steps in any number of rows; both settings are functions
    of the step, so the table is as long as the run has steps.
    """
    step = F.col("step")
    columns = [budget(step).cast("int").alias("budget")]
    if threshold is not None:
        columns.append(threshold(step).alias("threshold"))
    return steps.select("step").where("step IS NOT NULL").distinct().select("step", *columns)


def at_step(facts: DataFrame, table: DataFrame) -> DataFrame:
    """Facts with the settings of their step; a step without any has NULLs.

    The table is broadcast if it is small, by Spark's own measure. A NULL budget
    is no cap, as everywhere.
    """
    return facts.join(table, "step", "left")


def changes(rows: DataFrame, schedule, name: str) -> DataFrame:
    """Rows at whose step ``schedule(step)`` differs from the step before.

    A schedule is a function of the step, so both values come from one row.
    """
    step = F.col("step")
    return rows.select("run", "step", schedule(step).alias(name)).filter(schedule(step) != schedule(step - 1))
