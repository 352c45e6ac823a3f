"""Grid puzzles: a predicted table of cells against the true one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import text as tx
from rolloom.functions.extract import json_answer

OBJECT = "map<string,string>"


def attribute_key(c: Column) -> Column:
    """Spelling-proof attribute name: letters and digits, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def cell_value(c: Column) -> Column:
    return F.lower(tx.strip(c))


def exact_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per puzzle: are all true cells predicted?

    ``gold`` has (puzzle, house, attr, val), ``pred`` also ``ord``, the order
    in which the reply names its attributes. A true attribute that the reply
    does not name takes the first named one that contains it or is contained.
    """
    keys = ["puzzle", "house"]
    # One row per named attribute: the place of its first mention, its last
    # value. This also bounds the second join by the number of names.
    named = (
        pred.select(*keys, attribute_key(F.col("attr")).alias("pk"), cell_value(F.col("val")).alias("pv"), "ord")
        .groupBy(*keys, "pk")
        .agg(F.max_by("pv", "ord").alias("pv"), F.min("ord").alias("ord"))
    )
    true = gold.select(*keys, attribute_key(F.col("attr")).alias("gk"), cell_value(F.col("val")).alias("gv"))
    # Equal cells of one house count once, with their number kept.
    true = true.groupBy(*keys, "gk", "gv").agg(F.count("*").alias("n"))
    exact = true.join(named.withColumnRenamed("pk", "gk"), [*keys, "gk"], "left").select(
        *keys, "gk", "gv", "n", "pv"
    )
    found = exact.filter(F.col("pv").isNotNull())
    missing = exact.filter(F.col("pv").isNull()).drop("pv")
    close = F.contains(F.col("pk"), F.col("gk")) | F.contains(F.col("gk"), F.col("pk"))
    partial = (
        missing.join(named, keys, "left")
        .groupBy(*keys, "gk", "gv", "n")
        .agg(F.min_by("pv", F.when(close, F.col("ord"))).alias("pv"))
    )
    return (
        found.unionByName(partial)
        .groupBy("puzzle")
        .agg(
            F.bool_and(F.coalesce(F.col("pv") == F.col("gv"), F.lit(False))).alias("solved"),
            F.sum("n").alias("cells"),
        )
    )


def answer_cells(replies: DataFrame, answer: str) -> DataFrame:
    """Cells named by a reply's JSON, in any of the accepted shapes.

    ``{"solution": {house: {...}}}``, the houses at the top level, or
    ``{"solution": [{...}, ...]}`` in house order. Adds ``house`` (its
    label), ``attr``, ``val`` and ``ord``.
    """
    rows = replies.select("*", F.explode(_houses(F.col(answer))).alias("h"))
    # the label without the word and its separators: "House 1", "house_1", "#1"
    bare = F.regexp_replace("h.key", rf"(?i)\A(?:house)?[{tx.SPACE}_#]*", "")
    label = F.coalesce(tx.first_match(bare, r"([0-9]+)"), bare)
    rows = rows.select("*", label.alias("house"), F.from_json("h.value", OBJECT).alias("cells"))
    return rows.select("*", F.posexplode("cells").alias("ord", "attr", "val")).drop("h", "cells")


def _houses(answer: Column) -> Column:
    """Names and contents of a reply's houses in their order; NULL if it has none."""
    top = F.from_json(answer, OBJECT)
    solution = F.try_element_at(top, F.lit("solution"))
    nested = F.from_json(solution, OBJECT)
    has_house = F.exists(F.map_keys(top), lambda k: F.contains(F.lower(k), F.lit("house")))
    listed = F.from_json(solution, "array<string>")
    by_place = F.transform(
        listed, lambda h, i: F.struct(F.concat(F.lit("House "), (i + 1).cast("string")).alias("key"), h.alias("value"))
    )
    is_list = F.startswith(F.ltrim(solution), F.lit("["))
    return (
        F.when(F.startswith(F.ltrim(solution), F.lit("{")), F.map_entries(nested))
        .when(has_house, F.map_entries(top))
        .when(is_list, by_place)
    )


# The names under which a reply may speak of a house.
HOUSE_NAMES = ["House {}", "house {}", "House{}", "house_{}", "{}", "#{}"]


def _house_named(houses: Column, label: Column) -> Column:
    """Contents of the house with a label: by its usual names, in their order.

    If none of them occurs, the first name that holds the label anywhere counts,
    as "Building 1" for the label 1.
    """

    def first(test) -> Column:
        fits = lambda h: test(h["key"]) & F.startswith(F.ltrim(h["value"]), F.lit("{"))
        return F.try_element_at(F.filter(houses, fits), F.lit(1))["value"]

    usual = [F.concat(*[label if part is None else F.lit(part) for part in _around(name)]) for name in HOUSE_NAMES]
    return F.coalesce(*[first(lambda key, u=u: key == u) for u in usual], first(lambda key: F.contains(key, label)))


def _around(name: str) -> list[str | None]:
    before, after = name.split("{}")
    return [p for p in (before, None, after) if p != ""]


def judged_replies(replies: DataFrame, gold: DataFrame, reply: str = "reply") -> DataFrame:
    """From the text of a reply to its verdict: ``puzzle, solved, cells``.

    ``replies`` has one row for each puzzle, ``gold`` the true cells ``(puzzle,
    house, attr, val)``. Every puzzle with true cells is judged; a reply without
    JSON, without houses or without one of the houses is wrong.
    """
    # replies are read in as few tasks as their files allow, parsed by all
    parsed = replies.repartition("puzzle").select("puzzle", _houses(json_answer(F.col(reply))).alias("houses"))
    wanted = gold.select("puzzle", "house").distinct().join(parsed, "puzzle")
    picked = wanted.select("puzzle", "house", F.from_json(_house_named(F.col("houses"), F.col("house")), OBJECT).alias("cells"))
    named = picked.select("puzzle", "house", F.posexplode("cells").alias("ord", "attr", "val"))
    return exact_match(gold, named)
