"""Equivalence of short mathematical answers written in LaTeX."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.functions import text as tx

# Rewrites and removals of the published normal form for
# quantitative reasoning answers. Their order matters.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""),
    ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units",
    "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Plain removals and rewrites of the strict comparison form.
STRICT_REWRITES = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
    ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""),
    ("\\$", ""), ("$", ""), (",", ""),
]


def normal_form(c: Column) -> Column:
    """Normal form of a final answer: units, wrappers and shorthand removed."""
    out = tx.remove_all(tx.replace_all(c, SUBSTITUTIONS), REMOVED)
    out = tx.sub_all(
        out,
        [
            # a line with two dollar signs keeps what stands between them
            (r"(?md)^[^\n$]*+\$([^\n$]*+)\$[^\n]*+", r"\$$1\$"),
            (r"\\text\{([^\n}]*+)\}", "$1"),
            (r"\\textbf\{([^\n}]*+)\}", "$1"),
            (r"\\overline\{([^\n}]*+)\}", "$1"),
            (r"\\boxed\{([^\n]*)\}", "$1"),
            (r"frac([^{])([^\n])", "frac{$1}{$2}"),
            (r"sqrt([^{])", "sqrt{$1}"),
        ],
    )

    def joined(t: Column) -> Column:
        digits = F.replace(t, F.lit(","), F.lit(""))
        return F.when(F.regexp_like(digits, F.lit(r"\A\p{Nd}+\z")), digits).otherwise(t)

    return tx.let(F.replace(out, F.lit("$"), F.lit("")), joined)


def strict_form(c: Column) -> Column:
    """Form compared by ``equivalent``; NULL where the rewrite has no answer."""
    s = tx.let(F.split(tx.replace_all(c, STRICT_REWRITES), r"\\text\{ ", -1), _without_unit)
    s = tx.replace_all(s, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    s = F.regexp_replace(s, r"\A\.", "0.")
    s = tx.let(s, _right_side)
    s = tx.let(F.split(s, r"\\sqrt", -1), _braced_roots)
    s = F.replace(s, F.lit(" "), F.lit(""))
    s = tx.let(F.split(s, r"\\frac", -1), _braced_fractions)
    s = F.regexp_replace(s, r"\A0\.5\z", r"\\frac{1}{2}")
    number = r"(0|-?[1-9][0-9]*)"
    return F.regexp_replace(s, rf"\A{number}/{number}\z", r"\\frac{$1}{$2}")


def _without_unit(parts: Column) -> Column:
    """A unit is allowed once, at the right; more have no answer."""
    return F.when(F.size(parts) <= 2, parts[0])


def _right_side(s: Column) -> Column:
    """``x=5`` counts as ``5``; longer left sides stay."""
    sides = F.split(s, "=", -1)
    named = (F.size(sides) == 2) & (F.length(sides[0]) <= 2)
    return F.when(named, F.try_element_at(sides, F.lit(2))).otherwise(s)


def _rest(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _braced_roots(parts: Column) -> Column:
    rest = F.transform(_rest(parts), lambda p: F.regexp_replace(p, r"(?s)\A([^{])", "{$1}"))
    fixed = F.array_join(F.concat(F.slice(parts, 1, 1), rest), "\\sqrt")
    return F.when(~F.exists(_rest(parts), lambda p: p == ""), fixed)


def _braced_fractions(parts: Column) -> Column:
    tails = _rest(parts)
    rest = F.transform(
        tails,
        lambda p: tx.sub_all(
            p, [(r"(?s)\A([^{])([^{])", "{$1}{$2}"), (r"(?s)\A([^{])\{", "{$1}{")]
        ),
    )
    lone = F.exists(tails, lambda p: (F.length(p) == 1) & (p != "{"))
    unchanged = F.array_join(parts, "\\frac")
    fixed = F.array_join(F.concat(F.slice(parts, 1, 1), rest), "\\frac")
    return F.when(
        ~F.exists(tails, lambda p: p == ""), F.when(lone, unchanged).otherwise(fixed)
    )


def number_value(c: Column) -> Column:
    """The value of text that reads as a float, else NULL."""
    plain = tx.strip(c)
    # possessive, so that long digits that do not end in a number fail at once
    digits = r"[0-9]++(?:_[0-9]++)*+"
    shape = rf"\A[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?\z"
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(F.regexp_like(plain, F.lit(shape)), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
        .when(F.regexp_like(plain, F.lit(r"(?i)\A[+-]?inf(?:inity)?\z")), sign)
        .when(F.regexp_like(plain, F.lit(r"(?i)\A[+-]?nan\z")), F.lit(float("nan")))
    )


def equivalent(a: Column, b: Column) -> Column:
    """Are two answers the same number, or the same text after rewriting?

    Two missing answers are equal; a missing and a present one are not.
    """
    # One lambda serves both sides, which halves the expression.
    given = F.array(a, b)
    forms = F.transform(given, strict_form)

    def with_values(form: Column) -> Column:
        return F.struct(form.alias("text"), number_value(form).alias("value"))

    def compare(sides: Column) -> Column:
        x, y = sides[0], sides[1]
        numbers = x["value"].isNotNull() & y["value"].isNotNull()
        same = (
            F.when(x["text"].isNull() | y["text"].isNull(), a == b)
            .when(numbers, (x["value"] == y["value"]) & ~F.isnan(x["value"]))
            .otherwise(x["text"] == y["text"])
        )
        return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(same, F.lit(False)))

    return tx.let(F.transform(forms, with_values), compare)


# --- degenerate text ---------------------------------------------------------
def repeat_score(s: str) -> float:
    """Sum of common prefixes of neighbouring suffixes, over n(n+1)/2.

    Prefix doubling orders the suffixes and leaves one table per power of two
    that tells which substrings of that length are equal. The common prefix
    of two suffixes is then read off the tables, longest length first. Short
    lengths are packed into integers; longer ones are only worked out for
    suffixes that still share a prefix with another.
    """
    n = len(s)
    if n <= 1:
        return 0.0
    codes = np.unique(np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)[1]
    tables, order = _substring_tables(codes.astype(np.int64) + 1)
    left, right = order[:-1].copy(), order[1:].copy()
    total = 0
    for level in range(len(tables) - 1, -1, -1):
        step, table = 1 << level, tables[level]
        fits = (left + step <= n) & (right + step <= n)
        same = fits & (table[np.minimum(left, n - 1)] == table[np.minimum(right, n - 1)])
        total += int(same.sum()) * step
        left[same] += step
        right[same] += step
    return total * 2 / (n * (n + 1))


def _ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Values ``width`` places further on, 0 behind the end."""
    out = np.zeros_like(values)
    if width < len(values):
        out[:-width] = values[width:]
    return out


def _substring_tables(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of equal substrings of length 1, 2, 4, ... and the suffix order."""
    n, bits = len(codes), int(codes.max()).bit_length()
    tables, width = [codes], 1
    while 2 * width * bits <= 62 and width < n:
        cur = tables[-1]
        tables.append((cur << (width * bits)) | _ahead(cur, width))
        width *= 2
    order = np.argsort(tables[-1], kind="stable")
    starts = _group_starts(tables[-1][order], np.arange(n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts
    while width < n:
        # slots of the order whose suffix equals a neighbour so far
        tied = np.zeros(n, dtype=bool)
        repeat = starts[1:] == starts[:-1]
        tied[1:] |= repeat
        tied[:-1] |= repeat
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        who = order[slots]
        # rank of the part behind, 0 if the suffix ends there
        behind = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        key = rank[who] * (n + 2) + behind
        sort = np.argsort(key, kind="stable")
        order[slots] = who[sort]
        starts[slots] = _group_starts(key[sort], slots)
        rank = rank.copy()
        rank[order[slots]] = starts[slots]
        tables.append(rank)
        width *= 2
    return tables, order


def _group_starts(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For sorted keys, the slot at which each one's run of equals begins."""
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return slots[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]


@F.pandas_udf(T.DoubleType())
def repetition(texts: pd.Series) -> pd.Series:
    return texts.map(repeat_score, na_action="ignore")


def flagged(score: Column, length: Column, min_length: int = 128, share: float = 0.2) -> Column:
    """Long texts made of repeats; short ones never count."""
    return F.coalesce((length > min_length) & (score > share), F.lit(False))


def degenerate(c: Column, min_length: int = 128, share: float = 0.2) -> Column:
    """``flagged`` by a score that is worked out for long texts only."""
    return flagged(repetition(F.when(F.length(c) > min_length, c)), F.length(c), min_length, share)
