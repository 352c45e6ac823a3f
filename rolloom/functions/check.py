"""Scoring predicates over extracted answers and recorded outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions import extract as ex
from rolloom.functions import latex
from rolloom.functions import text as tx


def same_letter(pred: Column, gold: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.upper(tx.strip_chars(tx.strip(c), "()"))

    return norm(pred) == norm(gold)


def plain_number(c: Column) -> Column:
    """Number text without separators, currency, lead-in or full stop."""
    out = tx.remove_all(c, [",", "$"])
    out = F.when(F.contains(out, F.lit("#### ")), tx.after_last(out, "#### ")).otherwise(out)
    return tx.strip(F.lower(F.regexp_replace(out, r"\.(\n?)\z", "$1")))


def same_number(pred: Column, gold: Column) -> Column:
    return plain_number(pred) == plain_number(gold)


def same_phrase(pred: Column, gold: Column) -> Column:
    def norm(c: Column) -> Column:
        return tx.strip_chars(F.lower(tx.strip(c)), "()")

    return norm(pred) == norm(gold)


def has_alias(pred: Column, golds: Column) -> Column:
    """Is one of the accepted answers part of the prediction?"""
    forms = F.transform(golds, lambda g: F.lower(ex.short_form(g)))
    pred = F.coalesce(pred, F.lit(""))
    return F.coalesce(
        F.exists(forms, lambda g: (F.length(g) > 0) & F.contains(pred, g)), F.lit(False)
    )


def same_tokens(out: Column, expected: Column) -> Column:
    """Recorded output against the expected one, blanks collapsed."""
    return tx.squeeze(out) == tx.squeeze(expected)


def same_stripped(out: Column, expected: Column) -> Column:
    empty = F.lit("")
    return tx.strip(F.coalesce(out, empty)) == tx.strip(F.coalesce(expected, empty))


def _integers(values: Column) -> Column:
    return F.forall(values, lambda v: F.regexp_like(tx.strip(v), F.lit(r"\A[+-]?[0-9]++(?:_[0-9]++)*+\z")))


def tolerant_output(out: Column, expected: Column, token_sets: bool = False) -> Column:
    """Ladder of ever more tolerant comparisons of two recorded outputs.

    Whole text, text with stripped lines, lines without blank ones, numbers
    within tolerance. ``token_sets`` adds equality of the sets of tokens per
    line, which is off by default: integers must then agree in order.
    """
    got = tx.split_lines(F.coalesce(out, F.lit("")))
    want = F.transform(F.filter(tx.lines(expected), lambda r: r != ""), tx.strip)
    sides = F.struct(
        got.alias("got"),
        F.filter(got, lambda r: r != "").alias("filled"),
        want.alias("want"),
        tx.strip(expected).alias("text"),
    )

    def close(a: Column, b: Column) -> Column:
        # |a - b| <= atol + rtol * |b|, and equal infinities
        near = F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)
        return F.coalesce((a == b) | near, F.lit(False))

    def token_rows(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.array_sort(F.array_distinct(tx.words(r))))

    def ladder(s: Column) -> Column:
        got, filled, want = s["got"], s["filled"], s["want"]
        whole = tx.strip(F.array_join(got, "\n")) == s["text"]
        by_line = tx.strip(F.array_join(F.transform(got, tx.strip), "\n")) == s["text"]
        numbers = F.forall(
            F.zip_with(
                F.transform(filled, latex.number_value), F.transform(want, latex.number_value), close
            ),
            lambda same: same,
        )
        numeric = (
            (F.size(filled) == F.size(want)) & ~(_integers(filled) & _integers(want)) & numbers
        )
        steps = whole | by_line | (got == want) | (filled == want) | numeric
        if token_sets:
            steps = steps | (token_rows(filled) == token_rows(want))
        return F.coalesce(steps, F.lit(False))

    return tx.let(sides, ladder)


def _canonical(json_text: Column) -> Column:
    return F.to_json(F.try_parse_json(tx.valid_json(json_text)))


def same_return(out_json: Column, expected_json: Column, any_first: bool = False) -> Column:
    """Recorded return value against the expected one, both as JSON.

    Tuples are lists in JSON already. An expected list of one element also
    accepts the bare element, if the recorded value is no list. With
    ``any_first``, the rule of recorded contest runs, the first element of any
    expected list is accepted. Numbers compare by value, objects by content
    whatever the order of their keys.
    """
    parsed = F.try_parse_json(expected_json)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    bare = ~F.coalesce(tx.valid_json(out_json), F.lit("")).rlike(r"^\s*\[")
    taken = F.size(items) >= 1 if any_first else (F.size(items) == 1) & bare
    first = F.when(taken, F.to_json(F.try_variant_get(parsed, "$[0]", "variant")))
    sides = F.struct(
        _canonical(out_json).alias("got"), _canonical(expected_json).alias("want"), first.alias("first")
    )

    def compare(s: Column) -> Column:
        number = s["got"].try_cast("double")
        return (
            F.coalesce(s["got"] == s["want"], F.lit(False))
            | F.coalesce(s["got"] == s["first"], F.lit(False))
            | F.coalesce(number == s["want"].try_cast("double"), F.lit(False))
            | F.coalesce(number == s["first"].try_cast("double"), F.lit(False))
        )

    return tx.let(sides, compare)


def above(score: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(score > threshold, F.lit(False))


def without_nulls(kwargs: Column) -> Column:
    """Drop the entries without a value from every keyword map."""
    return F.transform(
        kwargs, lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    )


# Meaning of the verdict codes.
ERROR_NAMES = {
    -1: "Compilation Error",
    -2: "Wrong Answer",
    -3: "Time Limit Exceeded",
    -4: "Runtime Error",
}


def error_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in ERROR_NAMES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def correct(
    pred: Column,
    golds: Column,
    domain: Column,
    recorded: Column | None = None,
    override: Column | None = None,
    scorer: Column | None = None,
    overrides: dict | None = None,
    scorers: dict | None = None,
) -> Column:
    """One checker per row: dataset override, then scorer, then domain.

    ``golds`` is an array (one entry for single answers). ``recorded`` is the
    verdict of runs made elsewhere (code, external scorers), used for domains
    whose answer cannot be judged from the text. Never NULL: an answer that
    cannot be judged is wrong.
    """
    gold = F.try_element_at(golds, F.lit(1))
    recorded = F.coalesce(recorded, F.lit(False)) if recorded is not None else F.lit(False)
    out = (
        F.when(domain == "mc", same_letter(pred, gold))
        .when(domain == "triviaqa", has_alias(pred, golds))
        .when(domain == "chat", F.lit(False))
        .when(
            domain.isin("code", "ifeval", "ifeval_oc", "livebench", "zebralogic", "autologi"),
            recorded,
        )
        .otherwise(latex.equivalent(pred, gold))
    )
    if scorer is not None:
        for (name, dom), fn in (scorers or {}).items():
            out = F.when((scorer == name) & (domain == dom), fn(pred, gold)).otherwise(out)
    if override is not None:
        for name, fn in (overrides or {}).items():
            out = F.when(override == name, fn(pred, gold)).otherwise(out)
    return F.coalesce(out, F.lit(False))
