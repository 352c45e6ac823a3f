"""Scoring against literals and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import latex
from rolloom.operators import repeats

AB = "a string, b string"
A, B = F.col("a"), F.col("b")


def test_letters_numbers_phrases(apply):
    assert apply(ck.same_letter(A, B), [(" (b) ", "B"), ("A", "b")], AB) == [True, False]
    rows = [("$1,234.", "x\n#### 1234"), ("5", "5.0"), ("a.", "A")]
    assert apply(ck.same_number(A, B), rows, AB) == [True, False, True]
    assert apply(ck.same_phrase(A, B), [(" (Yes) ", "yes"), ("no", "yes")], AB) == [True, False]


def test_aliases(apply):
    golds = F.split(B, "\\|")
    rows = [("town of york", "Leeds|The York"), ("york", "...|"), ("", "x"), (None, "x")]
    assert apply(ck.has_alias(A, golds), rows, AB) == [True, False, False, False]


EQUAL = [
    ("0.5", "\\frac{1}{2}"), ("\\frac12", "\\frac{1}{2}"), ("1/2", "\\frac{1}{2}"), ("x=5", "5"),
    ("1,000", "1000"), ("50\\%", "50"), ("\\sqrt3", "\\sqrt{3}"), ("5\\text{ cm}", "5"), (None, None),
    ("\\tfrac{1}{2}", "\\dfrac12"), ("\\left( 1, 2 \\right)", "(1,2)"), (".25", "0.250"), ("1e3", "1000"),
    ("\\frac1{72}", "\\frac{1}{72}"), ("90^\\circ", "90"), ("inf", "Infinity"), ("\\frac", "\\frac"),
]
DIFFERENT = [
    (None, "1"), ("1", None), ("01/2", "\\frac{01}{2}"), ("nan", "nan"), ("abc=5", "5"), ("\\sqrt", "x"),
    ("a\\text{ b}\\text{ c}", "a"), ("-0/2", "\\frac{-0}{2}"), ("1d", "1"), (".5", "0.50"),
]


def test_equivalent(apply):
    got = apply(latex.equivalent(A, B), EQUAL + DIFFERENT, AB)
    assert got == [True] * len(EQUAL) + [False] * len(DIFFERENT)


def test_normal_form(apply):
    cases = {
        "the $1,000$ dollars": "1000",
        "\\text{yes}": "yes",
        "\\boxed{7} units": "7",
        "\\frac12": "\\frac{1}{2}",
        "sqrt2x": "sqrt{2}x",
        "\\textbf{b}\\overline{c}": "bc",
        "an answer": "answer",
    }
    assert apply(latex.normal_form(A), [(k, "") for k in cases], AB) == list(cases.values())


def brute_repeat(s: str) -> float:
    n = len(s)
    suffixes = sorted(s[i:] for i in range(n))
    total = 0
    for x, y in zip(suffixes, suffixes[1:]):
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        total += k
    return total * 2 / (n * (n + 1))


def test_repeat_score_equals_sorted_suffixes():
    rng = random.Random(3)
    texts = ["ab", "aa", "a" * 40, "abc" * 30, "é😀é😀"]
    texts += ["".join(rng.choice("abc é") for _ in range(rng.randint(2, 120))) for _ in range(60)]
    for t in texts:
        assert latex.repeat_score(t) == pytest.approx(brute_repeat(t)), t


def test_relational_scores_equal_those_of_sorted_suffixes(spark):
    import random

    r = random.Random(9)
    texts = ["".join(r.choice("ab" if k % 2 else "abcdeé漢😀\n") for _ in range(r.randint(0, 60))) for k in range(40)]
    texts += ["", "x", "a" * 90, "abc" * 40, None, "abc" * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = repeats.repeat_scores(frame, "t")
    assert got.columns == ["k", "t", "score"]
    for row in got.collect():
        want = None if row.t is None else brute_repeat(row.t) if len(row.t) > 1 else 0.0
        assert row.score == (None if want is None else pytest.approx(want)), row.t
    assert repeats.repeat_scores(frame.limit(0), "t").count() == 0


def test_relational_scores_over_many_rounds_and_few_tables(spark, monkeypatch):
    """Long repeats take further rounds; texts without them none."""
    written, plain = [], repeats._written
    monkeypatch.setattr(repeats, "_written", lambda rows, label: written.append(label) or plain(rows, label))
    rng = random.Random(4)
    noise = "".join(chr(rng.randint(97, 122)) for _ in range(400))
    frame = spark.createDataFrame([(noise,), (noise[:200] + noise[:31],)], "t string")
    assert [r.score for r in repeats.repeat_scores(frame, "t").collect()] == [pytest.approx(brute_repeat(r.t)) for r in frame.collect()]
    assert len(written) <= 3, written
    texts = ["a" * 500, noise + noise + noise[:77], ("漢😀" * 20 + "x") * 6, noise[:64] + "|" + noise[:64], noise]
    for row in repeats.repeat_scores(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect():
        assert row.score == pytest.approx(brute_repeat(row.t)), row.t


def test_degenerate_only_for_long_repeats(apply):
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    assert apply(latex.degenerate(A), [("ab" * 100, ""), (noise, ""), ("a" * 100, ""), (None, "")], AB) == [
        True, False, False, False,
    ]


def test_outputs(apply):
    assert apply(ck.same_tokens(A, B), [(" 1  2\n", "1 2"), ("1", "2")], AB) == [True, False]
    assert apply(ck.same_stripped(A, B), [(" x\n", "x"), (None, ""), ("a  b", "a b")], AB) == [True, True, False]
    rows = [
        ("1\n2\n", "1\n2"), (" a \n b ", "a\nb"), ("1\n\n2", "1\n2"), ("0.1\n2.0000001", "0.1\n2"),
        ("1.5\n2", "1.5\n3"), ("2\n1", "1\n2"), ("1\n2", "1.0\n2.0"), ("", ""), ("x y", "y x"), ("1", "1\n2"),
    ]
    want = [True, True, True, True, False, False, True, True, False, False]
    assert apply(ck.tolerant_output(A, B), rows, AB) == want
    assert apply(ck.tolerant_output(A, B, token_sets=True), [("x y", "y x")], AB) == [True]


def test_returns(apply):
    rows = [
        ("[1, 2]", "[1,2]"), ("3", "[3]"), ('{"b": 1, "a": 2}', '{"a":2,"b":1}'), ("1.0", "1"), ("1", "2"),
        ("x", "x"), ("[1]", "[[1], 5]"), ('"a"', '["a"]'), ("1", "[1, 2, 3]"), ("[1]", "[[1]]"),
    ]
    assert apply(ck.same_return(A, B), rows, AB) == [True, True, True, True, False, False, False, True, False, False]
    first = [True, True, True, True, False, False, True, True, True, True]
    assert apply(ck.same_return(A, B, any_first=True), rows, AB) == first


def test_dispatch_never_null(apply):
    verdict = ck.correct(A, F.array(B), F.col("d"))
    rows = [("A", "a", "mc"), (None, "a", "mc"), ("1/2", "0.5", "math"), ("x", "x", "chat"), ("x", "x", "code"), ("p", "p", "other")]
    assert apply(verdict, rows, "a string, b string, d string") == [True, False, True, False, False, True]
