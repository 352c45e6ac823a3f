"""Dataset preparation: literals for every rule."""

from __future__ import annotations

import base64
import json
import pickle
import zlib

from pyspark.sql import functions as F

from rolloom.operators import prepare as pr
from rolloom.operators import prompts as pm
from rolloom.sources import registry as rg

import pytest

S = F.col("s")


def test_text_rules(apply):
    assert apply(pr.math_markers(S), ["$$$x$$$", None]) == ["$x$", None]
    assert apply(pr.line_ends(S), ["1\r\n2\r3\n", None]) == ["1\n2\n3\n", ""]
    assert apply(pr.statement_field(S), [" $$$n$$$ \n", None]) == ["$n$", ""]
    assert apply(pr.reformat_choices(S), ["(A) x (B)  y (K) z"]) == ["A. x B. y (K) z"]


STATEMENT = (
    "title string, description string, input_format string, output_format string, "
    "examples array<struct<input:string,output:string>>, note string"
)


def test_statement(apply):
    c = F.col
    expr = pr.problem_statement(
        c("title"), c("description"), c("input_format"), c("output_format"), c("examples"), c("note")
    )
    rows = [
        (" Sum ", "Add $$$a$$$", "ints\r\n", None, [("1 2\r\n", "3\r\n"), (None, None)], " n "),
        (None, "Body", None, "out", None, None),
        ("T", None, None, None, [], None),
    ]
    assert apply(expr, rows, STATEMENT) == [
        "Sum\n\nAdd $a$\n\nInput\nints\n\n\nExamples\n\nInput\n1 2\nOutput\n3\n\nNote\nn".replace("ints\n\n\n", "ints\n\n"),
        "Body\n\nOutput\nout",
        "T",
    ]


def test_keep_and_deadline(spark, apply):
    schema = "id int, input_mode string, executable boolean, interaction_format string, generated_checker string, description string"
    good = ("stdio", True, None, "", "text")
    rows = [
        (1, *good), (2, "file", *good[1:]), (3, "stdio", None, *good[2:]), (4, "stdio", True, "dialog", "", "t"),
        (5, "stdio", True, None, "c", "t"), (6, "stdio", True, None, None, None), (7, "stdio", True, None, None, " "), (8, *good),
    ]
    problems = spark.createDataFrame(rows, schema)
    tests = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert [r.id for r in pr.keep_contest_problems(problems, tests).collect()] == [1]
    limits = [(1.0,), (0.0,), (None,), (2.5,), (0.1,)]
    assert apply(pr.deadline(S), limits, "s double") == [4, 4, 4, 9, 2]


def test_decode_cases(apply):
    text = json.dumps([{"input": "1", "output": "2"}])
    packed = base64.b64encode(zlib.compress(text.encode())).decode()
    pickled = base64.b64encode(zlib.compress(pickle.dumps(text))).decode()
    rows = [text, packed, pickled, "rubbish", None]
    assert apply(pr.decode_cases(S), rows) == [text, text, None, None, None]
    assert apply(pr.quarantined(S), rows) == [False, False, True, True, False]


def test_windows(apply):
    names = pr.in_windows(S, {"a": ("2024-10", "2025-02"), "b": ("2024-08", "2025-05")})
    assert apply(names, ["2024-10-01", "2025-02-28T00:00", "2024-09-01", "2025-06-01", None]) == [
        ["a", "b"], ["a", "b"], ["b"], [], [],
    ]


def test_strip_instruction(apply):
    expr = pr.strip_instruction(F.col("d"), S)
    rows = [
        (pr.MATH_LINES[0] + "\n\n Q ", "math"), (pr.MATH_LINES[0] + "\n" + pr.MATH_LINES[1] + "\nQ", "math"),
        (pr.CHOICE_LINE + "\nQ", "science"), ("intro\n# Your code here\n```\n\nQ", "code"),
        ("intro\n# Your code here\nQ", "code"), ("intro\n\n\nQ\n\nR", "code"), ("Q", "code"),
        (pr.CHOICE_LINE + "\nQ", "math"), (" Q ", None),
    ]
    assert apply(expr, rows, "s string, d string") == [
        "Q", "Q", "Q", "Q", "Q", "Q\n\nR", "Q", pr.CHOICE_LINE + "\nQ", "Q",
    ]


def test_payloads(spark):
    raws = {
        '{"type":"pytest","test_code":"x","fn_name":"f"}': ("pytest", "f", True),
        '{"test_code":"x"}': ("pytest", None, True),
        '{"type":"stdio","cases":[]}': ("stdio", "e", True),
        '{"type":"fn_call","fn_name":"g","cases":[{"args":[1]},{"args":[]}]}': ("fn_call", "g", True),
        '{"type":"fn_call","fn_name":"g","cases":[{"args":[1]},{"args":"raw"}]}': ("fn_call", "g", False),
        '{"type":"fn_call","fn_name":"g","cases":[]}': ("fn_call", "g", False),
        '["assert 1"]': ("assert_list", "e", True),
        "['assert 1']": ("assert_list", "e", True),
        "{'type': 'stdio'}": ("stdio", "e", True),
        "N/A": ("unknown", "e", False),
        "[1": ("unknown", "e", False),
        "5": ("unknown", "e", False),
        None: ("unknown", "e", False),
    }
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, tests_json string")
    out = pr.with_payload(rows).select(
        "i",
        "fmt",
        pr.function_name(F.lit(""), F.col("fmt"), F.col("fields"), F.lit("e")).alias("fn"),
        pr.scorable(F.lit("code"), F.col("fmt"), F.col("fields")).alias("ok"),
        pr.scorable(F.lit("chat"), F.col("fmt"), F.col("fields")).alias("chat"),
    )
    got = [(r.fmt, r.fn, r.ok) for r in out.orderBy("i").collect()]
    assert got == list(raws.values())
    assert not any(r.chat for r in out.collect())


def test_labels_and_budgets(apply):
    assert apply(pr.resolve_domain(S, F.col("d")), [("science", None), (None, "ifeval"), (None, None), ("zz", "mc")], "s string, d string") == [
        "mc", "ifeval", "math", "zz",
    ]
    assert apply(pr.token_budget(S, F.lit(3000)), ["math", "code", "science", "other", None]) == [3000, 2048, 1024, 3000, 3000]
    assert apply(pr.option_letters(F.col("l"), S), [("a/MMLU.json", None), ("x.json", "AB"), ("q/ARC_C.v.json", None), (None, None)], "s string, l string") == [
        "ABCD", "AB", "ABCDEFGHIJ", "ABCDEFGHIJ",
    ]


def test_templates(apply):
    assert apply(pm.fill(F.lit("{question} in \\boxed{{}}."), S), ["a {question} {{b}}"]) == ["a {question} {{b}} in \\boxed{}."]
    assert apply(pm.fill(F.lit(None).cast("string"), S), ["q"]) == ["q"]
    assert apply(pm.fill(F.lit("{{question}} {{{question}}}"), S), ["q"]) == ["{question} {q}"]
    chat = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    assert apply(pm.render(pm.one_turn(S)), ["q"]) == [chat]
    assert apply(pm.render(pm.one_turn(S), reply_lead="<think>"), ["q"]) == [chat[:-1] + "<think>\n"]
    assert apply(pm.prefilled(S), [" q "])[0].endswith("```python\n")


def test_registry_fails_on_unknown_names(spark):
    rows = spark.createDataFrame([("GSM8K",), ("nope",)], "dataset string")
    with pytest.raises(Exception, match="unknown dataset nope"):
        rg.located(rows, "dataset", "/data").collect()
    assert rg.located(rows.limit(1), "dataset", "/data/").first().path == "/data/GSM8K.json"


def test_required_datasets(spark):
    rows = spark.createDataFrame([("MMLU", False)], "dataset string, bad boolean")
    report = rg.verification(rg.registry_frame(spark), rows, "dataset", "bad")
    with pytest.raises(ValueError, match="GSM8K"):
        rg.require_complete(report)


def test_repair_note_keeps_missing_fields_and_refuses_unknown_codes(spark):
    schema = "code int, error string, inputs string, output string, expected string"
    rows = spark.createDataFrame([(-2, None, None, "7", "8"), (None, "x", "1", "2", "3")], schema)
    note = pm.repair_note(*[F.col(c) for c in rows.columns]).alias("note")
    wrong, none = [r.note for r in rows.select(note).collect()]
    assert wrong.endswith("a wrong answer.\nInput: \nGenerated Output: 7\nExpected: 8") and none == ""
    strange = spark.createDataFrame([(-9, "x", "1", "2", "3")], schema)
    with pytest.raises(Exception, match="unknown error code -9"):
        strange.select(note).collect()
