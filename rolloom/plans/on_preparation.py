"""Dataset preparation over problem tables (family B)."""

from __future__ import annotations

import base64
import pickle
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.operators import prepare as pr
from rolloom.plans.base import query
from rolloom.plans.on_answers import S, sql_rstrip, sql_strip
from rolloom.session import work_dir

WINDOWS = {"w5": ("1995-10", "1996-02"), "w6": ("1995-08", "1996-05")}


@query("b01_math_markers", "SELECT id, replace(description, '$$$', '$') AS description FROM f_cf")
def math_markers(v):
    return v.f_cf.select("id", pr.math_markers(F.col("description")).alias("description"))


def _sql_lines(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '\\r\\n?', chr(10), 'g')"


@query(
    "b02_line_ends",
    f"SELECT id, ord, {_sql_lines('input')} AS input, {_sql_lines('output')} AS output FROM f_cf_tests",
)
def line_ends(v):
    return v.f_cf_tests.select(
        "id", "ord", pr.line_ends(F.col("input")).alias("input"), pr.line_ends(F.col("output")).alias("output")
    )


def _sql_field(expr: str) -> str:
    return sql_strip(f"coalesce({expr}, '')")


@query(
    "b03_text_field",
    f"SELECT id, {_sql_field('description')} AS description, {_sql_field('input_format')} AS input_format FROM f_cf",
)
def text_field(v):
    return v.f_cf.select(
        "id",
        pr.text_field(F.col("description")).alias("description"),
        pr.text_field(F.col("input_format")).alias("input_format"),
    )


def _examples():
    pair = F.struct(F.col("ex_input").alias("input"), F.col("ex_output").alias("output"))
    fixed = F.struct(F.lit("7\r\n").alias("input"), F.lit(None).cast("string").alias("output"))
    return F.array(pair, F.when(F.col("id") % 3 == 0, fixed).otherwise(pair))


def _statement():
    c = F.col
    return pr.problem_statement(
        c("title"), c("description"), c("input_format"), c("output_format"), _examples(), c("note")
    )


def _sql_statement() -> str:
    nl = "chr(10)"
    def section(expr, heading):  # noqa: E306
        f = f"replace({_sql_field(expr)}, '$$$', '$')"
        return f"CASE WHEN {f} <> '' THEN {nl} || {nl} || '{heading}' || {nl} || {f} ELSE '' END"

    i, o = sql_rstrip(_sql_lines("ex_input")), sql_rstrip(_sql_lines("ex_output"))
    first = f"CASE WHEN {i} <> '' OR {o} <> '' THEN {nl} || {nl} || 'Input' || {nl} || {i} || {nl} || 'Output' || {nl} || {o} ELSE '' END"
    second = f"CASE WHEN id % 3 = 0 THEN {nl} || {nl} || 'Input' || {nl} || '7' || {nl} || 'Output' || {nl} ELSE {first} END"
    d = f"replace({_sql_field('description')}, '$$$', '$')"
    return sql_strip(
        f"""concat({_sql_field('title')}, {nl}, CASE WHEN {d} <> '' THEN {nl} || {d} ELSE '' END, {section('input_format', 'Input')},
        {section('output_format', 'Output')}, CASE WHEN {first} || {second} <> '' THEN {nl} || {nl} || 'Examples' || {first} || {second} ELSE '' END,
        {section('note', 'Note')})"""
    )


@query("b04_problem_statement", f"SELECT id, {_sql_statement()} AS question FROM f_cf")
def problem_statement(v):
    return v.f_cf.select("id", _statement().alias("question"))


_SQL_KEEP = f"""input_mode = 'stdio' AND executable AND coalesce(interaction_format, '') = '' AND coalesce(generated_checker, '') = ''
    AND {_sql_field('description')} <> '' AND id IN (SELECT id FROM f_cf_tests)"""


@query(
    "b05_keep_contest_problems",
    f"SELECT id, title FROM f_cf WHERE {_SQL_KEEP}",
)
def keep_problems(v):
    return pr.keep_contest_problems(v.f_cf, v.f_cf_tests).select("id", "title")


_SQL_DEADLINE = "CAST(greatest(1, ceil(coalesce(nullif(time_limit, 0), 1.0) * 3) + 1) AS INT)"


@query(
    "b06_contest_tests",
    f"""SELECT t.id, t.ord, {_sql_lines('t.input')} AS input, {_sql_lines('t.output')} AS output, {_SQL_DEADLINE} AS deadline
        FROM f_cf_tests t JOIN (SELECT * FROM f_cf WHERE {_SQL_KEEP}) p ON p.id = t.id""",
)
def contest_tests(v):
    return pr.contest_tests(v.f_cf.filter(pr.scorable_contest_problem()), v.f_cf_tests)


@query(
    "b06_contest_records",
    f"""SELECT id AS task_id, {_sql_statement()} AS question, {_SQL_DEADLINE} AS test_time_limit, 'stdio' AS test_method, rating,
          array_to_string(tags, ',') AS tags, 'codeforces' AS platform, part, inputs, outputs
        FROM f_cf p JOIN (SELECT id AS tid, CAST((n - 1) // 7 AS INT) AS part, string_agg(i, '|' ORDER BY n) AS inputs, string_agg(o, '|' ORDER BY n) AS outputs
              FROM (SELECT id, {_sql_lines('input')} AS i, {_sql_lines('output')} AS o,
                      row_number() OVER (PARTITION BY id ORDER BY ord, {_sql_lines('input')}, {_sql_lines('output')}) AS n FROM f_cf_tests) t
              GROUP BY id, (n - 1) // 7) t ON tid = id WHERE {_SQL_KEEP}""",
)
def contest_records(v):
    rows = pr.contest_records(v.f_cf, v.f_cf_tests, _statement(), part_size=7)
    return rows.select(
        "task_id", "question", "test_time_limit", "test_method", "rating", F.array_join("tags", ",").alias("tags"), "platform", "part",
        F.array_join("test_input", "|").alias("inputs"), F.array_join("test_output", "|").alias("outputs"),
    )


@query(
    "b07_kept_per_split",
    f"SELECT split, count(*) FILTER (WHERE {_SQL_KEEP}) AS kept, count(*) AS total FROM f_cf GROUP BY split",
)
def kept_per_split(v):
    return pr.kept_per_split(v.f_cf, v.f_cf_tests)


@query(
    "b07_written_splits",
    f"""SELECT split, total, fit, least(fit, CASE split WHEN 'train' THEN 50 ELSE fit END) AS kept, least(fit, CASE split WHEN 'train' THEN 50 ELSE fit END) AS rows
        FROM (SELECT split, count(*) AS total, count(*) FILTER (WHERE {_SQL_KEEP}) AS fit FROM f_cf GROUP BY split) x""",
)
def written_splits(v):
    """Both splits written, one of them capped; counts of the write and of the files."""
    out = None
    for split, cap in (("train", 50), ("test", None)):
        path = work_dir(v.spark, f"split_{split}")
        counts = pr.write_split(v.f_cf, v.f_cf_tests, split, path, cap)
        rows = v.spark.read.parquet(path).agg(F.count("*").alias("rows"))
        row = rows.select(F.lit(split).alias("split"), *[F.lit(n).cast("bigint").alias(k) for k, n in counts.items()], "rows")
        out = row if out is None else out.unionByName(row)
    return out


@F.pandas_udf(T.StringType())
def _pack(texts: pd.Series) -> pd.Series:
    """Even lengths as deflated JSON, odd ones as a pickle that must not load."""

    def one(text: str) -> str:
        data = text.encode() if len(text) % 2 == 0 else pickle.dumps(text)
        return base64.b64encode(zlib.compress(data)).decode()

    return texts.map(one)


@query(
    "b08_decode_cases",
    """SELECT id, CASE WHEN id % 4 = 0 OR length(private_tests) % 2 = 0 THEN private_tests END AS cases,
       id % 4 <> 0 AND length(private_tests) % 2 = 1 AS quarantined FROM f_date""",
)
def decode_cases(v):
    rows = v.f_date.select(
        "id",
        F.when(F.col("id") % 4 == 0, F.col("private_tests"))
        .otherwise(_pack(F.when(F.col("id") % 4 != 0, F.col("private_tests")).otherwise("")))
        .alias("raw"),
    )
    return rows.select(
        "id", pr.decode_cases(F.col("raw")).alias("cases"), pr.quarantined(F.col("raw")).alias("quarantined")
    )


def sql_text(value: str) -> str:
    """A SQL literal of any text (no backslash escapes in the checker)."""
    return "'" + value.replace("'", "''") + "'"


def sql_code_question() -> str:
    from rolloom.operators import prompts as pm

    starter = f"concat({sql_text('### Format: ' + pm.FORMAT_STARTER + chr(10) + '```python' + chr(10))}, starter_code, chr(10), '```', chr(10), chr(10))"
    plain = sql_text(f"### Format: {pm.FORMAT_STDIN}\n```python\n# YOUR CODE HERE\n```\n\n")
    return f"""concat('### Question:', chr(10), content, chr(10), chr(10), CASE WHEN starter_code <> '' THEN {starter} ELSE {plain} END,
        {sql_text(pm.ANSWER_FORMAT)})"""


@query("b09_code_question", f"SELECT id, {sql_code_question()} AS question FROM f_date")
def code_question(v):
    from rolloom.operators import prompts as pm

    return v.f_date.select("id", pm.code_question(F.col("content"), F.col("starter_code")).alias("question"))


@query(
    "b10_code_records",
    f"""WITH t AS (SELECT id, difficulty, contest_date, starter_code, {sql_code_question()} AS question,
        json_extract_string(public_tests, '$[0].input') AS i1, json_extract_string(public_tests, '$[0].output') AS o1,
        json_extract_string(private_tests, '$[0].output') AS o2, json_extract_string(metadata, '$.func_name') AS fn FROM f_date)
      SELECT id AS task_id, question, '' AS ground_truth_answer, difficulty, contest_date, starter_code,
        concat('{{"inputs":["', i1, '","x","y"],"outputs":["', o1, '","', o2, '","z"]', CASE WHEN fn IS NULL THEN '' ELSE ',"fn_name":"' || fn || '"' END, '}}') AS input_output
      FROM t""",
)
def code_records(v):
    from rolloom.operators import prompts as pm

    cases = pr.case_list(F.col("public_tests"), F.col("private_tests"))
    return v.f_date.select(
        F.col("id").alias("task_id"),
        pm.code_question(F.col("content"), F.col("starter_code")).alias("question"),
        F.lit("").alias("ground_truth_answer"),
        "difficulty",
        "contest_date",
        "starter_code",
        pr.input_output(cases, F.col("metadata")).alias("input_output"),
    )


@query(
    "b11_month_windows",
    """SELECT d.id, d.contest_date, w.name AS "window" FROM f_date d JOIN f_windows w
       ON substr(coalesce(d.contest_date, ''), 1, 7) BETWEEN w.lo AND w.hi""",
)
def month_windows(v):
    return pr.per_window(v.f_date, "contest_date", WINDOWS).select("id", "contest_date", "window")


def sql_stripped() -> str:
    lead = lambda q, line: f"CASE WHEN starts_with({q}, {sql_text(line)}) THEN regexp_replace(substr({q}, {len(line) + 1}), '\\A\\n+', '') ELSE {q} END"
    math = lead(f"({lead('input', pr.MATH_LINES[0])})", pr.MATH_LINES[1])
    rest = "substr(input, strpos(input, '# Your code here' || chr(10)) + 17)"
    code = f"""CASE WHEN contains(input, '# Your code here' || chr(10)) THEN regexp_replace({rest}, '\\A(?:```?[{S}]*\\n+)?\\n*', '')
        WHEN contains(input, chr(10) || chr(10)) THEN regexp_replace(substr(input, strpos(input, chr(10) || chr(10)) + 2), '\\A\\n+', '') ELSE input END"""
    return sql_strip(
        f"CASE domain WHEN 'math' THEN {math} WHEN 'science' THEN {lead('input', pr.CHOICE_LINE)} WHEN 'code' THEN {code} ELSE input END"
    )


@query("b12_strip_instruction", f"SELECT id, domain, {sql_stripped()} AS question FROM f_mix")
def strip_instruction(v):
    question = pr.strip_instruction(F.col("domain"), F.col("input"))
    return v.f_mix.select("id", "domain", question.alias("question"))


@query(
    "b13_mixed_records",
    f"""SELECT id, {sql_stripped()} AS question, answer AS ground_truth_answer, domain, source, CASE WHEN {sql_strip('tests')} <> '' THEN tests END AS tests_json FROM f_mix""",
)
def mixed_records(v):
    return pr.mixed_records(v.f_mix)


@query(
    "b14_reformat_choices",
    f"""SELECT id, regexp_replace(concat('(A) ', q, ' (B)  second (K) kept (C)third', chr(10), input), '\\(([A-J])\\)[{S}]*', '\\1. ', 'g') AS question
        FROM (SELECT id, input, source AS q FROM f_mix) x""",
)
def reformat_choices(v):
    q = F.concat(F.lit("(A) "), F.col("source"), F.lit(" (B)  second (K) kept (C)third\n"), F.col("input"))
    return v.f_mix.select("id", pr.reformat_choices(q).alias("question"))


@query(
    "b15_resolve_domain",
    """SELECT id, coalesce(CASE coalesce(domain, d) WHEN 'science' THEN 'mc' ELSE coalesce(domain, d) END, 'math') AS domain
       FROM (SELECT id, domain, CASE WHEN id % 2 = 0 THEN 'ifeval' END AS d FROM f_mix) x""",
)
def resolve_domain(v):
    dataset = F.when(F.col("id") % 2 == 0, F.lit("ifeval"))
    return v.f_mix.select("id", pr.resolve_domain(F.col("domain"), dataset).alias("domain"))


_SQL_FMT = """CASE WHEN tests_json IS NULL OR tests_json = 'N/A' THEN 'unknown' WHEN starts_with(tests_json, '[') THEN 'assert_list'
    WHEN json_extract_string(tests_json, '$.type') IN ('pytest', 'stdio', 'fn_call') THEN json_extract_string(tests_json, '$.type') ELSE 'unknown' END"""


@query("b16_classify_tests", f"SELECT sample_id, {_SQL_FMT} AS fmt FROM f_tests")
def classify_tests(v):
    return pr.with_payload(v.f_tests).select("sample_id", "fmt")


_SQL_OBJECT = "CASE WHEN starts_with(tests_json, '{') THEN tests_json END"


@query(
    "b17_function_name",
    f"""SELECT sample_id, CASE WHEN fn_name <> '' THEN fn_name WHEN {_SQL_FMT} IN ('pytest', 'fn_call')
        THEN json_extract_string({_SQL_OBJECT}, '$.fn_name') ELSE nullif(entry_point, '') END AS name FROM f_tests""",
)
def function_name(v):
    c = F.col
    rows = pr.with_payload(v.f_tests)
    return rows.select("sample_id", pr.function_name(c("fn_name"), c("fmt"), c("fields"), c("entry_point")).alias("name"))


@query(
    "b18_scorable",
    f"""SELECT sample_id, CASE WHEN dom = 'chat' THEN false WHEN dom = 'code' AND fmt = 'unknown' THEN false
        WHEN dom = 'code' AND fmt = 'fn_call' THEN coalesce(json_type(tests_json, '$.cases[0].args') = 'ARRAY', false) ELSE true END AS scorable
        FROM (SELECT sample_id, tests_json, {_SQL_FMT} AS fmt, CASE CAST(sample_id % 4 AS INT) WHEN 0 THEN 'chat' WHEN 1 THEN 'math' ELSE 'code' END AS dom FROM f_tests) x""",
)
def scorable(v):
    k = F.col("sample_id") % 4
    domain = F.when(k == 0, "chat").when(k == 1, "math").otherwise("code")
    rows = pr.with_payload(v.f_tests)
    return rows.select("sample_id", pr.scorable(domain, F.col("fmt"), F.col("fields")).alias("scorable"))


@query(
    "b19_token_budget",
    """SELECT id, CASE domain WHEN 'math' THEN least(m, 4096) WHEN 'code' THEN least(m, 2048) WHEN 'chat' THEN least(m, 2048)
       WHEN 'science' THEN least(m, 1024) ELSE m END AS budget FROM (SELECT id, domain, CAST(500 + id % 4000 AS INT) AS m FROM f_mix) x""",
)
def token_budget(v):
    scheduled = (500 + F.col("id") % 4000).cast("int")
    return v.f_mix.select("id", pr.token_budget(F.col("domain"), scheduled).alias("budget"))


@query(
    "b20_option_letters",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ABC' WHEN doc_id % 5 = 1 THEN 'ABCDE' WHEN doc_id % 5 = 2 THEN 'ABCD' ELSE 'ABCDEFGHIJ' END AS letters
       FROM documents""",
)
def option_letters(v):
    k = F.col("doc_id") % 5
    path = F.when(k == 1, "/data/ARC_C.json").when(k == 2, "x/MMLU.json").when(k == 3, F.concat(F.lit("y/"), "source")).otherwise("MMLU_Pro.json")
    explicit = F.when(F.col("doc_id") % 3 == 0, F.lit("ABC"))
    return v.documents().select("doc_id", pr.option_letters(explicit, path).alias("letters"))
