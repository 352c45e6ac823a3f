"""Answer extraction over generated responses (family D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import extract as ex
from rolloom.functions import text as tx
from rolloom.plans.base import query

S, W = tx.SPACE, tx.WORD
NW = tx.NOT_WORD
FENCE = ex.FENCE


def sql_strip(expr: str, members: str = S) -> str:
    return f"regexp_replace(regexp_replace({expr}, '\\A[{members}]+', ''), '[{members}]+\\z', '')"


def sql_rstrip(expr: str, members: str = S) -> str:
    return f"regexp_replace({expr}, '[{members}]+\\z', '')"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{S}]+'), lambda w: w <> '')"


def _last(expr: str, head: str, flags: str = "s", prefix: str | None = None) -> str:
    prefix = f"(?:.*{NW})?" if prefix is None else prefix
    return f"nullif(regexp_extract({expr}, '(?{flags})\\A{prefix}{head}', 1), '')"


def sql_mc_letter(expr: str, letters: str = ex.DEFAULT_LETTERS) -> str:
    both = f"([{letters}{letters.lower()}])"
    q = "''"  # a quote inside a SQL literal
    sep = f'[{S}*"{q}$(:.]'
    boxed = _last(expr, rf"\\boxed\{{[{S}]*(?:\\text(?:bf|rm|sf|tt|it)?[{S}]*\{{)?[{S}]*{both}", "s", ".*")
    label = _last(expr, rf'answer[{S}*"{q})\]]*[:=][{S}*"{q}$(]*{both}', "is")
    state = _last(
        expr, rf'answer[{S}*"{q}]+is{sep}+(?:option|choice|letter)?{sep}*{both}(?:{NW}|\z)', "is"
    )
    bare = _last(expr, rf"([{letters}])(?:{NW}|\z)")
    return f"coalesce(upper(coalesce({boxed}, {label}, {state}, {bare})), '{ex.INVALID}')"


@query("d01_mc_letter", f"SELECT resp_id, {sql_mc_letter('response')} AS letter FROM f_resp")
def mc_letter(v):
    return v.f_resp.select("resp_id", ex.mc_letter(F.col("response")).alias("letter"))


@query(
    "d01_mc_letter_by_set",
    f"""SELECT resp_id, CASE letters WHEN 'ABCD' THEN {sql_mc_letter('response', 'ABCD')}
        WHEN 'ABCDE' THEN {sql_mc_letter('response', 'ABCDE')} ELSE {sql_mc_letter('response')} END AS letter
        FROM f_resp""",
)
def mc_letter_by_set(v):
    letter = ex.choice_letter_for(F.col("response"), F.col("letters"), ["ABCD", "ABCDE"])
    return v.f_resp.select("resp_id", letter.alias("letter"))


@query(
    "d02_wide_letter",
    f"""SELECT resp_id, coalesce(upper(nullif(regexp_extract(response, '(?i)ANSWER[{S}]*:[{S}]*([A-P])', 1), '')),
        {sql_mc_letter('response')}) AS letter FROM f_resp""",
)
def wide_letter(v):
    return v.f_resp.select("resp_id", ex.wide_letter(F.col("response")).alias("letter"))


SQL_LAST_NUMBER = "list_last(regexp_extract_all(response, '-?[$0-9.,]{2,}|-?[0-9]+'))"


@query(
    "d03_stated_number",
    rf"""SELECT resp_id, coalesce(nullif(regexp_extract(response, 'The answer is (-?[0-9.,]+)\.', 1), ''),
        {SQL_LAST_NUMBER}, '[invalid]') AS answer FROM f_resp""",
)
def stated_number(v):
    return v.f_resp.select("resp_id", ex.stated_number(F.col("response")).alias("answer"))


@query(
    "d04_ending_letter",
    """SELECT resp_id, coalesce(upper(nullif(regexp_extract(lower(response), '[abcd]'), '')), '[invalid]') AS letter
       FROM f_resp""",
)
def ending_letter(v):
    return v.f_resp.select("resp_id", ex.ending_letter(F.col("response")).alias("letter"))


def _sql_phrase(lead: str) -> str:
    hit = rf"nullif(regexp_extract(response, '(?i){lead}[{S}:]*([^\n]+?)(?:\.|\n?\z)', 1), '')"
    return sql_strip(sql_strip(hit), "()")


SQL_PHRASE = f"""coalesce({_sql_phrase('so the answer is')}, {_sql_phrase('the answer is')},
    {sql_rstrip(f"list_last(list_filter(list_transform(string_split(response, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> ''))", '.')},
    '[invalid]')"""


@query("d05_stated_phrase", f"SELECT resp_id, {SQL_PHRASE} AS answer FROM f_resp")
def stated_phrase(v):
    return v.f_resp.select("resp_id", ex.stated_phrase(F.col("response")).alias("answer"))


def sql_short_form(expr: str) -> str:
    head = f"regexp_replace({expr}, '(?s)[\\n.,].*', '')"
    plain = f"regexp_replace({head}, '[^{W}{S}]', '', 'g')"
    return f"array_to_string(list_filter({sql_words(plain)}, lambda w: lower(w) NOT IN ('a', 'an', 'the')), ' ')"


def sql_short_answer(expr: str) -> str:
    first = f"lower(string_split({sql_strip(expr)}, chr(10))[1])"
    for marker in ("answer is", "a:", "answer:"):
        first = f"list_last(string_split({first}, '{marker}'))"
    return sql_short_form(sql_strip(first))


@query("d06_short_answer", f"SELECT resp_id, {sql_short_answer('response')} AS answer FROM f_resp")
def short_answer(v):
    return v.f_resp.select("resp_id", ex.short_answer(F.col("response")).alias("answer"))


def sql_boxed(expr: str) -> str:
    """Inner text of the last box, by prefix counts over the cut pieces."""
    tail = f"list_last(string_split({expr}, '\\boxed'))"
    pieces = f"string_split({tail}, '}}')"
    opens = "(len(array_to_string(p[1:i], '')) - len(replace(array_to_string(p[1:i], ''), '{', '')))"
    hit = f"list_filter(range(1, len(p)), lambda i: {opens} = i)[1]"
    inner = f"substr(array_to_string(p[1:({hit})], '}}'), 2)"
    return f"""(SELECT CASE WHEN contains({expr}, '\\boxed') AND starts_with(p[1], '{{') AND ({hit}) IS NOT NULL
        THEN {inner} END FROM (SELECT {pieces} AS p) b)"""


@query(
    "d07_boxed_or_text",
    f"SELECT resp_id, coalesce({sql_boxed('response')}, response) AS answer FROM f_resp",
)
def boxed(v):
    return v.f_resp.select("resp_id", ex.boxed_or_text(F.col("response")).alias("answer"))


@query(
    "d07_final_boxed",
    f"SELECT resp_id, coalesce({sql_boxed('response')}, '{ex.NO_ANSWER}') AS answer FROM f_resp",
)
def final_boxed(v):
    return v.f_resp.select("resp_id", ex.final_boxed(F.col("response")).alias("answer"))


@query(
    "d08_final_answer",
    rf"""WITH cleaned AS (
      SELECT resp_id, replace(regexp_replace({sql_strip("replace(replace(response, 'is:', 'is'), 'answer:', 'answer is')")},
        '\.\z', ''), '.$', '$') AS o FROM f_resp),
    picked AS (SELECT resp_id, coalesce(nullif(regexp_extract(o, 'answer is (-?\p{{Nd}}+\.?\p{{Nd}}*)\n?\z', 1), ''),
        nullif(regexp_extract(o, '(?s)answer is (.+?)\n?\z', 1), ''), o) AS a FROM cleaned)
    SELECT resp_id, coalesce({sql_boxed('a')}, a) AS answer FROM picked""",
)
def final_answer(v):
    return v.f_resp.select("resp_id", ex.final_answer(F.col("response")).alias("answer"))


SQL_MATH = rf"""coalesce({sql_boxed('response')},
    {sql_strip(rf"nullif(regexp_extract(response, '(?i)final answer is[{S}:$]*([^\n$]+?)\.?(?:[\n$]|\z)', 1), '')")},
    {SQL_LAST_NUMBER}, '{ex.NO_ANSWER}')"""


@query("d09_math_answer", f"SELECT resp_id, {SQL_MATH} AS answer FROM f_resp")
def math_answer(v):
    return v.f_resp.select("resp_id", ex.math_answer(F.col("response")).alias("answer"))


def sql_blocks(expr: str) -> str:
    found = rf"regexp_extract_all({expr}, '(?s){FENCE}%s[{S}]*(.*?){FENCE}', 1)"
    python, plain = found % "python", found % ""
    return f"CASE WHEN len({python}) > 0 THEN {python} ELSE {plain} END"


SQL_CODE = f"""(SELECT CASE WHEN len(fn_name) > 0 THEN coalesce(
      {sql_strip(rf"list_filter(b, lambda x: regexp_matches(x, concat('(?:\A|{NW})def[{S}]+', fn_name, '[{S}]*\(')))[1]")},
      array_to_string(list_transform(b, lambda x: {sql_strip('x')}), chr(10) || chr(10)))
    ELSE array_to_string(list_transform(b, lambda x: {sql_strip('x')}), chr(10) || chr(10)) END
    FROM (SELECT {sql_blocks('response')} AS b) y)"""


@query("d10_code_block", f"SELECT resp_id, {SQL_CODE} AS code FROM f_resp")
def code_block(v):
    return v.f_resp.select("resp_id", ex.code_block(F.col("response"), F.col("fn_name")).alias("code"))


SQL_LAST_BLOCK = rf"list_last(regexp_extract_all(response, '(?s){FENCE}python(.*?){FENCE}', 1))"


@query(
    "d11_last_python_block",
    f"SELECT resp_id, coalesce({sql_strip(SQL_LAST_BLOCK)}, '{ex.NO_CODE}') AS code FROM f_resp",
)
def last_python_block(v):
    return v.f_resp.select("resp_id", ex.last_python_block(F.col("response")).alias("code"))


def sql_unmarked(expr: str) -> str:
    for marker in ex.END_MARKERS:
        expr = f"replace({expr}, '{marker}', '')"
    return expr


def _sql_tidy(expr: str) -> str:
    return sql_rstrip(f"regexp_replace({sql_unmarked(expr)}, '\\A\\n+', '')")


SQL_FIRST_BLOCK = rf"regexp_extract_all(response, '(?s){FENCE}[{W}]*\n(.*?){FENCE}', 1)[1]"


@query(
    "d12_completion_with_prompt",
    f"""SELECT resp_id, concat('def f(x):', chr(10), {_sql_tidy(f'coalesce({SQL_FIRST_BLOCK}, response)')}) AS code FROM f_resp""",
)
def completion_with_prompt(v):
    code = ex.completion_with_prompt(F.col("response"), F.lit("def f(x):"))
    return v.f_resp.select("resp_id", code.alias("code"))


_LAST_TIDY = _sql_tidy(f"coalesce({SQL_LAST_BLOCK}, response)")


@query(
    "d12_completion_if_body",
    rf"""SELECT resp_id, CASE WHEN len(fn_name) > 0 AND regexp_matches({_LAST_TIDY},
          concat('(?m)^def[{S}]+', fn_name, '[{S}]*\('))
        THEN {_LAST_TIDY} ELSE concat('def g(x):', chr(10), {_LAST_TIDY}) END AS code FROM f_resp""",
)
def completion_if_body(v):
    entry = F.coalesce("fn_name", F.lit(""))
    code = ex.completion_if_body(F.col("response"), F.lit("def g(x):"), entry)
    return v.f_resp.select("resp_id", code.alias("code"))


_SQL_MARKED = f"""
    SELECT resp_id, string_split(response, chr(10)) AS r,
      list_filter(range(1, len(string_split(response, chr(10))) + 1),
        lambda i: contains(string_split(response, chr(10))[i], '{FENCE}')) AS m FROM f_resp"""


@query(
    "d13_fence_lines",
    f"""SELECT resp_id, CASE WHEN len(m) < 2 THEN '' ELSE array_to_string(r[m[1] + 1 : m[2] - 1], chr(10)) END AS first_pair,
      CASE WHEN len(m) < 2 THEN '' ELSE array_to_string(r[m[-2] + 1 : m[-1] - 1], chr(10)) END AS last_pair
      FROM ({_SQL_MARKED}) x""",
)
def fence_lines(v):
    c = F.col("response")
    return v.f_resp.select(
        "resp_id",
        ex.fence_lines(c, "first").alias("first_pair"),
        ex.fence_lines(c, "last").alias("last_pair"),
    )


def _sql_execution() -> str:
    step = "coalesce(list_last(regexp_extract_all(t, '(?s)\\[PYTHON\\](.*?)\\[/PYTHON\\]', 1)), t)"
    return f"""WITH src AS (SELECT resp_id, CASE WHEN resp_id % 3 = 0 THEN concat('[PYTHON]', response, '[/PYTHON]')
        WHEN resp_id % 3 = 1 THEN concat('[ANSWER]x == ', response, '[/ANSWER]') ELSE response END AS t FROM f_resp),
      a AS (SELECT resp_id, {step} AS o FROM src),
      a2 AS (SELECT resp_id, CASE WHEN contains(o, '[ANSWER]') THEN {sql_strip("string_split(o, '[ANSWER]')[2]")} ELSE o END AS o FROM a),
      b AS (SELECT resp_id, CASE WHEN contains(o, '==') THEN {sql_strip("string_split(o, '==')[2]")} ELSE o END AS o FROM a2)
      SELECT resp_id, {sql_strip("CASE WHEN contains(o, '[/ANSWER]') THEN string_split(o, '[/ANSWER]')[1] ELSE string_split(o, chr(10))[1] END")} AS output
      FROM b"""


@query("d14_execution_output", _sql_execution())
def execution_output(v):
    c = F.col("response")
    kind = F.col("resp_id") % 3
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("[PYTHON]"), c, F.lit("[/PYTHON]")))
        .when(kind == 1, F.concat(F.lit("[ANSWER]x == "), c, F.lit("[/ANSWER]")))
        .otherwise(c)
    )
    return v.f_resp.select("resp_id", ex.execution_output(wrapped, reasoning=True).alias("output"))


@query(
    "d15_assertion_line",
    f"""SELECT resp_id, coalesce(list_last(list_filter(r, lambda x: starts_with(x, 'assert'))),
        CASE WHEN len(k) < 2 THEN '' ELSE array_to_string(r[k[1] + 1 : k[2] - 1], chr(10)) END) AS line
      FROM (SELECT resp_id, r, CASE WHEN s IS NULL THEN m ELSE list_filter(m, lambda i: i >= s) END AS k
        FROM (SELECT resp_id, r, m, list_filter(m, lambda i: contains(r[i], '{FENCE}python') OR contains(r[i], '{FENCE}Python'))[1] AS s
              FROM ({_SQL_MARKED}) x) y) z""",
)
def assertion_line(v):
    return v.f_resp.select("resp_id", ex.assertion_line(F.col("response")).alias("line"))


@query(
    "d16_clean_tail",
    f"SELECT resp_id, {sql_rstrip(sql_unmarked('response'))} AS answer FROM f_resp",
)
def clean_tail(v):
    return v.f_resp.select("resp_id", ex.clean_tail(F.col("response")).alias("answer"))


@query(
    "d17_json_answer",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id AS STRING) END AS id,
        CASE WHEN doc_id % 5 < 3 THEN '{{"a":"}}"}}' END AS note FROM documents""",
)
def json_answer(v):
    """Answers as JSON in a fence, bare, with braces in strings, or cut off."""
    kind = F.col("doc_id") % 5
    core = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "note": "{\\"a\\":\\"}\\"}"}'))
    nl = F.lit("\n")
    fence = F.lit(FENCE)
    body = F.replace(F.col("text"), F.lit("{"), F.lit("("))
    reply = (
        F.when(kind == 0, F.concat(body, nl, fence, F.lit("json\n"), core, nl, fence))
        .when(kind == 1, F.concat(fence, nl, core, nl, fence, nl, body))
        .when(kind == 2, F.concat(body, nl, core, nl, body))
        .when(kind == 3, F.concat(body, F.lit(' {"id": 1, ')))
        .otherwise(body)
    )
    parsed = F.try_parse_json(ex.json_answer(reply))
    return v.documents().select(
        "doc_id",
        F.try_variant_get(parsed, "$.id", "string").alias("id"),
        F.try_variant_get(parsed, "$.note", "string").alias("note"),
    )


@query(
    "d17_literal_answer",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS source, CASE WHEN doc_id % 4 < 3 THEN doc_id % 7 END AS n
       FROM documents""",
)
def literal_answer(v):
    """Answers as Python literals: fenced, bare, or broken."""
    kind = F.col("doc_id") % 4
    core = F.concat(
        F.lit("{'source': '"), F.col("source"), F.lit("', 'n': "), (F.col("doc_id") % 7).cast("string"), F.lit(", 'none': None}")
    )
    fence, nl = F.lit(FENCE), F.lit("\n")
    body = F.replace(F.col("text"), F.lit("{"), F.lit("("))
    reply = (
        F.when(kind == 0, F.concat(body, nl, fence, F.lit("python\n"), core, nl, fence))
        .when(kind == 1, F.concat(fence, nl, core, nl, fence))
        .when(kind == 2, F.concat(F.lit("It is "), core, nl, body))
        .otherwise(F.concat(F.lit("{'source': "), body))
    )
    parsed = F.try_parse_json(ex.literal_answer(reply))
    return v.documents().select(
        "doc_id",
        F.try_variant_get(parsed, "$.source", "string").alias("source"),
        F.try_variant_get(parsed, "$.n", "bigint").alias("n"),
    )


SQL_DOMAIN = "coalesce(CASE domain WHEN 'science' THEN 'mc' ELSE domain END, 'math')"
SQL_DISPATCH = f"""CASE WHEN override_name = 'phrase' THEN {SQL_PHRASE}
    WHEN override_name = 'number' THEN coalesce(nullif(regexp_extract(response, 'The answer is (-?[0-9.,]+)\\.', 1), ''), {SQL_LAST_NUMBER}, '[invalid]')
    WHEN scorer = 'plain' AND {SQL_DOMAIN} = 'math' THEN coalesce({sql_boxed('response')}, response)
    WHEN {SQL_DOMAIN} = 'mc' THEN CASE letters WHEN 'ABCD' THEN {sql_mc_letter('response', 'ABCD')}
        WHEN 'ABCDE' THEN {sql_mc_letter('response', 'ABCDE')} ELSE {sql_mc_letter('response')} END
    WHEN {SQL_DOMAIN} = 'code' THEN {SQL_CODE}
    WHEN {SQL_DOMAIN} = 'triviaqa' THEN {sql_short_answer('response')}
    WHEN {SQL_DOMAIN} = 'livebench' THEN {sql_rstrip(sql_unmarked('response'))}
    ELSE {SQL_MATH} END"""

OVERRIDES = {"phrase": ex.stated_phrase, "number": ex.stated_number}
SCORERS = {("plain", "math"): ex.boxed_or_text}


def dispatched(domain):
    return ex.answer(
        F.col("response"),
        domain,
        F.col("fn_name"),
        override=F.col("override_name"),
        letters=F.col("letters"),
        letter_sets=["ABCD", "ABCDE"],
        scorer=F.col("scorer"),
        overrides=OVERRIDES,
        scorers=SCORERS,
    )


@query("d18_answer_dispatch", f"SELECT resp_id, {SQL_DOMAIN} AS domain, {SQL_DISPATCH} AS answer FROM f_resp")
def answer_dispatch(v):
    from rolloom.operators.prepare import resolve_domain

    rows = v.f_resp.withColumn("domain", resolve_domain(F.col("domain")))
    return rows.select("resp_id", "domain", dispatched(F.col("domain")).alias("answer"))
