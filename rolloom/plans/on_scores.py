"""Scoring of extracted answers and recorded outputs (family E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import extract as ex
from rolloom.functions import latex
from rolloom.operators import grids, repeats, rules, verdicts
from rolloom.operators.prepare import resolve_domain
from rolloom.plans import on_answers as oa
from rolloom.plans.base import query
from rolloom.plans.on_answers import S, sql_strip, sql_words


def sql_letter(expr: str) -> str:
    return f"upper({sql_strip(sql_strip(expr), '()')})"


@query(
    "e01_same_letter",
    f"""SELECT resp_id, {sql_letter(oa.sql_mc_letter('response'))} = {sql_letter("concat(' (', lower(gold), ') ')")} AS correct FROM f_resp""",
)
def same_letter(v):
    gold = F.concat(F.lit(" ("), F.lower("gold"), F.lit(") "))
    return v.f_resp.select("resp_id", ck.same_letter(ex.mc_letter(F.col("response")), gold).alias("correct"))


def _sql_number(expr: str) -> str:
    bare = f"replace(replace({expr}, ',', ''), '$', '')"
    return sql_strip(f"lower(regexp_replace(list_last(string_split({bare}, '#### ')), '\\.(\\n?)\\z', '\\1'))")


_PRED = (
    rf"coalesce(nullif(regexp_extract(response, 'The answer is (-?[0-9.,]+)\.', 1), ''), {oa.SQL_LAST_NUMBER}, '[invalid]')"
)


@query(
    "e02_same_number",
    f"""SELECT resp_id, {_sql_number(_PRED)} = {_sql_number("concat('Some work', chr(10), '#### $1,', CAST(100 + resp_id % 7 AS VARCHAR), '.')")} AS correct
        FROM f_resp""",
)
def same_number(v):
    gold = F.concat(F.lit("Some work\n#### $1,"), (100 + F.col("resp_id") % 7).cast("string"), F.lit("."))
    return v.f_resp.select("resp_id", ck.same_number(ex.stated_number(F.col("response")), gold).alias("correct"))


def _sql_phrase(expr: str) -> str:
    return sql_strip(f"lower({sql_strip(expr)})", "()")


@query(
    "e03_same_phrase",
    f"""SELECT resp_id, {_sql_phrase(oa.SQL_PHRASE)} = {_sql_phrase("concat('(', gold, ')')")} AS correct FROM f_resp""",
)
def same_phrase(v):
    gold = F.concat(F.lit("("), F.col("gold"), F.lit(")"))
    return v.f_resp.select("resp_id", ck.same_phrase(ex.stated_phrase(F.col("response")), gold).alias("correct"))


_ALIASES = "['The Town of ' || gold || '-ville', '...', gold || ' town']"


@query(
    "e04_has_alias",
    f"""WITH p AS (SELECT resp_id, gold, {oa.sql_short_answer('response')} AS pred FROM f_resp)
    SELECT resp_id, len(list_filter(list_transform({_ALIASES}, lambda g: lower({oa.sql_short_form('g')})),
      lambda g: length(g) > 0 AND contains(pred, g))) > 0 AS correct FROM p""",
)
def has_alias(v):
    gold = F.col("gold")
    golds = F.array(
        F.concat(F.lit("The Town of "), gold, F.lit("-ville")), F.lit("..."), F.concat(gold, F.lit(" town"))
    )
    return v.f_resp.select("resp_id", ck.has_alias(ex.short_answer(F.col("response")), golds).alias("correct"))


# Pairs (a, b) derived per part: the same value in two notations.
def _pairs(v):
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    k = F.col("p_partkey") % 12
    f = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a = (
        F.when(k == 0, f("\\frac", F.right(n, F.lit(1)), F.right(m, F.lit(1))))
        .when(k == 1, f(n, "/", m))
        .when(k == 2, f("x=", n))
        .when(k == 3, f(n, ",000"))
        .when(k == 4, f(n, "\\%"))
        .when(k == 5, f("\\sqrt", F.right(n, F.lit(1))))
        .when(k == 6, f(n, "\\text{ cm}"))
        .when(k == 7, f("\\dfrac{", n, "}{", m, "}"))
        .when(k == 8, f(".", n))
        .when(k == 9, f("\\left(", n, " , ", m, "\\right)"))
        .when(k == 10, F.lit("0.5"))
    )
    b = (
        F.when(k == 0, f("\\frac{", F.right(n, F.lit(1)), "}{", F.right(m, F.lit(1)), "}"))
        .when(k == 1, f("\\frac{", n, "}{", m, "}"))
        .when(k == 3, f(n, "000.0"))
        .when(k == 5, f("\\sqrt{", F.right(n, F.lit(1)), "}"))
        .when(k == 7, f("\\tfrac{", n, "}{", n, "}"))
        .when(k == 8, f("0.", n))
        .when(k == 9, f("(", n, ",", m, ")"))
        .when(k == 10, F.lit("\\frac{1}{2}"))
        .when(k == 11, F.when(F.col("p_partkey") % 24 == 11, n))
        .otherwise(n)
    )
    return v.table("part").select(F.col("p_partkey").alias("id"), k.alias("kind"), a.alias("a"), b.alias("b"))


@query(
    "e05_equivalent",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 12 = 7 THEN false WHEN p_partkey % 24 = 11 THEN false ELSE true END AS correct FROM part""",
)
def equivalent(v):
    return _pairs(v).select("id", latex.equivalent(F.col("a"), F.col("b")).alias("correct"))


@query(
    "e06_normal_form",
    r"""SELECT p_partkey AS id, CASE CAST(p_partkey % 4 AS INT)
      WHEN 0 THEN CAST(p_size AS VARCHAR) || '000'
      WHEN 1 THEN 'frac{' || right(CAST(p_size AS VARCHAR), 1) || '}{7}'
      WHEN 2 THEN CAST(p_size AS VARCHAR)
      ELSE 'sqrt{' || right(CAST(p_size AS VARCHAR), 1) || '}+1' END AS form FROM part""",
)
def normal_form(v):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("a total of $"), n, F.lit(",000$ dollars")))
        .when(k == 1, F.concat(F.lit("$frac"), F.right(n, F.lit(1)), F.lit("7$")))
        .when(k == 2, F.concat(F.lit("\\boxed{"), n, F.lit("\\text{ square cm}} units")))
        .otherwise(F.concat(F.lit("sqrt"), F.right(n, F.lit(1)), F.lit(" + 1")))
    )
    return v.table("part").select(F.col("p_partkey").alias("id"), latex.normal_form(answer).alias("form"))


@query(
    "e07_degenerate_text",
    f"SELECT id AS doc_id, n > 128 AND score > 0.2 AS degenerate, round(score, 9) AS score FROM ({repeats.sql_scores('documents', 'doc_id', 'text', 18)}) x",
)
def degenerate(v):
    scored = v.documents().select("doc_id", F.length("text").alias("n"), latex.repetition(F.col("text")).alias("score"))
    return scored.select("doc_id", latex.flagged(F.col("score"), F.col("n")).alias("degenerate"), F.round("score", 9).alias("score"))


@query(
    "e07_relational_scores",
    f"SELECT id AS conv_id, n, round(score, 9) AS score FROM ({repeats.sql_scores('conversations', 'conv_id', 'text', 14)}) x",
)
def relational_scores(v):
    """Every turn of every conversation, its suffixes ranked as rows."""
    turns = v.table("conversations").select("conv_id", "text")
    return repeats.repeat_scores(turns, "text").select("conv_id", F.length("text").cast("bigint").alias("n"), F.round("score", 9).alias("score"))


def _sql_key(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(
    "e08_grid_exact_match",
    f"""WITH cells AS (SELECT puzzle, house, {_sql_key('gold_attr')} AS g, {_sql_key('pred_attr')} AS p,
          {sql_strip('lower(gold_val)')} AS gv, {sql_strip('lower(pred_val)')} AS pv, ord FROM f_grid),
      exact AS (SELECT g.puzzle, g.house, g.g, g.gv, p.pv, g.ord FROM cells g LEFT JOIN cells p
          ON p.puzzle = g.puzzle AND p.house = g.house AND p.p = g.g),
      partial AS (SELECT x.puzzle, x.ord, x.gv,
          coalesce(x.pv, (SELECT arg_min(c.pv, c.ord) FROM cells c WHERE c.puzzle = x.puzzle AND c.house = x.house
             AND (contains(c.p, x.g) OR contains(x.g, c.p)))) AS pv FROM exact x)
      SELECT puzzle, bool_and(coalesce(pv = gv, false)) AS solved, CAST(count(*) AS BIGINT) AS cells FROM partial GROUP BY puzzle""",
)
def grid_match(v):
    cells = v.f_grid
    gold = cells.select("puzzle", "house", F.col("gold_attr").alias("attr"), F.col("gold_val").alias("val"))
    pred = cells.select("puzzle", "house", F.col("pred_attr").alias("attr"), F.col("pred_val").alias("val"), "ord")
    return grids.exact_match(gold, pred)


# Replies about two houses for every customer: prose and JSON in five shapes, the
# first house named by its label, as a building, or not at all.
_REPLY_VALUE = "CASE WHEN c_custkey % 11 = 4 THEN 'nobody' ELSE concat(' ', upper(c_mktsegment), ' ') END"
_REPLY_HOUSE = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'House 1' WHEN 1 THEN 'house_1' WHEN 2 THEN '#1' WHEN 3 THEN 'Building 1' ELSE 'Garden' END"""
_REPLY_CELLS = f"""concat('{{"Owner-Trade": "', {_REPLY_VALUE}, '", "nation": ', CAST(c_nationkey AS STRING), '}}')"""
_REPLY_SECOND = f"""concat('{{"the_owner_trade": "', lower(c_mktsegment), '", "Nation": "', CAST(c_nationkey + c_custkey % 7 - c_custkey % 7 AS STRING), '"}}')"""
_REPLY_OBJECT = f"""concat('{{"', {_REPLY_HOUSE}, '": ', {_REPLY_CELLS}, ', "House 2": ', {_REPLY_SECOND}, '}}')"""
_REPLIES = f"""SELECT c_custkey AS puzzle, c_mktsegment AS trade, c_nationkey AS nation, CASE CAST(c_custkey % 4 AS INT)
    WHEN 0 THEN concat('I think: {{"solution": ', {_REPLY_OBJECT}, '}} as asked')
    WHEN 1 THEN concat(repeat(chr(96), 3), 'json', chr(10), '{{"reasoning": "}} {{", "solution": ', {_REPLY_OBJECT}, '}}', chr(10), repeat(chr(96), 3))
    WHEN 2 THEN concat('So ', {_REPLY_OBJECT})
    ELSE concat('{{"solution": [', {_REPLY_CELLS}, ', ', {_REPLY_SECOND}, ']}}') END AS reply FROM customer"""


@query(
    "e08_reply_to_verdict",
    f"""WITH r AS (SELECT *, nullif(regexp_extract(reply, '(?s)"(?:House 1|house_1|#1|Building 1)": (\\{{.*?\\}})', 1), '') AS named, reply LIKE '%"solution": [%' AS listed FROM ({_REPLIES}) x),
      h AS (SELECT *, CASE WHEN listed THEN regexp_extract(reply, '\\[(\\{{.*?\\}})', 1) ELSE named END AS first,
              regexp_extract(reply, '.*(\\{{"the_owner_trade".*?\\}})', 1) AS second FROM r)
    SELECT puzzle, coalesce(lower(trim(json_extract_string(first, '$."Owner-Trade"'))) = lower(trade) AND json_extract_string(first, '$.nation') = CAST(nation AS VARCHAR)
        AND lower(trim(json_extract_string(second, '$.the_owner_trade'))) = lower(trade) AND json_extract_string(second, '$.Nation') = CAST(nation AS VARCHAR), false) AS solved,
      CAST(4 AS BIGINT) AS cells FROM h""",
)
def reply_to_verdict(v):
    replies = v.sql(_REPLIES)
    cells = F.array(
        *[F.struct(F.lit(h).alias("house"), F.lit(a).alias("attr"), F.col(c).cast("string").alias("val"))
          for h in ("1", "2") for a, c in (("Owner Trade", "trade"), ("Nation", "nation"))]
    )
    gold = replies.select("puzzle", F.explode(cells).alias("c")).select("puzzle", "c.house", "c.attr", "c.val")
    return grids.judged_replies(replies, gold)


@query(
    "e08_grid_answer_cells",
    """SELECT c_custkey AS puzzle, CAST(h AS VARCHAR) AS house, a AS attr,
         CASE a WHEN 'Color' THEN lower(c_mktsegment) ELSE CAST(c_nationkey AS VARCHAR) END AS val
       FROM customer, (VALUES (1), (2)) t(h), (VALUES ('Color'), ('Pet')) u(a) WHERE c_custkey % 5 <> 4""",
)
def grid_answer_cells(v):
    """Replies in the three accepted shapes, and one that holds no grid."""
    kind = F.col("c_custkey") % 5
    row = F.concat(
        F.lit('{"Color": "'), F.lower("c_mktsegment"), F.lit('", "Pet": '), F.col("c_nationkey").cast("string"), F.lit("}")
    )
    houses = F.concat(F.lit('{"House 1": '), row, F.lit(', "house_2": '), row, F.lit("}"))
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"reasoning": "x", "solution": '), houses, F.lit("}\n```")))
        .when(kind == 1, F.concat(F.lit("So: "), houses, F.lit(" done")))
        .when(kind == 2, F.concat(F.lit('{"solution": ['), row, F.lit(", "), row, F.lit("]}")))
        .when(kind == 3, F.concat(F.lit('```\n{"solution": {"#1": '), row, F.lit(', "2": '), row, F.lit("}}\n```")))
        .otherwise(F.lit("no grid {"))
    )
    replies = v.table("customer").select(F.col("c_custkey").alias("puzzle"), ex.json_answer(reply).alias("answer"))
    return grids.answer_cells(replies, "answer").select("puzzle", "house", "attr", "val")


def _sql_squeeze(expr: str) -> str:
    return f"array_to_string({sql_words(expr)}, ' ')"


@query(
    "e09_same_tokens",
    f"""SELECT sample_id, resp_idx, test_idx, {_sql_squeeze('output')} = {_sql_squeeze('expected')} AS correct FROM f_verd""",
)
def same_tokens(v):
    return v.f_verd.select(
        "sample_id", "resp_idx", "test_idx", ck.same_tokens(F.col("output"), F.col("expected")).alias("correct")
    )


@query(
    "e10_same_stripped",
    f"""SELECT sample_id, resp_idx, test_idx, {sql_strip('output')} = {sql_strip('expected')} AS correct FROM f_verd""",
)
def same_stripped(v):
    return v.f_verd.select(
        "sample_id", "resp_idx", "test_idx", ck.same_stripped(F.col("output"), F.col("expected")).alias("correct")
    )


@query(
    "e11_tolerant_output",
    """SELECT sample_id, resp_idx, test_idx, CASE CAST(test_idx % 5 AS INT)
         WHEN 0 THEN error_code IS NULL AND (test_idx * 10 + resp_idx) % 2 = 1 WHEN 1 THEN true WHEN 2 THEN true
         WHEN 3 THEN error_code IS NULL ELSE false END AS correct FROM f_verd""",
)
def tolerant_output(v):
    k = F.col("test_idx") % 5
    n = F.round("score", 2)
    out = (
        F.when(k == 0, F.col("output"))
        .when(k == 1, F.concat(F.lit(" a \n\n"), F.col("sample_id").cast("string"), F.lit("\n")))
        .when(k == 2, F.concat(n.cast("string"), F.lit("1\n2.5\n")))
        .when(k == 3, F.concat(F.lit("x \n y\n"), F.coalesce(F.col("error_code").cast("string"), F.lit("z"))))
        .otherwise(F.lit("1\n2\n"))
    )
    expected = (
        F.when(k == 0, F.col("expected"))
        .when(k == 1, F.concat(F.lit("a\n\n"), F.col("sample_id").cast("string")))
        .when(k == 2, F.concat(n.cast("string"), F.lit("1000001\n2.50")))
        .when(k == 3, F.lit("x\ny\nz\n"))
        .otherwise(F.lit("2\n1\n"))
    )
    return v.f_verd.select(
        "sample_id", "resp_idx", "test_idx", ck.tolerant_output(out, expected).alias("correct")
    )


def _returns():
    """Recorded and expected values of seven kinds, by event."""
    k = F.col("event_id") % 7
    n = F.col("user_id").cast("string")
    out = (
        F.when(k == 0, F.concat(F.lit("["), n, F.lit(", 2]")))
        .when(k == 2, F.concat(F.lit('{"a": '), n, F.lit(', "b": [1]}')))
        .when(k == 4, F.concat(n, F.lit(".0")))
        .when(k == 5, F.lit("not json"))
        .otherwise(n)
    )
    expected = (
        F.when(k == 0, F.concat(F.lit("["), n, F.lit(",2]")))
        .when(k == 1, F.concat(F.lit("["), n, F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"b":[1], "a":'), n, F.lit("}")))
        .when(k == 3, F.lit("[7]"))
        .when(k == 6, F.concat(F.lit("["), n, F.lit(", 2, 3]")))
        .otherwise(n)
    )
    return out, expected


_SQL_RETURNS = """SELECT event_id, CASE CAST(event_id % 7 AS INT) WHEN 3 THEN user_id = 7 WHEN 5 THEN false WHEN 6 THEN {longer}
         ELSE true END AS correct FROM events"""


@query("e12_same_return", _SQL_RETURNS.format(longer="false"))
def same_return(v):
    return v.table("events").select("event_id", ck.same_return(*_returns()).alias("correct"))


@query("e12_same_return_any_first", _SQL_RETURNS.format(longer="true"))
def same_return_any_first(v):
    return v.table("events").select("event_id", ck.same_return(*_returns(), any_first=True).alias("correct"))


_SQL_STATUS = """SELECT sample_id AS task_id, resp_idx, min(CASE WHEN passed THEN 'pass' ELSE 'fail' END) AS base_status,
    max(CASE WHEN passed THEN 'pass' ELSE 'timeout' END) AS plus_status FROM f_verd WHERE platform IS NOT NULL GROUP BY 1, 2"""


@query(
    "e13_external_status",
    f"""WITH status AS ({_SQL_STATUS}), cand AS (SELECT DISTINCT sample_id AS task_id, resp_idx FROM f_verd)
    SELECT c.task_id, c.resp_idx, coalesce(s.base_status = 'pass', false) AS base_pass,
      coalesce(s.plus_status = 'pass', false) AS plus_pass,
      CASE WHEN s.task_id IS NULL THEN 'missing' WHEN s.base_status = 'pass' THEN 'pass' ELSE 'fail' END AS result
    FROM cand c LEFT JOIN status s ON s.task_id = c.task_id AND s.resp_idx = c.resp_idx""",
)
def external_status(v):
    verdicts_ = v.f_verd
    status = (
        verdicts_.filter("platform IS NOT NULL")  # the others were not evaluated
        .groupBy(F.col("sample_id").alias("task_id"), "resp_idx")
        .agg(
            F.min(F.when(F.col("passed"), "pass").otherwise("fail")).alias("base_status"),
            F.max(F.when(F.col("passed"), "pass").otherwise("timeout")).alias("plus_status"),
        )
    )
    candidates = verdicts_.select(F.col("sample_id").alias("task_id"), "resp_idx").distinct()
    return verdicts.attach_status(candidates, status)


@query("e14_score_threshold", "SELECT event_id, coalesce(value > 0.5, false) AS correct FROM events")
def score_threshold(v):
    return v.table("events").select("event_id", ck.above(F.col("value")).alias("correct"))


_SQL_DOMAIN = oa.SQL_DOMAIN


@query(
    "e15_check_dispatch",
    f"""WITH a AS (SELECT resp_id, gold, override_name, scorer, {_SQL_DOMAIN} AS domain, {oa.SQL_DISPATCH} AS pred,
          resp_id % 5 = 0 AS recorded FROM f_resp)
    SELECT resp_id, coalesce(CASE WHEN override_name = 'phrase' THEN {_sql_phrase('pred')} = {_sql_phrase('gold')}
        WHEN override_name = 'number' THEN {_sql_number('pred')} = {_sql_number('gold')}
        WHEN scorer = 'plain' AND domain = 'math' THEN lower(pred) = lower(gold)
        WHEN domain = 'mc' THEN {sql_letter('pred')} = {sql_letter('gold')}
        WHEN domain = 'triviaqa' THEN gold <> 'A' AND contains(pred, lower(gold))
        WHEN domain IN ('code', 'livebench') THEN recorded
        ELSE pred = gold END, false) AS correct FROM a""",
)
def check_dispatch(v):
    rows = v.f_resp.withColumn("domain", resolve_domain(F.col("domain")))
    rows = rows.select("*", oa.dispatched(F.col("domain")).alias("pred"))
    verdict = ck.correct(
        F.col("pred"),
        F.array("gold"),
        F.col("domain"),
        recorded=F.col("resp_id") % 5 == 0,
        override=F.col("override_name"),
        scorer=F.col("scorer"),
        overrides={"phrase": ck.same_phrase, "number": ck.same_number},
        scorers={("plain", "math"): lambda p, g: F.lower(p) == F.lower(g)},
    )
    return rows.select("resp_id", verdict.alias("correct"))


@query(
    "e16_clean_kwargs",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('{"n":"', CAST(o_custkey AS VARCHAR), '"}') ELSE '{}' END AS first,
       CASE WHEN o_orderkey % 3 = 0 THEN '{"w":"x"}' ELSE '{}' END AS second FROM orders""",
)
def clean_kwargs(v):
    key = F.col("o_orderkey")
    first = F.create_map(F.lit("n"), F.when(key % 2 == 0, F.col("o_custkey").cast("string")), F.lit("z"), F.lit(None).cast("string"))
    second = F.when(key % 3 == 0, F.create_map(F.lit("w"), F.lit("x")))
    cleaned = v.table("orders").select(key.alias("id"), ck.without_nulls(F.array(first, second)).alias("kw"))
    return cleaned.select("id", F.to_json(F.col("kw")[0]).alias("first"), F.to_json(F.col("kw")[1]).alias("second"))


@query(
    "e17_error_taxonomy",
    """WITH w AS (SELECT doc_id, text, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -3 WHEN 3 THEN -4 END AS code FROM documents)
    SELECT doc_id, CASE code WHEN -1 THEN 'Compilation Error' WHEN -2 THEN 'Wrong Answer' WHEN -3 THEN 'Time Limit Exceeded' WHEN -4 THEN 'Runtime Error' END AS error,
      CASE WHEN length(text) <= 300 THEN text ELSE concat(substr(text, 1, 150), '...(truncated) ...', right(text, 150)) END AS shown,
      CASE WHEN length(text) <= 200 THEN text ELSE concat(substr(text, 1, 100), '...(truncated) ...', right(text, 100)) END AS output FROM w""",
)
def error_taxonomy(v):
    k = F.col("doc_id") % 5
    code = F.when(k < 4, -1 - k)
    return verdicts.error_report(v.documents().withColumn("code", code), "code", "text").select(
        "doc_id", "error", "shown", "output"
    )


# --- by the registry ---------------------------------------------------------
_SETS = ["BBH", "HellaSwag", "LCB_v6", "MMLU", "GSM8K", "ARC_C", "TriviaQA", None, "Hybrid_train"]


def _with_dataset(v):
    names = F.array(*[F.lit(n) for n in _SETS])
    return v.f_resp.withColumn("dataset", F.get(names, (F.col("resp_id") % len(_SETS)).cast("int")))


_SQL_SET = f"CASE CAST(resp_id % {len(_SETS)} AS INT) {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(_SETS) if n)} END"
# a dataset's domain where the row has no label
_SQL_REGISTERED = f"""coalesce(CASE domain WHEN 'science' THEN 'mc' ELSE domain END,
    CASE {_SQL_SET} WHEN 'BBH' THEN 'mc' WHEN 'HellaSwag' THEN 'mc' WHEN 'LCB_v6' THEN 'code' WHEN 'MMLU' THEN 'mc' WHEN 'ARC_C' THEN 'mc'
        WHEN 'GSM8K' THEN 'math' WHEN 'TriviaQA' THEN 'triviaqa' END, 'math')"""
_SQL_BY_SET = f"""CASE WHEN {_SQL_SET} = 'BBH' THEN {oa.SQL_PHRASE}
    WHEN {_SQL_SET} = 'HellaSwag' THEN coalesce(upper(nullif(regexp_extract(lower(response), '[abcd]'), '')), '[invalid]')
    WHEN {_SQL_SET} = 'LCB_v6' THEN coalesce({sql_strip(oa.SQL_LAST_BLOCK)}, '{ex.NO_CODE}')
    WHEN {_SQL_REGISTERED} = 'mc' THEN CASE {_SQL_SET} WHEN 'MMLU' THEN {oa.sql_mc_letter('response', 'ABCD')}
        WHEN 'ARC_C' THEN {oa.sql_mc_letter('response', 'ABCDE')} ELSE {oa.sql_mc_letter('response')} END
    WHEN {_SQL_REGISTERED} = 'code' THEN {oa.SQL_CODE}
    WHEN {_SQL_REGISTERED} = 'triviaqa' THEN {oa.sql_short_answer('response')}
    WHEN {_SQL_REGISTERED} = 'livebench' THEN {oa.sql_rstrip(oa.sql_unmarked('response'))}
    ELSE {oa.SQL_MATH} END"""


@query("d18_registry_answers", f"SELECT resp_id, {_SQL_SET} AS dataset, {_SQL_REGISTERED} AS domain, {_SQL_BY_SET} AS answer FROM f_resp")
def registry_answers(v):
    name, label = F.col("dataset"), F.col("domain")
    found = rules.answer(F.col("response"), name, label, F.col("fn_name"))
    return _with_dataset(v).select("resp_id", "dataset", rules.domain(name, label).alias("domain"), found.alias("answer"))


@query(
    "e15_registry_verdicts",
    f"""WITH a AS (SELECT resp_id, gold, {_SQL_SET} AS dataset, {_SQL_REGISTERED} AS domain, {_SQL_BY_SET} AS pred, resp_id % 5 = 0 AS recorded FROM f_resp)
    SELECT resp_id, dataset, coalesce(CASE WHEN dataset = 'BBH' THEN {_sql_phrase('pred')} = {_sql_phrase('gold')}
        WHEN dataset = 'HellaSwag' THEN {sql_letter('pred')} = {sql_letter('gold')}
        WHEN domain = 'mc' THEN {sql_letter('pred')} = {sql_letter('gold')}
        WHEN domain = 'triviaqa' THEN gold <> 'A' AND contains(pred, lower(gold))
        WHEN domain IN ('code', 'livebench') THEN recorded
        ELSE pred = gold END, false) AS correct FROM a""",
)
def registry_verdicts(v):
    name, label = F.col("dataset"), F.col("domain")
    rows = _with_dataset(v)
    rows = rows.select("*", rules.answer(F.col("response"), name, label, F.col("fn_name")).alias("pred"))
    verdict = rules.correct(F.col("pred"), F.array("gold"), name, label, recorded=F.col("resp_id") % 5 == 0)
    return rows.select("resp_id", "dataset", verdict.alias("correct"))


@query(
    "b20_registry_letters",
    f"SELECT resp_id, CASE {_SQL_SET} WHEN 'MMLU' THEN 'ABCD' WHEN 'ARC_C' THEN 'ABCDE' ELSE 'ABCDEFGHIJ' END AS letters FROM f_resp",
)
def registry_letters(v):
    return _with_dataset(v).select("resp_id", rules.letters(F.col("dataset")).alias("letters"))
