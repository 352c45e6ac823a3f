"""Prompt assembly over questions (family C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import prompts as pm
from rolloom.operators.prepare import strip_instruction
from rolloom.plans.base import query
from rolloom.plans.on_answers import S, sql_strip
from rolloom.plans.on_preparation import sql_text


def sql_fill(template: str, question: str) -> str:
    """The filled template as a SQL expression."""
    parts = template.replace("{{", "\x01").split("{question}")
    texts = [sql_text(p.replace("}}", "}").replace("\x01", "{")) for p in parts]
    return "concat(" + f", {question}, ".join(texts) + ")"


@query(
    "c01_format_template",
    f"SELECT id, CASE WHEN id % 3 = 0 THEN input ELSE {sql_fill(pm.STEP_BY_STEP, 'input')} END AS prompt FROM f_mix",
)
def format_template(v):
    template = F.when(F.col("id") % 3 != 0, F.lit(pm.STEP_BY_STEP))
    return v.f_mix.select("id", pm.fill(template, F.col("input")).alias("prompt"))


@query(
    "c02_template_by_domain",
    f"""SELECT id, CASE domain WHEN 'math' THEN {sql_fill(pm.STEP_BY_STEP, 'input')} WHEN 'science' THEN {sql_fill(pm.CHOICE_ONLY, 'input')}
        ELSE input END AS prompt FROM f_mix""",
)
def template_by_domain(v):
    return v.f_mix.select("id", pm.by_domain(F.col("domain"), F.col("input")).alias("prompt"))


@query(
    "c03_template_by_language",
    f"""SELECT id, CASE WHEN subdivision LIKE '%\\_cn' ESCAPE '\\' THEN {sql_fill(pm.MATH_CN, 'input')} ELSE {sql_fill(pm.MATH_EN, 'input')} END AS prompt
        FROM f_mix""",
)
def template_by_language(v):
    return v.f_mix.select("id", pm.by_language(F.col("subdivision"), F.col("input")).alias("prompt"))


_TESTS_HEAD, _TESTS_TAIL = pm.WITH_TESTS.split("{tests}")


@query(
    "c04_template_with_tests",
    f"""SELECT sample_id, concat({sql_fill(_TESTS_HEAD, 'question')}, 'assert f(1) == 2', chr(10), 'assert ', prefix, {sql_text(_TESTS_TAIL)}) AS prompt
        FROM f_tests""",
)
def template_with_tests(v):
    tests = F.array(F.lit("assert f(1) == 2"), F.concat(F.lit("assert "), F.col("prefix")))
    return v.f_tests.select("sample_id", pm.with_tests(F.col("question"), tests).alias("prompt"))


def sql_turn(role: str, content: str) -> str:
    return f"concat('<|im_start|>{role}', chr(10), {content}, '<|im_end|>', chr(10))"


HEADER = "'<|im_start|>assistant' || chr(10)"


@query(
    "c05_trivia_chat",
    f"""SELECT id, concat({sql_turn('user', sql_text(pm.TRIVIA_SHOT[0]))}, {sql_turn('assistant', sql_text(pm.TRIVIA_SHOT[1]))},
        {sql_turn('user', "concat('Q: ', input)")}, {HEADER}) AS prompt FROM f_mix""",
)
def trivia_chat(v):
    return v.f_mix.select("id", pm.render(pm.trivia_chat(F.col("input"))).alias("prompt"))


def _questions(v):
    return v.documents().select(
        "doc_id",
        (F.col("doc_id") % 6).cast("int").alias("subject"),
        F.col("text").alias("question"),
        F.array("lang", "source", F.lit("x"), F.lit(None).cast("string")).alias("options"),
    )


def _sql_block(question: str, a: str, b: str) -> str:
    head, tail = pm.SUBJECT_HINT.split("{subject}")
    return f"""concat({sql_text(head)}, CAST(subject AS VARCHAR), {sql_text(tail)}, chr(10), 'Question: ', {question}, chr(10), 'A. ', {a},
        chr(10), 'B. ', {b}, chr(10), 'C. x', chr(10), 'D. ', chr(10), 'Answer:')"""


@query(
    "c06_few_shot_chat",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rank) AS n FROM f_shot),
      pool AS (SELECT subject, string_agg(concat({sql_turn('user', _sql_block('q', 'gold', 'CAST(rank AS VARCHAR)'))}, {sql_turn('assistant', 'gold')}), '' ORDER BY n) AS shots
        FROM r WHERE n <= 5 GROUP BY subject),
      ask AS (SELECT doc_id, CAST(doc_id % 6 AS INT) AS subject, text, lang, source FROM documents)
    SELECT a.doc_id, concat(coalesce(p.shots, ''), {sql_turn('user', _sql_block('text', 'lang', 'source').replace('subject AS', 'a.subject AS'))}, {HEADER}) AS prompt
    FROM ask a LEFT JOIN pool p ON p.subject = a.subject""",
)
def few_shot_chat(v):
    options = F.array("gold", F.col("rank").cast("string"), F.lit("x"), F.lit(None).cast("string"))
    chats = pm.few_shot_chat(_questions(v), v.f_shot.withColumn("options", options))
    return chats.select("doc_id", pm.render(F.col("messages")).alias("prompt"))


@query(
    "c07_few_shot_text",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rank) AS n FROM f_shot),
      pool AS (SELECT subject, string_agg(concat('Q: ', q, chr(10), 'A: Let''s think step by step.', chr(10), gold, chr(10), chr(10)), '' ORDER BY n) AS shots
        FROM r WHERE n <= 3 GROUP BY subject)
    SELECT d.doc_id, concat(coalesce(p.shots, ''), 'Q: ', d.text, chr(10), 'A: Let''s think step by step.', chr(10)) AS prompt
    FROM documents d LEFT JOIN pool p ON p.subject = CAST(d.doc_id % 6 AS INT)""",
)
def few_shot_text(v):
    return pm.few_shot_text(_questions(v), v.f_shot).select("doc_id", "prompt")


@query(
    "c08_chat_rendering",
    f"""SELECT conv_id, turn, concat({sql_turn("' || role || '", 'text')}, '<|im_start|>assistant<think>', chr(10)) AS prompt FROM conversations""",
)
def chat_rendering(v):
    chat = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    return v.table("conversations").select(
        "conv_id", "turn", pm.render(chat, reply_lead="<think>").alias("prompt")
    )


@query(
    "c09_system_prompt",
    f"""SELECT id, concat({sql_turn('system', sql_text(pm.CODE_SYSTEM))}, {sql_turn('user', 'content')}, {HEADER}) AS prompt FROM f_date""",
)
def system_prompt(v):
    return v.f_date.select("id", pm.render(pm.with_system(pm.CODE_SYSTEM, F.col("content"))).alias("prompt"))


SQL_PREFILLED = f"""concat('<|im_start|>user', chr(10), {sql_text(pm.PREFILL_ASK)}, chr(10), '```', chr(10), {sql_strip('input')}, chr(10), '```', chr(10),
    '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), {sql_text(pm.PREFILL_REPLY)}, chr(10), '```python', chr(10))"""


@query("c10_prefilled_reply", f"SELECT id, {SQL_PREFILLED} AS prompt FROM f_mix")
def prefilled_reply(v):
    return v.f_mix.select("id", pm.prefilled(F.col("input")).alias("prompt"))


@query(
    "c11_route_by_method",
    f"""SELECT sample_id, CASE WHEN test_method = 'stdio' THEN concat({sql_turn('user', sql_fill(pm.STDIN_CODE, 'question'))}, {HEADER})
        ELSE concat({sql_turn('user', sql_fill(pm.FUNCTION_CODE, 'question'))}, {HEADER}, prefix) END AS prompt FROM f_tests""",
)
def route_by_method(v):
    c = F.col
    return v.f_tests.select("sample_id", pm.by_test_method(c("test_method"), c("question"), c("prefix")).alias("prompt"))


@query("c12_option_prompt", f"SELECT id, concat({sql_turn('user', sql_fill(pm.OPTION_ONLY, 'input'))}, {HEADER}) AS prompt FROM f_mix")
def option_prompt(v):
    body = pm.fill(F.lit(pm.OPTION_ONLY), F.col("input"))
    return v.f_mix.select("id", pm.render(pm.one_turn(body)).alias("prompt"))


@query(
    "c13_test_completion",
    rf"""SELECT id, concat('Problem:', chr(10), content, 'Function:', chr(10), '```', chr(10), starter_code, chr(10), '```', chr(10),
        'Please complete the following test case:', chr(10), chr(10), '```', chr(10), 'assert ', regexp_extract(starter_code, 'def[{S}]+([\p{{L}}\p{{N}}_]+)[{S}]*\(', 1),
        '(', CAST(id AS VARCHAR), ', 2) == # TODO', chr(10), '```', chr(10)) AS prompt FROM f_date WHERE starter_code <> ''""",
)
def test_completion(v):
    rows = v.f_date.filter(F.col("starter_code") != "")
    given = F.concat(F.col("id").cast("string"), F.lit("\n2"))
    return rows.select("id", pm.test_completion(F.col("content"), F.col("starter_code"), given).alias("prompt"))


_LEAD = "'The above code is incorrect and got "


@query(
    "c14_repair_prompt",
    f"""WITH bad AS (SELECT *, row_number() OVER (PARTITION BY sample_id, resp_idx ORDER BY test_idx) AS n FROM f_verd WHERE error_code IS NOT NULL),
      cand AS (SELECT DISTINCT sample_id, resp_idx FROM f_verd)
    SELECT c.sample_id, c.resp_idx, concat('### Question:', chr(10), 'Task ', CAST(c.sample_id AS VARCHAR), chr(10), chr(10), '### Answer:', chr(10), '```python', chr(10),
      'print(', CAST(c.resp_idx AS VARCHAR), ')', chr(10), '```', chr(10), chr(10),
      CASE b.error_code WHEN -1 THEN concat({_LEAD}the following compilation error.', chr(10), coalesce(b.error, ''))
        WHEN -2 THEN concat({_LEAD}a wrong answer.', chr(10), 'Input: ', coalesce(b.inputs, ''), chr(10), 'Generated Output: ', coalesce(b.output, ''), chr(10), 'Expected: ', coalesce(b.expected, ''))
        WHEN -3 THEN concat({_LEAD}time limit exceeded.', chr(10), coalesce(b.error, ''), chr(10), 'Input: ', coalesce(b.inputs, ''), chr(10), 'Expected: ', coalesce(b.expected, ''))
        WHEN -4 THEN concat({_LEAD}a runtime error.', chr(10), 'Input: ', coalesce(b.inputs, ''), chr(10), 'Expected: ', coalesce(b.expected, ''), chr(10), coalesce(b.error, '')) ELSE '' END,
      chr(10), {sql_text('### Format: ' + pm.FORMAT_STDIN)}, chr(10), '```python', chr(10), '# YOUR CODE HERE', chr(10), '```', chr(10), chr(10),
      {sql_text(pm.ANSWER_FORMAT)}) AS prompt
    FROM cand c LEFT JOIN bad b ON b.sample_id = c.sample_id AND b.resp_idx = c.resp_idx AND b.n = 1""",
)
def repair_prompt(v):
    verdicts = v.f_verd
    candidates = (
        verdicts.select("sample_id", "resp_idx")
        .distinct()
        .select(
            "sample_id",
            "resp_idx",
            F.concat(F.lit("Task "), F.col("sample_id").cast("string")).alias("question"),
            F.concat(F.lit("print("), F.col("resp_idx").cast("string"), F.lit(")")).alias("code"),
        )
    )
    return pm.repair_prompts(candidates, verdicts)


@query(
    "c15_execution_prompt",
    f"""SELECT sample_id, concat(CASE WHEN sample_id % 2 = 0 THEN {sql_text(pm.EXECUTION_REASONED)} ELSE {sql_text(pm.EXECUTION_DIRECT)} END,
      '[PYTHON]', chr(10), prefix, chr(10), 'assert ', question, ' == ??', chr(10), '[/PYTHON]', chr(10),
      CASE WHEN sample_id % 2 = 0 THEN '[THOUGHT]' ELSE '[ANSWER]' END, chr(10)) AS prompt FROM f_tests""",
)
def execution_prompt(v):
    prompt = pm.execution_prompt(F.col("prefix"), F.col("question"), F.col("sample_id") % 2 == 0)
    return v.f_tests.select("sample_id", prompt.alias("prompt"))


@query(
    "c16_replicate_prompts",
    "SELECT id, domain, CAST(k AS INT) AS resp_idx FROM f_mix, (SELECT unnest(range(0, 4)) AS k) r",
)
def replicate_prompts(v):
    return pm.replicate(v.f_mix.select("id", "domain"), 4)
