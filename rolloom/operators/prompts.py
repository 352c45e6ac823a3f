"""Prompt assembly: templates, chat messages and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions import text as tx

# --- fixed values: template texts --------------------------------------------
STEP_BY_STEP = "{question}\nPlease reason step by step, and put your final answer within \\boxed{{}}."
CHOICE_ONLY = (
    '{question}\nPlease show your choice in the answer field with only the choice letter, e.g., "answer": "C".'
)
STDIN_CODE = (
    "This is the problem:\n{question}\nYou should put your code in ```python ```. "
    "Use input() to read input and print() to produce output in your script. "
)
FUNCTION_CODE = (
    "{question}\nPlace your code within a single Python code block ```python ```. "
    "Do not include more than one code block. "
)
OPTION_ONLY = (
    "This is the problem:\n{question}\nYou need to think step by step and put the final option "
    "(A, B, C, or D only—no other character) in \\boxed{{}}. "
)
DOMAIN_TEMPLATES = {"math": STEP_BY_STEP, "science": CHOICE_ONLY, "code": "{question}", "chat": "{question}"}
MATH_EN = (
    "Here is a math question, please reasoning step by step, and put your answer in \\boxed{{}}.\n{question}\n"
)
MATH_CN = "下面是一个数学问题，请逐步推理，并把最终答案放置于\\boxed{{}}中。\n{question}\n"
WITH_TESTS = (
    "You are an expert Python programmer, and here is your task:\n{question}\n"
    "Your code should pass these tests:\n\n{tests}\n"
    " You should submit your final solution in the following format: ```python\n\n```"
)
TRIVIA_SHOT = ("Q: Where in England was Dame Judi Dench born?", "A: York.")
SUBJECT_HINT = "There is a single choice question about {subject}. Answer the question by replying A, B, C or D."
CODE_SYSTEM = (
    "You are an expert Python programmer. You will be given a question (problem specification) and will "
    "generate a correct Python program that matches the specification and passes all tests. You will NOT "
    "return anything except for the program."
)
FORMAT_STARTER = (
    "You will use the following starter code to write the solution to the problem and enclose your code "
    "within delimiters."
)
FORMAT_STDIN = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on "
    "the sample inputs). Enclose your code within delimiters as follows."
)
ANSWER_FORMAT = "### Answer: (use the provided format with backticks)\n\n"
PREFILL_MARK = "-[[]]-this-is-really-our-highest-priority-[[]]-"
PREFILL_ASK = (
    "Please provide a self-contained Python script that solves the following problem in a markdown code block:"
)
PREFILL_REPLY = (
    "Below is a Python script with a self-contained function that solves the problem and passes "
    "corresponding tests:"
)
_EXECUTION_TASK = (
    "You are given a Python function and an assertion containing an input to the function. Complete the "
    "assertion with a literal (no unsimplified expressions, no function calls) containing the output when "
    "executing the provided code on the given input, even if the function is incorrect or incomplete. Do "
    "NOT output any extra information. "
)
EXECUTION_DIRECT = (
    _EXECUTION_TASK
    + """Provide the full assertion with the correct output in [ANSWER] and [/ANSWER] tags, following the examples.

[PYTHON]
def repeatNumber(number : int) -> int:
    return number
assert repeatNumber(number = 17) == ??
[/PYTHON]
[ANSWER]
assert repeatNumber(number = 17) == 17
[/ANSWER]

[PYTHON]
def addCharacterA(string : str) -> str:
    return string + "a"
assert addCharacterA(string = "x9j") == ??
[/PYTHON]
[ANSWER]
assert addCharacterA(string = "x9j") == "x9ja"
[/ANSWER]

"""
)
EXECUTION_REASONED = (
    _EXECUTION_TASK
    + """Execute the program step by step before arriving at an answer, and provide the full assertion with the correct output in [ANSWER] and [/ANSWER] tags, following the examples.

[PYTHON]
def performOperation(s):
    s = s + s
    return "b" + s + "a"
assert performOperation(s = "hi") == ??
[/PYTHON]
[THOUGHT]
Let's execute the code step by step:

1. The function performOperation is defined, which takes a single argument s.
2. The function is called with the argument "hi", so within the function, s is initially "hi".
3. Inside the function, s is concatenated with itself, so s becomes "hihi".
4. The function then returns a new string that starts with "b", followed by the value of s (which is now "hihi"), and ends with "a".
5. The return value of the function is therefore "bhihia".
[/THOUGHT]
[ANSWER]
assert performOperation(s = "hi") == "bhihia"
[/ANSWER]

"""
)

MESSAGE = "struct<role:string,content:string>"


# --- templates ---------------------------------------------------------------
def fill(template: Column, question: Column) -> Column:
    """``{question}`` filled in, doubled braces as literal ones.

    The question goes in last, so braces inside it are never touched. NULL
    templates pass the question through.
    """
    gap = "\x03"
    shape = tx.replace_all(
        template, [("{{", "\x01"), ("{question}", gap), ("}}", "}"), ("\x01", "{")]
    )
    return F.when(template.isNull(), question).otherwise(F.replace(shape, F.lit(gap), question))


def by_domain(domain: Column, question: Column, templates: dict[str, str] | None = None) -> Column:
    """Template of the row's label; labels without one pass through."""
    out = question
    for name, template in (DOMAIN_TEMPLATES if templates is None else templates).items():
        out = F.when(domain == name, fill(F.lit(template), question)).otherwise(out)
    return out


def by_language(subdivision: Column, question: Column) -> Column:
    chinese = F.endswith(F.coalesce(subdivision, F.lit("")), F.lit("_cn"))
    return F.when(chinese, fill(F.lit(MATH_CN), question)).otherwise(fill(F.lit(MATH_EN), question))


def with_tests(question: Column, tests: Column) -> Column:
    """The task together with the assertions it must pass (an array)."""
    listing = F.coalesce(F.array_join(tests, "\n"), F.lit(""))
    head, tail = WITH_TESTS.split("{tests}")
    return F.concat(fill(F.lit(head), question), listing, F.lit(tail))


# --- messages ----------------------------------------------------------------
def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def one_turn(content: Column) -> Column:
    return F.array(message("user", content))


def trivia_chat(question: Column) -> Column:
    ask, reply = TRIVIA_SHOT
    return F.array(
        message("user", F.lit(ask)),
        message("assistant", F.lit(reply)),
        message("user", F.concat(F.lit("Q: "), question)),
    )


def with_system(system: str, question: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", question))


def render(messages: Column, open_reply: bool = True, reply_lead: str = "") -> Column:
    """Chat markup of a message list, with the header of the next reply."""
    turns = F.transform(
        messages,
        lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")),
    )
    header = "<|im_start|>assistant" + (reply_lead or "") + "\n" if open_reply else ""
    return F.concat(F.array_join(turns, ""), F.lit(header))


def prefilled(question: Column) -> Column:
    """Chat that ends inside the reply's code block."""
    ask = F.concat(F.lit(PREFILL_ASK + "\n```\n"), tx.strip(question), F.lit("\n```\n"))
    reply = F.lit(f"{PREFILL_REPLY}\n```python\n{PREFILL_MARK}\n```\n")
    chat = F.array(message("user", ask), message("assistant", reply))
    return tx.before(render(chat, open_reply=False), PREFILL_MARK)


# --- few-shot ----------------------------------------------------------------
def _first_examples(shots: DataFrame, group: str, k: int, columns: list[str]) -> DataFrame:
    """The first k examples of each group, as one ordered array.

    The rank filter is applied before the shuffle as well, so no task holds
    more than k rows of a group per input partition, however large the pool.
    """
    w = Window.partitionBy(group).orderBy("rank")
    first = shots.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", *columns))).alias("shots"))


def subject_block(subject: Column, question: Column, options: Column) -> Column:
    """Hint, question and lettered options (an array, empty for none)."""
    hint = F.replace(F.lit(SUBJECT_HINT), F.lit("{subject}"), F.replace(subject, F.lit("_"), F.lit(" ")))
    lettered = F.transform(
        options, lambda o, i: F.concat(F.lit("\n"), F.char(i + ord("A")), F.lit(". "), F.coalesce(o, F.lit("")))
    )
    return F.concat(hint, F.lit("\nQuestion: "), question, F.array_join(lettered, ""), F.lit("\nAnswer:"))


def few_shot_chat(questions: DataFrame, shots: DataFrame, k: int = 5) -> DataFrame:
    """Per-subject examples as chat turns in front of each question.

    ``questions`` has (subject, question, options), ``shots`` (subject, rank,
    q, options, gold); options are arrays of texts. Subjects without examples
    get the question alone.
    """
    pool = _first_examples(shots, "subject", k, ["q", "options", "gold"])
    name = F.col("subject").cast("string")
    none = F.array().cast("array<struct<n:int,q:string,options:array<string>,gold:string>>")
    turns = F.flatten(
        F.transform(
            F.coalesce("shots", none),
            lambda s: F.array(
                message("user", subject_block(name, s["q"], s["options"])), message("assistant", s["gold"])
            ),
        )
    )
    ask = F.array(message("user", subject_block(name, F.col("question"), F.col("options"))))
    joined = questions.join(pool, "subject", "left")
    return joined.withColumn("messages", F.concat(turns, ask)).drop("shots")


def few_shot_text(questions: DataFrame, shots: DataFrame, k: int = 3) -> DataFrame:
    """Worked examples as text in front of each question."""
    pool = _first_examples(shots, "subject", k, ["q", "gold"])
    lead = F.array_join(
        F.transform(
            "shots",
            lambda s: F.concat(F.lit("Q: "), s["q"], F.lit("\nA: Let's think step by step.\n"), s["gold"], F.lit("\n\n")),
        ),
        "",
    )
    ask = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: Let's think step by step.\n"))
    joined = questions.join(pool, "subject", "left")
    return joined.withColumn("prompt", F.concat(F.coalesce(lead, F.lit("")), ask)).drop("shots")


# --- code prompts ------------------------------------------------------------
def code_question(content: Column, starter: Column) -> Column:
    with_starter = F.concat(F.lit(f"### Format: {FORMAT_STARTER}\n```python\n"), starter, F.lit("\n```\n\n"))
    plain = F.lit(f"### Format: {FORMAT_STDIN}\n```python\n# YOUR CODE HERE\n```\n\n")
    form = F.when(F.length(starter) > 0, with_starter).otherwise(plain)
    return F.concat(F.lit("### Question:\n"), content, F.lit("\n\n"), form, F.lit(ANSWER_FORMAT))


def by_test_method(method: Column, question: Column, prefix: Column) -> Column:
    """Standard-input wording, or the function's header behind the prompt."""
    stdin = render(one_turn(fill(F.lit(STDIN_CODE), question)))
    function = F.concat(render(one_turn(fill(F.lit(FUNCTION_CODE), question))), prefix)
    return F.when(method == "stdio", stdin).otherwise(function)


def test_completion(content: Column, starter: Column, test_input: Column) -> Column:
    name = tx.first_match(starter, rf"def{tx.ws()}+([{tx.WORD}]+){tx.ws()}*\(")
    call = F.concat(F.lit("assert "), name, F.lit("("), F.replace(test_input, F.lit("\n"), F.lit(", ")), F.lit(") == # TODO"))
    return F.concat(
        F.lit("Problem:\n"), content, F.lit("Function:\n```\n"), starter, F.lit("\n```\n"),
        F.lit("Please complete the following test case:\n\n```\n"), call, F.lit("\n```\n"),
    )


def repair_note(code: Column, error: Column, inputs: Column, output: Column, expected: Column) -> Column:
    """What went wrong, worded by error code; nothing without a code.

    Missing fields are empty; an unknown code fails the job.
    """
    lead = "The above code is incorrect and got "
    lit = F.lit
    error, inputs, output, expected = (F.coalesce(c, lit("")) for c in (error, inputs, output, expected))
    return (
        F.when(code.isNull(), "")
        .when(code == -1, F.concat(lit(lead + "the following compilation error.\n"), error))
        .when(
            code == -2,
            F.concat(lit(lead + "a wrong answer.\nInput: "), inputs, lit("\nGenerated Output: "), output,
                     lit("\nExpected: "), expected),
        )
        .when(
            code == -3,
            F.concat(lit(lead + "time limit exceeded.\n"), error, lit("\nInput: "), inputs, lit("\nExpected: "), expected),
        )
        .when(
            code == -4,
            F.concat(lit(lead + "a runtime error.\nInput: "), inputs, lit("\nExpected: "), expected, lit("\n"), error),
        )
        .otherwise(F.raise_error(F.concat(lit("unknown error code "), code.cast("string"))))
    )


def repair_prompts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Prompt that shows a candidate its first failing test.

    ``candidates`` has (sample_id, resp_idx, question, code); ``verdicts`` the
    recorded tests with the ``error`` text of each. The first failure is a
    partial aggregate, so a candidate with very many tests shuffles one row per
    task.
    """
    keys = ["sample_id", "resp_idx"]
    detail = F.struct("error_code", "error", "inputs", "output", "expected")
    failing = (
        verdicts.filter(F.col("error_code").isNotNull()).groupBy(*keys).agg(F.min_by(detail, "test_idx").alias("v"))
    )
    note = repair_note(*[F.col(f"v.{c}") for c in ("error_code", "error", "inputs", "output", "expected")])
    prompt = F.concat(
        F.lit("### Question:\n"), F.col("question"), F.lit("\n\n### Answer:\n```python\n"), F.col("code"),
        F.lit("\n```\n\n"), note, F.lit(f"\n### Format: {FORMAT_STDIN}\n```python\n# YOUR CODE HERE\n```\n\n"),
        F.lit(ANSWER_FORMAT),
    )
    return candidates.join(failing, keys, "left").select(*keys, prompt.alias("prompt"))


def execution_prompt(code: Column, call: Column, reasoned: Column) -> Column:
    """Ask for the output of a call, with or without reasoning."""
    body = F.concat(F.lit("[PYTHON]\n"), code, F.lit("\nassert "), call, F.lit(" == ??\n[/PYTHON]\n"))
    return F.when(reasoned, F.concat(F.lit(EXECUTION_REASONED), body, F.lit("[THOUGHT]\n"))).otherwise(
        F.concat(F.lit(EXECUTION_DIRECT), body, F.lit("[ANSWER]\n"))
    )


def replicate(prompts: DataFrame, k: int) -> DataFrame:
    """Each prompt k times, numbered by ``resp_idx``."""
    return prompts.withColumn("resp_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
