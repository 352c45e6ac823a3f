"""Dataset registry: where a dataset lies and how it is prompted and scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.operators import prompts as pm


@dataclass(frozen=True)
class Dataset:
    path: str
    domain: str | None = None
    template: str | None = None
    style: str = "plain"  # plain, by_domain, by_language, trivia, system, prefill, few_shot
    shots: int | None = None
    reformat: bool = False
    letters: str | None = None
    extract: str | None = None
    check: str | None = None
    required: bool = False


def _choice(name: str, **more) -> Dataset:
    return Dataset(f"{name}.json", "mc", pm.CHOICE_ONLY, **more)


def _math(name: str, **more) -> Dataset:
    return Dataset(f"{name}.json", "math", pm.STEP_BY_STEP, **more)


# The evaluation and training sets and their settings.
DATASETS: dict[str, Dataset] = {
    "GSM8K": _math("GSM8K", required=True),
    "MATH500": _math("MATH500", required=True),
    "AIME2024": _math("AIME2024"),
    "AIME2025": _math("AIME2025"),
    "LiveMathBench_Hard": Dataset("LiveMathBench_Hard.json", "math", style="by_language"),
    "MATH_hendrycks": Dataset("__debug_datasets__/hendrycks_math_test.json", "math", pm.STEP_BY_STEP),
    "GSM8K_train": _math("GSM8K_train"),
    "DAPO_Math_17k": _math("DAPO_Math_17k"),
    "DAPO_Math_17k_1k": _math("DAPO_Math_17k_1k"),
    "MATH_train": _math("MATH_train"),
    "MATH_train_traceRL": _math("MATH_train_traceRL"),
    "GPQA_Diamond_shuffled": _choice("GPQA_Diamond_shuffled", reformat=True),
    "GPQA_Main_shuffled": _choice("GPQA_Main_shuffled", reformat=True),
    "BBH": Dataset("BBH.json", "mc", "{question}", extract="phrase", check="phrase"),
    "BBH_3shot": Dataset("BBH.json", "mc", "{question}", style="few_shot", shots=3, extract="phrase", check="phrase"),
    "MMLU": _choice("MMLU", reformat=True, required=True),
    "MMLU_Redux": _choice("MMLU_Redux"),
    "CEval": _choice("CEval"),
    "MMLU_Pro": _choice("MMLU_Pro", reformat=True),
    "HellaSwag": Dataset("HellaSwag.json", "mc", "{question}", reformat=True, extract="ending", check="letter"),
    "HumanEval": Dataset("HumanEval.json", "code", style="prefill", required=True),
    "MBPP": Dataset("MBPP.json", "code", style="prefill"),
    "LCB_v5": Dataset("LCB_v5.json", "code", style="system", extract="last_block"),
    "LCB_v6": Dataset("LCB_v6.json", "code", style="system", extract="last_block"),
    "Codeforces": Dataset("Codeforces.json", "code", pm.STDIN_CODE),
    "PrimeIntellect": Dataset("PrimeIntellect.json", "code", pm.STDIN_CODE),
    "LiveCodeBench": Dataset("LiveCodeBench.json", "code", pm.STDIN_CODE),
    "IFEval": Dataset("IFEval.json", "ifeval"),
    "ARC_C": _choice("ARC_C"),
    "TriviaQA": Dataset("TriviaQA.json", "triviaqa", style="trivia"),
    "MLogiQA": _choice("MLogiQA"),
    "INCLUDE_Lite": _choice("INCLUDE_Lite"),
    "MMMLU_Lite": _choice("MMMLU_Lite"),
    "PolyMath": _math("PolyMath"),
    "MT_AIME2024": _math("MT_AIME2024"),
    "AutoLogi": Dataset("AutoLogi.json", "autologi"),
    "ZebraLogic": Dataset("ZebraLogic.json", "zebralogic"),
    "LiveBench": Dataset("LiveBench.json", "livebench"),
    "Hybrid_train": Dataset("Hybrid_train_new.json", style="by_domain"),
}


def register(name: str, dataset: Dataset) -> None:
    DATASETS[name] = dataset


def setting(name: Column, field: str, datasets: dict[str, Dataset] | None = None) -> Column:
    """A registry setting of the dataset named by a column.

    The registry is code, a few dozen entries, so it is a literal map inside
    the expression and needs no join.
    """
    entries: list[Column] = []
    for key, dataset in (DATASETS if datasets is None else datasets).items():
        value = getattr(dataset, field)
        if value is not None:
            entries += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*entries), name)


def located(rows: DataFrame, name: str, root: str) -> DataFrame:
    """Adds path and domain. Fails on datasets that are not registered."""
    known = ", ".join(sorted(DATASETS))
    path = setting(F.col(name), "path")
    message = F.concat(F.lit("unknown dataset "), F.coalesce(name, F.lit("NULL")), F.lit(f"; known: {known}"))
    checked = F.when(path.isNull(), F.raise_error(message).cast("string")).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path)
    )
    return rows.select("*", checked.alias("path"), setting(F.col(name), "domain").alias("dataset_domain"))


def chat(name: Column, row_domain: Column, subdivision: Column, question: Column) -> Column:
    """Rendered prompt of a row by the settings of its dataset."""
    from rolloom.operators.prepare import reformat_choices

    style = F.coalesce(setting(name, "style"), F.lit("plain"))
    question = F.when(setting(name, "reformat"), reformat_choices(question)).otherwise(question)
    body = (
        F.when(style == "by_domain", pm.by_domain(F.coalesce(row_domain, F.lit("math")), question))
        .when(style == "by_language", pm.by_language(subdivision, question))
        .otherwise(pm.fill(setting(name, "template"), question))
    )
    return (
        F.when(style == "trivia", pm.render(pm.trivia_chat(question)))
        .when(style == "system", pm.render(pm.with_system(pm.CODE_SYSTEM, question)))
        .when(style == "prefill", pm.prefilled(question))
        .otherwise(pm.render(pm.one_turn(body)))
    )


def few_shot_chats(rows: DataFrame, name: str, shots: DataFrame, question: str = "question") -> DataFrame:
    """Adds ``prompt`` for rows whose dataset has worked examples in front.

    ``rows`` have a subject, ``shots`` (subject, rank, q, gold). Every number of
    examples that the registry names is one pass over the rows that need it;
    rows of other styles are not in the result.
    """
    counts = sorted({d.shots for d in DATASETS.values() if d.style == "few_shot" and d.shots})
    parts = []
    for k in counts:
        own = rows.where((setting(F.col(name), "style") == "few_shot") & (setting(F.col(name), "shots") == k))
        lead = pm.few_shot_text(own.withColumn("question", F.col(question)), shots, k)
        parts.append(lead.withColumn("prompt", pm.render(pm.one_turn(F.col("prompt")))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def registry_frame(spark) -> DataFrame:
    rows = [(n, d.path, d.domain, d.required) for n, d in DATASETS.items()]
    return spark.createDataFrame(rows, "dataset string, path string, domain string, required boolean")


def verification(registry: DataFrame, rows: DataFrame, name: str, bad: str) -> DataFrame:
    """Per registered dataset: rows found, unreadable rows, and its status."""
    counts = rows.groupBy(F.col(name).alias("dataset")).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("n_bad")
    )
    n = F.coalesce("n", F.lit(0))
    n_bad = F.coalesce("n_bad", F.lit(0))
    status = (
        F.when((n == 0) & F.col("required"), "missing")
        .when(n == 0, "absent")
        .when(n_bad > 0, "unreadable rows")
        .otherwise("ok")
    )
    return registry.join(counts, "dataset", "left").select(
        "dataset", "required", n.alias("n"), n_bad.alias("n_bad"), status.alias("status")
    )


def require_complete(report: DataFrame) -> None:
    """Raise if a required dataset is missing (at most one row per dataset)."""
    lost = [r["dataset"] for r in report.filter("status = 'missing'").collect()]
    if lost:
        raise ValueError(f"required datasets missing: {lost}")
