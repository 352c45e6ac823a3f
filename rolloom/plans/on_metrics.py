"""Rewards, accuracy and metric roll-ups (family G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import extract as ex
from rolloom.operators import metrics as mt
from rolloom.operators import rewards as rw
from rolloom.operators import verdicts as vd
from rolloom.operators.prepare import resolve_domain
from rolloom.plans.base import query
from rolloom.plans.on_answers import sql_mc_letter
from rolloom.plans.on_reshape import sql_paired
from rolloom.plans.on_scores import sql_letter


def r9(c):
    return F.round(c, 9)


_CAP = 2000
_SQL_CAPPED = f"correct AND NOT (n_tokens >= {_CAP} - 5)"


def _capped(v):
    return v.f_roll.withColumn("correct_capped", rw.capped(F.col("correct"), F.col("n_tokens"), F.lit(_CAP)))


_SQL_Z = f"""SELECT sample_id, resp_idx, response, n_tokens, round(coalesce((CAST(x AS DOUBLE) - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 9) AS reward
    FROM (SELECT *, CASE WHEN {_SQL_CAPPED} THEN 1 ELSE 0 END AS x FROM f_roll) q WINDOW w AS (PARTITION BY sample_id)"""


def _rewarded(v):
    rows = _capped(v).withColumn("x", F.col("correct_capped").cast("int"))
    return rw.z_scored(rows, "sample_id", "x").withColumn("reward", r9(F.col("reward")))


@query("g01_z_scored_reward", f"SELECT sample_id, resp_idx, reward FROM ({_SQL_Z}) z")
def z_scored(v):
    return _rewarded(v).select("sample_id", "resp_idx", "reward")


@query(
    "g02_cap_penalty",
    f"""SELECT sample_id, resp_idx, correct, {_SQL_CAPPED} AS capped, correct AS uncapped FROM f_roll""",
)
def cap_penalty(v):
    none = rw.capped(F.col("correct"), F.col("n_tokens"), F.lit(-1))
    return _capped(v).select(
        "sample_id", "resp_idx", "correct", F.col("correct_capped").alias("capped"), none.alias("uncapped")
    )


# The filter sees the same verdicts as the rewards: those after the penalty.
_SQL_SHARE = f"SELECT sample_id, avg(CASE WHEN {_SQL_CAPPED} THEN 1 ELSE 0 END) AS share, count(*) AS n FROM f_roll GROUP BY sample_id"


@query(
    "g03_difficulty_filter",
    f"SELECT r.sample_id, r.resp_idx FROM f_roll r JOIN ({_SQL_SHARE}) s ON s.sample_id = r.sample_id WHERE s.share BETWEEN 0.2 AND 0.8",
)
def difficulty_filter(v):
    rows = _capped(v).select("sample_id", "resp_idx", "correct_capped")
    return rw.by_difficulty(rows, "sample_id", "correct_capped").select("sample_id", "resp_idx")


@query(
    "g03_difficulty_report",
    f"""SELECT count(*) FILTER (WHERE share BETWEEN 0.2 AND 0.8) AS kept, count(*) AS total,
        coalesce(sum(n) FILTER (WHERE share BETWEEN 0.2 AND 0.8), 0)::BIGINT AS samples FROM ({_SQL_SHARE}) s""",
)
def difficulty_report(v):
    return rw.difficulty_report(_capped(v), "sample_id", "correct_capped")


@query(
    "g04_training_records",
    f"""SELECT sample_id, resp_idx, concat('Q', CAST(sample_id AS VARCHAR)) AS prompt, CAST(sample_id AS VARCHAR) AS question, reward,
        CAST(length(response) AS INT) AS response_chars, 3 AS steps FROM ({_SQL_Z}) z""",
)
def training_records(v):
    rows = _rewarded(v).select(
        "sample_id",
        "resp_idx",
        F.concat(F.lit("Q"), F.col("sample_id").cast("string")).alias("prompt"),
        F.col("sample_id").cast("string").alias("question"),
        "reward",
        "response",
        F.array(F.lit(0), F.lit(0), F.lit(1)).alias("step_map"),
    )
    return rw.training_records(rows).select(
        "sample_id", "resp_idx", "prompt", "question", "reward",
        F.length("response").alias("response_chars"), F.size("step_map").alias("steps"),
    )


_SQL_DOM = "coalesce(CASE domain WHEN 'science' THEN 'mc' ELSE domain END, 'math')"


def _scored(v):
    rows = v.f_roll.withColumn("domain", resolve_domain(F.col("domain")))
    return rows.withColumn("scorable", (F.col("domain") != "chat") & F.col("labelled"))


@query(
    "g05_accuracy_grouping_sets",
    f"""WITH s AS (SELECT {_SQL_DOM} AS domain, category, subdivision, correct FROM f_roll WHERE {_SQL_DOM} <> 'chat' AND labelled),
      g AS (SELECT 'all' AS level, NULL AS label, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n FROM s
        UNION ALL SELECT 'domain', domain, count(*) FILTER (WHERE correct), count(*) FROM s GROUP BY domain
        UNION ALL SELECT 'category', category, count(*) FILTER (WHERE correct), count(*) FROM s WHERE category IS NOT NULL GROUP BY category
        UNION ALL SELECT 'subdivision', subdivision, count(*) FILTER (WHERE correct), count(*) FROM s WHERE subdivision IS NOT NULL
          AND (SELECT count(DISTINCT subdivision) FROM s) > 1 GROUP BY subdivision)
      SELECT level, label, n_correct, n, round(n_correct / greatest(n, 1), 9) AS accuracy FROM g""",
)
def accuracy(v):
    return rw.accuracy(_scored(v)).withColumn("accuracy", r9(F.col("accuracy")))


@query(
    "g06_length_and_scorable",
    f"""SELECT round(avg(n_tokens), 6) AS mean_length, round(count(*) FILTER (WHERE {_SQL_DOM} <> 'chat' AND labelled) / count(*), 9) AS scorable_share FROM f_roll""",
)
def length_report(v):
    return rw.length_report(_scored(v)).select(
        F.round("mean_length", 6).alias("mean_length"), r9(F.col("scorable_share")).alias("scorable_share")
    )


@query(
    "g07_tokens_per_step",
    "SELECT round(avg(len(step_map) / len(list_distinct(step_map))), 9) AS tokens_per_step FROM f_step WHERE len(step_map) > 0",
)
def tokens_per_step(v):
    return rw.tokens_per_step(v.f_step).select(r9(F.col("tokens_per_step")).alias("tokens_per_step"))


@query(
    "g08_reward_report",
    f"""SELECT round(avg(reward), 9) + 0 AS mean, min(reward) AS least, max(reward) AS most, round(stddev_pop(reward), 9) AS deviation FROM ({_SQL_Z}) z""",
)
def reward_report(v):
    return rw.reward_report(_rewarded(v)).select(
        (r9(F.col("mean")) + 0).alias("mean"), "least", "most", r9(F.col("deviation")).alias("deviation")
    )


_SQL_CAND = """SELECT sample_id, resp_idx, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_tests, bool_and(passed) AS solved
    FROM f_verd GROUP BY sample_id, resp_idx"""


@query("g09_code_reward", _SQL_CAND)
def code_reward(v):
    return vd.per_candidate(v.f_verd)


@query(
    "g09_task_accuracy",
    f"SELECT count(*) FILTER (WHERE solved) AS solved, count(*) AS tasks, round(avg(CASE WHEN solved THEN 1 ELSE 0 END), 9) AS accuracy FROM ({_SQL_CAND}) c",
)
def task_accuracy(v):
    return vd.per_candidate(v.f_verd).agg(
        F.count_if("solved").alias("solved"),
        F.count("*").alias("tasks"),
        r9(F.avg(F.col("solved").cast("int"))).alias("accuracy"),
    )


_SQL_NC = f"SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE solved) AS c FROM ({_SQL_CAND}) q GROUP BY sample_id"


def _sql_pass(k: int) -> str:
    """One minus the product over the correct samples, in log-free form."""
    return f"""CASE WHEN n - c < {k} THEN 100.0 WHEN c = 0 THEN 0.0 ELSE 100.0 * (1.0 - (SELECT product(1.0 - {k} / i) FROM (SELECT unnest(range(n - c + 1, n + 1)) AS i) r)) END"""


@query(
    "g10_pass_at_k_by_problem",
    f"SELECT sample_id, n, c, round({_sql_pass(1)}, 9) AS pass_1, round({_sql_pass(3)}, 9) AS pass_3 FROM ({_SQL_NC}) p",
)
def pass_by_problem(v):
    problems = vd.per_problem(vd.per_candidate(v.f_verd))
    n, c = F.col("n"), F.col("c")
    return problems.select(
        "sample_id", "n", "c", r9(vd.pass_at(n, c, 1)).alias("pass_1"), r9(vd.pass_at(n, c, 3)).alias("pass_3")
    )


@query(
    "g10_pass_at_k",
    f"""WITH p AS ({_SQL_NC}) SELECT k, value FROM (
        SELECT 1 AS k, round(avg({_sql_pass(1)}), 9) AS value, min(n) AS least FROM p
        UNION ALL SELECT 5, round(avg({_sql_pass(5)}), 9), min(n) FROM p
        UNION ALL SELECT 50, round(avg({_sql_pass(50)}), 9), min(n) FROM p) x WHERE least >= k""",
)
def pass_table(v):
    problems = vd.per_problem(vd.per_candidate(v.f_verd))
    return vd.pass_at_table(problems, [1, 5, 50]).select("k", r9(F.col("value")).alias("value"))


@query(
    "g11_instance_grades",
    f"SELECT sample_id, CAST(resp_idx // 4 AS INT) AS part, string_agg(CASE WHEN solved THEN '1' ELSE '0' END, '' ORDER BY resp_idx) AS grades FROM ({_SQL_CAND}) c GROUP BY sample_id, resp_idx // 4",
)
def instance_grades(v):
    from rolloom.operators.reshape import regroup

    grades = regroup(vd.per_candidate(v.f_verd), "sample_id", "resp_idx", ["solved"], part_size=4)
    bits = F.transform("solved", lambda s: F.when(s, "1").otherwise("0"))
    return grades.select("sample_id", "part", F.array_join(bits, "").alias("grades")).orderBy("sample_id", "part")


@query(
    "g12_results_by_problem",
    f"SELECT sample_id, CAST(resp_idx // 3 AS INT) AS part, string_agg(concat(CAST(n_passed AS VARCHAR), '/', CAST(n_tests AS VARCHAR)), ' ' ORDER BY resp_idx) AS results FROM ({_SQL_CAND}) c GROUP BY sample_id, resp_idx // 3",
)
def results_by_problem(v):
    from rolloom.operators.reshape import regroup

    rows = vd.per_candidate(v.f_verd).withColumn(
        "result", F.concat(F.col("n_passed").cast("string"), F.lit("/"), F.col("n_tests").cast("string"))
    )
    grouped = regroup(rows, "sample_id", "resp_idx", ["result"], part_size=3)
    return grouped.select("sample_id", "part", F.array_join("result", " ").alias("results"))


@query(
    "g13_first_candidate_by_platform",
    """WITH c AS (SELECT sample_id, min(platform) AS platform, bool_and(passed) AS solved FROM f_verd WHERE resp_idx = 0 GROUP BY sample_id)
       SELECT coalesce(platform, 'unknown') AS platform, count(*) FILTER (WHERE solved) AS solved, count(*) AS n,
         round(100 * count(*) FILTER (WHERE solved) / count(*), 9) AS accuracy FROM c GROUP BY 1""",
)
def first_by_platform(v):
    return vd.first_candidate_by_platform(v.f_verd).withColumn("accuracy", r9(F.col("accuracy")))


@query(
    "g14_base_plus_summary",
    """WITH c AS (SELECT sample_id, resp_idx, bool_and(passed) AS base, bool_and(passed AND score > 5) AS plus FROM f_verd GROUP BY 1, 2)
       SELECT round(avg(CASE WHEN base THEN 1 ELSE 0 END), 9) AS base, round(avg(CASE WHEN plus THEN 1 ELSE 0 END), 9) AS plus FROM c""",
)
def base_plus(v):
    rows = v.f_verd.groupBy("sample_id", "resp_idx").agg(
        F.bool_and("passed").alias("base_pass"), F.bool_and(F.col("passed") & (F.col("score") > 5)).alias("plus_pass")
    )
    return vd.base_plus_summary(rows).select(r9(F.col("base")).alias("base"), r9(F.col("plus")).alias("plus"))


@query(
    "g14_first_recorded_pair",
    """WITH c AS (SELECT sample_id, min(score) AS base, max(score) AS plus FROM f_verd WHERE platform IS NOT NULL GROUP BY sample_id)
       SELECT round(base, 9) AS base, round(plus, 9) AS plus FROM c ORDER BY sample_id LIMIT 1""",
)
def first_pair(v):
    """Only problems of a known platform have a recorded pair."""
    pair = F.when(F.count("platform") > 0, F.struct(F.min("score").alias("base"), F.max("score").alias("plus")))
    items = v.f_verd.groupBy("sample_id").agg(pair.alias("recorded"))
    return vd.first_recorded_pair(items, "sample_id").select(r9(F.col("base")).alias("base"), r9(F.col("plus")).alias("plus"))


@query("g15_domain_counts", "SELECT domain, count(*) AS n FROM f_mix GROUP BY domain")
def domain_counts(v):
    return mt.label_counts(v.f_mix, "domain")


@query(
    "g16_best_accuracy",
    f"""WITH {sql_paired('train step:')} SELECT round(avg(acc), 9) AS mean_best, count(*) AS datasets FROM (
        SELECT split_part(dataset, '_', 2)::BIGINT % 50 AS d, max(acc) AS acc FROM paired WHERE step = 2 GROUP BY 1) x""",
)
def best_accuracy(v):
    results = mt.paired_results(v.f_log, "train step:")
    series = (F.split_part("dataset", F.lit("_"), F.lit(2)).cast("bigint") % 50).alias("dataset")
    return mt.best_accuracy(results.select(series, "step", "acc"), 2).select(
        r9(F.col("mean_best")).alias("mean_best"), "datasets"
    )


@query(
    "g17_latest_run",
    """SELECT grp, arg_max(run, mtime) AS run, arg_max(current_epoch, mtime) AS step FROM f_runs WHERE current_epoch IS NOT NULL GROUP BY grp""",
)
def latest_run(v):
    return mt.latest_run(v.f_runs, group="grp", prefix="Supplier")


@query(
    "g17_resume_plan",
    """SELECT run, coalesce(current_epoch IS NOT NULL AND has_config AND (has_weights OR has_adapter), false) AS resume,
       CASE WHEN current_epoch IS NOT NULL AND has_config AND (has_weights OR has_adapter) THEN current_epoch + 1 END AS next_step FROM f_runs""",
)
def resume_plan(v):
    return mt.resume_plan(v.f_runs)


@query(
    "g18_loss_by_masked_share",
    """SELECT CAST(round_even(m * 10 / n, 0) AS INT) AS tenth, round(avg(loss), 9) AS loss, count(*) AS n FROM (
         SELECT CAST(l_linenumber AS DOUBLE) AS m, CAST(l_linenumber + l_quantity AS DOUBLE) AS n, l_extendedprice / 1000 AS loss FROM lineitem) x GROUP BY 1""",
)
def loss_by_masked(v):
    rows = v.table("lineitem").select(
        F.col("l_linenumber").cast("double").alias("masked"),
        (F.col("l_linenumber") + F.col("l_quantity")).alias("total"),
        (F.col("l_extendedprice") / 1000).alias("loss"),
    )
    return mt.loss_by_masked_share(rows, "loss", "masked", "total").withColumn("loss", r9(F.col("loss")))


@query(
    "g19_weighted_means",
    "SELECT run, step, round(sum(CAST(loss_tokens AS DOUBLE) * n) / greatest(sum(n), 1), 9) AS mean, sum(n)::BIGINT AS count FROM f_ledg GROUP BY run, step",
)
def weighted_means(v):
    rows = v.f_ledg.withColumn("loss", F.col("loss_tokens").cast("double"))
    return mt.weighted_means(rows, ["run", "step"], "loss", "n").withColumn("mean", r9(F.col("mean")))


@query(
    "g20_results_table",
    f"""WITH {sql_paired('train step: 1')} SELECT dataset, format('{{:.4f}}', acc) AS acc, format('{{:.1f}}', avg_len) AS avg_len, format('{{:.3f}}', tok_per_step) AS tok_per_step
        FROM paired""",
)
def results_table(v):
    return mt.results_table(mt.paired_results(v.f_log))


# --- from responses to rewards and accuracy in one plan ----------------------
_SQL_JUDGED = f"""j AS (SELECT r.resp_id, r.sample_id, r.domain, d.lang AS subdivision, d.source AS category, d.n_chars AS n_tokens,
      coalesce({sql_letter(sql_mc_letter('response'))} = gold, false) AS correct FROM f_resp r JOIN documents d ON d.doc_id = r.resp_id)"""


def _judged(v):
    """Letters extracted from whole responses and compared with the key."""
    rows = v.f_resp.select("resp_id", "sample_id", "domain", "gold", ex.mc_letter(F.col("response")).alias("letter"))
    facts = v.table("documents").select(
        F.col("doc_id").alias("resp_id"), F.col("lang").alias("subdivision"),
        F.col("source").alias("category"), F.col("n_chars").alias("n_tokens"),
    )
    judged = rows.withColumn("correct", ck.same_letter(F.col("letter"), F.col("gold")))
    return rw.narrowed(judged, "resp_id", "sample_id", "domain", "correct").join(facts, "resp_id")


@query(
    "g01_reward_from_responses",
    f"""WITH {_SQL_JUDGED}, x AS (SELECT *, CASE WHEN correct AND NOT n_tokens >= {_CAP} - 5 THEN 1 ELSE 0 END AS x FROM j)
      SELECT resp_id, sample_id, correct, round(coalesce((CAST(x AS DOUBLE) - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 9) AS reward
      FROM x WINDOW w AS (PARTITION BY sample_id)""",
)
def reward_from_responses(v):
    rows = _judged(v)
    kept = rw.capped(F.col("correct"), F.col("n_tokens"), F.lit(_CAP))
    scored = rw.z_scored(rows.withColumn("x", kept.cast("int")), "sample_id", "x")
    return scored.select("resp_id", "sample_id", "correct", r9(F.col("reward")).alias("reward"))


@query(
    "g05_accuracy_from_responses",
    f"""WITH {_SQL_JUDGED}, s AS (SELECT {_SQL_DOM} AS domain, category, subdivision, correct FROM j),
      g AS (SELECT 'all' AS level, NULL AS label, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n FROM s
        UNION ALL SELECT 'domain', domain, count(*) FILTER (WHERE correct), count(*) FROM s GROUP BY domain
        UNION ALL SELECT 'category', category, count(*) FILTER (WHERE correct), count(*) FROM s GROUP BY category
        UNION ALL SELECT 'subdivision', subdivision, count(*) FILTER (WHERE correct), count(*) FROM s GROUP BY subdivision)
      SELECT level, label, n_correct, n, round(n_correct / greatest(n, 1), 9) AS accuracy FROM g""",
)
def accuracy_from_responses(v):
    rows = _judged(v).withColumn("domain", resolve_domain(F.col("domain"))).withColumn("scorable", F.lit(True))
    return rw.accuracy(rows).withColumn("accuracy", r9(F.col("accuracy")))
