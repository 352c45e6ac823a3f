"""Joins, flat and nested forms and set operations (family F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import logprob as lp
from rolloom.operators import metrics as mt
from rolloom.operators import reshape as rs
from rolloom.operators import verdicts as vd
from rolloom.plans.base import query

_VALUES = ["response", "n_tokens", "correct"]


@query("f01_flatten_lists", "SELECT sample_id, resp_idx, CAST(length(response) AS INT) AS chars, n_tokens, correct FROM f_roll")
def flatten_lists(v):
    nested = rs.regroup(v.f_roll, "sample_id", "resp_idx", _VALUES)
    flat = rs.flatten_lists(nested, ["sample_id", "part"], _VALUES)
    return flat.select(
        "sample_id",
        (F.col("part") * rs.PART + F.col("resp_idx")).alias("resp_idx"),
        F.length("response").alias("chars"),
        "n_tokens",
        "correct",
    )


@query(
    "f02_regroup_in_order",
    """SELECT sample_id, CAST(resp_idx // 3 AS INT) AS part, string_agg(CAST(n_tokens AS VARCHAR), ',' ORDER BY resp_idx) AS lengths,
       string_agg(CASE WHEN correct THEN '1' ELSE '0' END, '' ORDER BY resp_idx) AS verdicts FROM f_roll GROUP BY sample_id, resp_idx // 3""",
)
def regroup(v):
    rows = rs.regroup(v.f_roll, "sample_id", "resp_idx", ["n_tokens", "correct"], part_size=3)
    bits = F.transform("correct", lambda c: F.when(c, "1").otherwise("0"))
    return rows.select(
        "sample_id", "part", F.array_join("n_tokens", ",").alias("lengths"), F.array_join(bits, "").alias("verdicts")
    )


@query(
    "f03_candidate_test_cross",
    """WITH c AS (SELECT DISTINCT sample_id, resp_idx FROM f_verd), t AS (SELECT sample_id, test_idx, expected FROM f_verd)
       SELECT c.sample_id, c.resp_idx, t.test_idx, t.expected FROM c JOIN t ON t.sample_id = c.sample_id""",
)
def candidate_test_cross(v):
    candidates = v.f_verd.select("sample_id", "resp_idx").distinct()
    return vd.cross_tests(candidates, v.f_verd.select("sample_id", "test_idx", "expected"))


@query(
    "f04_answers_in_order",
    """SELECT r.conv_id, r.turn, r.prompt, coalesce(o.response, '') AS response FROM f_requests r
       LEFT JOIN f_outputs o ON o.conv_id = r.conv_id AND o.turn = r.turn""",
)
def answers_in_order(v):
    outputs = v.f_outputs.drop("chunk_id")
    return rs.answers_in_order(v.f_requests, outputs, ["conv_id", "turn"]).orderBy("conv_id", "turn")


@query(
    "f05_split_by_method",
    """SELECT sample_id, CASE WHEN coalesce(test_method, 'function') = 'stdio' THEN concat('run ', question) ELSE concat('call ', prefix) END AS plan
       FROM f_tests""",
)
def split_by_method(v):
    on_stdio = F.concat(F.lit("run "), F.col("question"))
    on_function = F.concat(F.lit("call "), F.col("prefix"))
    return rs.split_by_method(v.f_tests, "test_method", on_stdio, on_function, "plan").select("sample_id", "plan")


def sql_paired(result: str) -> str:
    return rf"""paired AS (
      SELECT shard, line_no, dataset, CAST(regexp_extract(line, '\Atrain step: ([0-9]+)', 1) AS INT) AS step,
        CAST(nullif(regexp_extract(line, '  acc: *([0-9.]+)', 1), '') AS DOUBLE) AS acc,
        CAST(nullif(regexp_extract(line, '  avg length: *([0-9.]+)', 1), '') AS DOUBLE) AS avg_len,
        CAST(nullif(regexp_extract(line, '  avg tok/step: *([0-9.]+)', 1), '') AS DOUBLE) AS tok_per_step
      FROM (SELECT *, row_number() OVER (PARTITION BY shard, grp ORDER BY line_no) AS n, max(h) OVER (PARTITION BY shard, grp) AS dataset
            FROM (SELECT *, sum(CASE WHEN h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY line_no) AS grp
                  FROM (SELECT *, CASE WHEN starts_with(line, '  Dataset:') THEN regexp_extract(line, 'Dataset: *(.*?) +\(', 1) END AS h FROM f_log
                        WHERE starts_with(line, '  Dataset:') OR starts_with(line, '{result}')) a) b) c
      WHERE n = 2 AND starts_with(line, 'train step:'))"""


@query("f06_log_pairing", f"WITH {sql_paired('train step: 1')} SELECT * FROM paired")
def log_pairing(v):
    return mt.paired_results(v.f_log)


@query(
    "f07_teacher_top_k_alignment",
    """SELECT seq, pos, token_id, t_logit, s_logit FROM (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY t_logit DESC, token_id) AS n FROM f_lp) x
       WHERE n <= 16""",
)
def teacher_alignment(v):
    teacher = v.f_lp.select("seq", "pos", "token_id", "t_logit")
    student = v.f_lp.select("seq", "pos", "token_id", "s_logit")
    return lp.align(lp.top_tokens(teacher, "t_logit", 16), student)


@query(
    "f08_missing_required",
    """SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def missing_required(v):
    required = v.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return rs.missing(required, v.table("customer").filter(F.col("c_acctbal") >= 0), "c_custkey")


@query(
    "f09_resume_pending",
    """SELECT conv_id, turn, CAST(conv_id % 8 AS INT) AS chunk_id FROM f_requests WHERE conv_id % 8 NOT IN (SELECT chunk_id FROM f_outputs WHERE chunk_id <> 5)""",
)
def resume_pending(v):
    work = v.f_requests.select("conv_id", "turn", (F.col("conv_id") % 8).cast("int").alias("chunk_id"))
    finished = v.f_outputs.filter("chunk_id <> 5")  # one chunk is still running
    return rs.pending(work, finished, "chunk_id")


@query(
    "f10_stack_shards",
    """SELECT conv_id, turn, 'request' AS kind, prompt AS text FROM f_requests UNION ALL SELECT conv_id, turn, 'answer', response FROM f_outputs""",
)
def stack_shards(v):
    a = v.f_requests.select("conv_id", "turn", F.lit("request").alias("kind"), F.col("prompt").alias("text"))
    b = v.f_outputs.select(F.col("response").alias("text"), "turn", "conv_id", F.lit("answer").alias("kind"))
    return rs.stack(a, b)


@query(
    "f11_distinct_steps",
    "SELECT resp_id, CAST(len(list_distinct(step_map)) AS INT) AS steps, array_to_string(list_sort(list_distinct(step_map)), ',') AS sorted_steps FROM f_step",
)
def distinct_steps(v):
    ids = rs.distinct_in_order(F.col("step_map"))
    return v.f_step.select(
        "resp_id", F.size(ids).alias("steps"), F.array_join(F.array_sort(ids), ",").alias("sorted_steps")
    )


@query(
    "f11_single_stop_ids",
    "SELECT DISTINCT resp_id % 97 AS model, step_map[1] AS stop_id FROM f_step WHERE resp_id % 2 = 0",
)
def single_stop_ids(v):
    stops = v.f_step.select(
        (F.col("resp_id") % 97).alias("model"),
        F.when(F.col("resp_id") % 2 == 0, F.slice("step_map", 1, 1)).otherwise(F.slice("step_map", 1, 2)).alias("ids"),
    )
    return rs.single_stop_ids(stops, "model", "ids")


@query(
    "f12_metric_keys",
    "SELECT run, step % 11 AS metric, count(DISTINCT worker) AS workers FROM f_ledg WHERE n > 2 GROUP BY 1, 2",
)
def metric_keys(v):
    rows = v.f_ledg.filter("n > 2").select("run", "worker", (F.col("step") % 11).alias("metric"))
    return rs.metric_keys(rows, "run", "worker", "metric")


@query("f13_source_mix", "SELECT coalesce(source, 'student') AS source, count(*) AS n, sum(len(step_map))::BIGINT AS tokens FROM f_step GROUP BY 1")
def source_mix(v):
    return rs.with_source(v.f_step).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.size("step_map")).alias("tokens")
    )
