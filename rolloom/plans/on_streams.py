"""Incremental jobs (family N): their end state equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import extract as ex
from rolloom.plans.base import query
from rolloom.plans.on_answers import sql_mc_letter
from rolloom.plans.on_scores import sql_letter
from rolloom.session import work_dir
from rolloom.streaming import jobs


@query(
    "n01_incremental_scoring",
    f"""SELECT resp_id, {sql_mc_letter('response')} AS letter, {sql_letter(sql_mc_letter('response'))} = gold AS correct FROM f_resp""",
)
def incremental_scoring(v):
    """Two deliveries, one run after each, the second from the checkpoint."""
    inbox, sink, state = (work_dir(v.spark, d) for d in ("inbox", "scored", "state"))
    rows = v.f_resp.select("resp_id", "gold", "response")

    def score(stream):
        letter = ex.mc_letter(F.col("response"))
        scored = stream.select("resp_id", "gold", letter.alias("letter"))
        return scored.select("resp_id", "letter", ck.same_letter(F.col("letter"), F.col("gold")).alias("correct"))

    for part in (F.col("resp_id") % 2 == 0, F.col("resp_id") % 2 == 1):
        rows.filter(part).write.mode("append").json(inbox)
        stream = jobs.new_files(v.spark, inbox, "resp_id bigint, gold string, response string")
        jobs.append_scored(stream, score, sink, state)
    return v.spark.read.parquet(sink)


@query(
    "n02_running_ledger",
    "SELECT run, sum(rollout_tokens)::BIGINT AS rollout_tokens, sum(loss_tokens)::BIGINT AS loss_tokens FROM f_ledg GROUP BY run",
)
def running_ledger(v):
    inbox, sink, state = (work_dir(v.spark, d) for d in ("ledger", "totals", "state"))
    values = ["rollout_tokens", "loss_tokens"]
    rows = v.f_ledg.select("run", "step", *values)
    schema = "run string, step int, rollout_tokens bigint, loss_tokens bigint"
    for part in (F.col("step") % 3 == 0, F.col("step") % 3 != 0):
        rows.filter(part).write.mode("append").json(inbox)
        stream = jobs.new_files(v.spark, inbox, schema)
        jobs.running_totals(stream, "run", values, sink, state)
    return jobs.latest_totals(v.spark, sink, "run", values)


@query(
    "n03_idempotent_ingest",
    "SELECT sample_id, resp_idx, n_tokens FROM f_roll",
)
def idempotent_ingest(v):
    """One delivery comes twice; every response is kept once, a step at a time."""
    inbox, sink, state = (work_dir(v.spark, d) for d in ("inbox", "distinct", "state"))
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("sample_id") % 60)
    step = F.floor(F.col("sample_id") / 1024).cast("int")
    rows = v.f_roll.select(step.alias("step"), "sample_id", "resp_idx", "n_tokens", at.alias("ingested"))
    schema = "step int, sample_id bigint, resp_idx int, n_tokens bigint, ingested timestamp"
    again = F.col("sample_id") % 10 == 3
    for part in (F.lit(True), again):
        rows.filter(part).write.mode("append").json(inbox)
        stream = jobs.new_files(v.spark, inbox, schema)
        jobs.append_distinct(stream, ["step", "sample_id", "resp_idx"], sink, state, by=["step"])
    return v.spark.read.parquet(sink).select("sample_id", "resp_idx", "n_tokens")
