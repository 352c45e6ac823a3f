"""Sampling, assignment, ledgers and schedules; sorts and top-k (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions.hashing import PORTABLE
from rolloom.operators import logprob as lp
from rolloom.operators import ordered
from rolloom.operators import prepare as pr
from rolloom.operators import rewards as rw
from rolloom.operators import schedule as sc
from rolloom.plans.base import query


@query(
    "h01_epoch_chunks",
    """WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT unnest(range(1, 6)) AS epoch),
      o AS (SELECT d.doc_id AS id, e.epoch, (e.epoch - 1) * n.n + row_number() OVER (PARTITION BY e.epoch ORDER BY md5(concat('11:', CAST(e.epoch AS VARCHAR), ':', CAST(d.doc_id AS VARCHAR)))) AS position
            FROM documents d, e, n)
    SELECT id, CAST(epoch AS INT) AS epoch, position, CAST((position - 1) // 128 + 1 AS BIGINT) AS step FROM o, n
    WHERE (position - 1) // 128 + 1 <= ceil(n.n / 128.0) * 2""",
)
def epoch_chunks(v):
    # Only the ids are read, and their number comes from the file footers.
    ids = v.table("documents").select(F.col("doc_id").alias("id"))
    return sc.epoch_chunks(ids, "id", chunk=128, epochs=2, seed=11, draws=PORTABLE)


@query(
    "h02_sample_prompts",
    "SELECT id, domain FROM f_mix ORDER BY md5(concat('7:3:', CAST(id AS VARCHAR))) LIMIT 128",
)
def sample_prompts(v):
    return sc.sample(v.f_mix.select("id", "domain"), "id", 128, seed=7, step=3, draws=PORTABLE)


_SQL_INDEX = """i AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS gi FROM f_requests),
    m AS (SELECT count(*) AS n FROM f_requests)"""


def _indexed(v):
    requests = v.f_requests.select("conv_id", "turn")
    n = requests.agg(F.count("*").alias("n")).scalar()
    return ordered.dense_index(requests, "conv_id", "turn"), n


@query(
    "h03_ceil_chunks",
    f"WITH {_SQL_INDEX} SELECT conv_id, turn, gi, CAST(floor(gi / ceil(n / 7.0)) AS INT) AS chunk FROM i, m",
)
def ceil_chunks(v):
    rows, n = _indexed(v)
    return rows.withColumn("chunk", sc.ceil_chunk(F.col("gi"), n, 7))


@query(
    "h04_balanced_chunks",
    f"""WITH {_SQL_INDEX}, c AS (SELECT unnest(range(0, 7)) AS c)
    SELECT i.conv_id, i.turn, CAST(c.c AS INT) AS balanced, CAST(ntile(7) OVER (ORDER BY gi) - 1 AS INT) AS front_loaded
    FROM i, m, c WHERE gi >= (n * c.c) // 7 AND gi < (n * (c.c + 1)) // 7""",
)
def balanced_chunks(v):
    rows, n = _indexed(v)
    return rows.select(
        "conv_id",
        "turn",
        sc.balanced_chunk(F.col("gi"), n, 7).alias("balanced"),
        sc.front_loaded_chunk(F.col("gi"), n, 7).alias("front_loaded"),
    )


@query("h05_strided_assignment", f"WITH {_SQL_INDEX} SELECT conv_id, turn, CAST(gi % 8 AS INT) AS rank FROM i")
def strided_assignment(v):
    rows, _ = _indexed(v)
    return rows.select("conv_id", "turn", sc.strided(F.col("gi"), 8).alias("rank"))


_COUNTERS = ["rollout_tokens", "loss_tokens", "busy"]
_SQL_TOTALS = "SELECT run, step, sum(rollout_tokens)::BIGINT AS rollout_tokens, sum(loss_tokens)::BIGINT AS loss_tokens, sum(busy)::BIGINT AS busy FROM f_ledg GROUP BY run, step"
_SQL_CUM = f"""SELECT *, (sum(rollout_tokens) OVER w)::BIGINT AS total_rollout_tokens, (sum(loss_tokens) OVER w)::BIGINT AS total_loss_tokens,
    (sum(busy) OVER w)::BIGINT AS total_busy FROM ({_SQL_TOTALS}) t WINDOW w AS (PARTITION BY run ORDER BY step)"""


def _cumulative(v):
    return sc.cumulative(sc.step_totals(v.f_ledg, _COUNTERS), _COUNTERS)


@query("h06_cumulative_ledger", _SQL_CUM)
def cumulative_ledger(v):
    return _cumulative(v)


@query(
    "h07_compute_ledger",
    f"""SELECT run, step, round(6 * 4e9 * total_loss_tokens / 1e18, 9) AS student_work, round(2 * 8e9 * total_loss_tokens / 1e18, 9) AS teacher_work,
        round(2 * 4e9 * total_rollout_tokens / 1e18, 9) AS rollout_work, round(6 * 4e9 * total_loss_tokens / 1e18 + 2 * 8e9 * total_loss_tokens / 1e18, 9) AS total_work FROM ({_SQL_CUM}) c""",
)
def compute_ledger(v):
    work = sc.compute_ledger(_cumulative(v), student=4e9, teacher=8e9)
    names = ["student_work", "teacher_work", "rollout_work", "total_work"]
    return work.select("run", "step", *[F.round(n, 9).alias(n) for n in names])


def _sql_budget(kind: str) -> str:
    p = "least(step / 100.0, 1.0)"
    shape = {"linear": p, "sin": f"sin(pi() / 2 * {p})", "cos": f"(1.0 - cos(pi() / 2 * {p}))"}[kind]
    return f"greatest(CAST(round_even((100 + 1900 * {shape}) / 4, 0) * 4 AS INT), 4)"


@query(
    "h08_scheduled_caps",
    f"""SELECT run, step, rollout_tokens, {_sql_budget('linear')} AS linear, {_sql_budget('sin')} AS sine, {_sql_budget('cos')} AS cosine,
        round(CASE WHEN step <= 20 THEN 0.9 ELSE 0.9 + (0.5 - 0.9) * least((step - 20) / 80.0, 1.0) END, 9) AS threshold FROM ({_SQL_TOTALS}) t""",
)
def scheduled_caps(v):
    step = F.col("step")
    budgets = {
        name: sc.scheduled_budget(step, 100, 2000, 100, kind)
        for name, kind in (("linear", "linear"), ("sine", "sin"), ("cosine", "cos"))
    }
    threshold = sc.scheduled_threshold(step, 0.9, 0.5, hold=20, ramp=None, total=100)
    return sc.step_totals(v.f_ledg, ["rollout_tokens"]).select(
        "run", "step", "rollout_tokens", *[c.alias(n) for n, c in budgets.items()], F.round(threshold, 9).alias("threshold")
    )


@query(
    "h09_schedule_changes",
    f"""SELECT x.run, x.step, x.budget FROM (SELECT run, step, {_sql_budget('linear')} AS budget FROM ({_SQL_TOTALS}) t) x
        JOIN (SELECT run, step + 1 AS step, {_sql_budget('linear')} AS budget FROM (SELECT run, step - 1 AS step FROM ({_SQL_TOTALS}) t) u) y
        ON x.run = y.run AND x.step = y.step WHERE x.budget <> y.budget""",
)
def schedule_changes(v):
    steps = sc.step_totals(v.f_ledg, ["rollout_tokens"])
    return sc.changes(steps, lambda step: sc.scheduled_budget(step, 100, 2000, 100, "linear"), "budget")


@query(
    "i01_row_cap_per_split",
    "SELECT id, split FROM (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) AS n FROM f_cf) x WHERE n <= 50",
)
def row_cap(v):
    return pr.row_cap(v.f_cf.select("id", "split"), "split", F.col("id"), 50)


@query(
    "i02_top_tokens",
    """SELECT seq, pos, token_id, round(t_logit, 9) AS t_logit, row_number() OVER (PARTITION BY seq, pos ORDER BY t_logit DESC, token_id) <= 8 AS exact
       FROM f_lp QUALIFY rank() OVER (PARTITION BY seq, pos ORDER BY t_logit DESC) <= 8""",
)
def top_tokens(v):
    rows = v.f_lp.select("seq", "pos", "token_id", "t_logit")
    marked = lp.top_tokens_marked(rows, "t_logit", 8)
    return marked.select("seq", "pos", "token_id", F.round("t_logit", 9).alias("t_logit"), "exact")


@query(
    "i03_argmax_token",
    "SELECT seq, pos, token_id FROM f_lp QUALIFY row_number() OVER (PARTITION BY seq, pos ORDER BY t_logit DESC, token_id) = 1",
)
def argmax_token(v):
    return lp.argmax_token(v.f_lp, "t_logit")


@query(
    "i04_sorted_listing",
    """SELECT coalesce(category, 'none') AS category, n, n_correct FROM (SELECT category, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM f_roll GROUP BY category) x
       ORDER BY 1""",
)
def sorted_listing(v):
    listing = v.f_roll.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct")
    )
    return listing.orderBy("category")


# --- caps that follow the step -------------------------------------------------
def _step_rows(v):
    """Rollouts at steps 1 to 150; the run was scheduled for steps 1 to 120."""
    rows = v.f_roll.withColumn("step", (F.col("sample_id") % 150 + 1).cast("int"))
    steps = rows.where("step <= 120").select("step")
    table = sc.schedule_table(
        steps,
        lambda step: sc.scheduled_budget(step, 100, 2000, 100, "sin"),
        lambda step: sc.scheduled_threshold(step, 0.9, 0.5, hold=20, ramp=80),
    )
    return sc.at_step(rows, table)


_SQL_STEPS = f"""steps AS (SELECT step, {_sql_budget('sin')} AS budget, CASE WHEN step <= 20 THEN 0.9 ELSE 0.9 + (0.5 - 0.9) * least((step - 20) / 80.0, 1.0) END AS threshold
    FROM (SELECT unnest(range(1, 121)) AS step) x),
  r AS (SELECT f.*, CAST(sample_id % 150 + 1 AS INT) AS own FROM f_roll f)"""


@query(
    "g02_step_caps",
    f"""WITH {_SQL_STEPS} SELECT sample_id, resp_idx, own AS step, correct AND NOT coalesce(n_tokens >= budget - 5, false) AS capped, round(threshold, 9) AS threshold
        FROM r LEFT JOIN steps ON step = own""",
)
def step_caps(v):
    """The cap penalty under the budget of each row's own step."""
    rows = _step_rows(v)
    capped = rw.capped(F.col("correct"), F.col("n_tokens"), F.col("budget"))
    return rows.select("sample_id", "resp_idx", "step", capped.alias("capped"), F.round("threshold", 9).alias("threshold"))


@query(
    "b19_step_budgets",
    f"""WITH {_SQL_STEPS} SELECT sample_id, resp_idx, CASE domain WHEN 'math' THEN least(budget, 1000) WHEN 'code' THEN least(budget, 300) ELSE budget END AS budget
        FROM r JOIN steps ON step = own""",
)
def step_budgets(v):
    """The domain's cap or the budget of the row's step, whichever is smaller."""
    rows = _step_rows(v).where("budget IS NOT NULL")
    budget = pr.token_budget(F.col("domain"), F.col("budget"), {"math": 1000, "code": 300})
    return rows.select("sample_id", "resp_idx", budget.alias("budget"))
