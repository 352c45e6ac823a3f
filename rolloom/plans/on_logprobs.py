"""Analytics over logged log-probabilities (family K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import logprob as lp
from rolloom.plans.base import query

# Logits are scaled so that the distributions differ visibly.
_SOFT = """soft AS (SELECT seq, pos, token_id, 20 * t_logit - max(20 * t_logit) OVER w - ln(sum(exp(20 * t_logit - mt)) OVER w) AS t_lp,
      20 * s_logit - ms - ln(sum(exp(20 * s_logit - ms)) OVER w) AS s_lp
    FROM (SELECT *, max(20 * t_logit) OVER (PARTITION BY seq, pos) AS mt, max(20 * s_logit) OVER (PARTITION BY seq, pos) AS ms FROM f_lp) x
    WINDOW w AS (PARTITION BY seq, pos))"""


def r9(c):
    return F.round(c, 9)


def _scaled(v):
    return v.f_lp.select(
        "seq", "pos", "token_id", (20 * F.col("t_logit")).alias("t_logit"), (20 * F.col("s_logit")).alias("s_logit")
    )


def _soft(v):
    """Teacher and student log-probabilities, in one shuffle."""
    rows = lp.normalised(_scaled(v), "t_logit", "t_lp")
    return lp.normalised(rows, "s_logit", "s_lp").select("seq", "pos", "token_id", "t_lp", "s_lp")


def _sql_lse(x: str) -> str:
    return f"(max({x}) OVER w + ln(sum(exp({x} - m)) OVER w))"


_SHARP = """a AS (SELECT seq, pos, token_id, s_logit, 20 * t_logit / 0.8e0 AS x FROM f_lp),
    b AS (SELECT *, CASE WHEN rank() OVER (PARTITION BY seq, pos ORDER BY x DESC) <= 40 THEN x ELSE '-inf'::DOUBLE END AS y FROM a),
    c AS (SELECT *, exp(y - max(y) OVER p) / sum(exp(y - my)) OVER p AS pr FROM (SELECT *, max(y) OVER (PARTITION BY seq, pos) AS my FROM b) q WINDOW p AS (PARTITION BY seq, pos)),
    d AS (SELECT *, coalesce(sum(pr) OVER (PARTITION BY seq, pos ORDER BY y DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
    e AS (SELECT *, CASE WHEN before <= 0.9 THEN y ELSE '-inf'::DOUBLE END AS z FROM d),
    f AS (SELECT *, max(z) OVER (PARTITION BY seq, pos) AS mz FROM e),
    g AS (SELECT *, CASE WHEN exp(z - mz) >= 0.02 THEN z ELSE '-inf'::DOUBLE END AS u FROM f),
    h AS (SELECT seq, pos, token_id, s_logit, u - mz - ln(sum(exp(u - mz)) OVER (PARTITION BY seq, pos)) AS t_lp FROM g)"""


def _sharp(v):
    return lp.normalised(_scaled(v), "t_logit", "t_lp", temperature=0.8, top_k=40, top_p=0.9, min_p=0.02)


@query(
    "k01_renormalised_distribution",
    f"WITH {_SHARP} SELECT seq, pos, token_id, t_lp > '-inf'::DOUBLE AS kept, CASE WHEN t_lp > '-inf'::DOUBLE THEN round(t_lp, 9) END AS t_lp FROM h",
)
def renormalised(v):
    kept = lp.finite(F.col("t_lp"))
    return _sharp(v).select("seq", "pos", "token_id", kept.alias("kept"), F.when(kept, r9(F.col("t_lp"))).alias("t_lp"))


@query(
    "k02_kl_divergence",
    f"""WITH {_SOFT} SELECT seq, pos, round(sum(exp(t_lp) * (t_lp - s_lp)), 9) AS forward, round(sum(exp(s_lp) * (s_lp - t_lp)), 9) AS reverse,
        round(0.7 * sum(exp(t_lp) * (t_lp - s_lp)) + 0.3 * sum(exp(s_lp) * (s_lp - t_lp)), 9) AS mixed FROM soft GROUP BY seq, pos""",
)
def kl_divergence(v):
    out = lp.divergence(_soft(v), reverse_weight=0.3)
    return out.select("seq", "pos", *[r9(F.col(c)).alias(c) for c in ("forward", "reverse", "mixed")])


@query(
    "k02_kl_restricted_support",
    f"""WITH {_SHARP}, s AS (SELECT *, 20 * s_logit - ms - ln(sum(exp(20 * s_logit - ms)) OVER (PARTITION BY seq, pos)) AS s_lp
        FROM (SELECT *, max(20 * s_logit) OVER (PARTITION BY seq, pos) AS ms FROM h) q)
      SELECT seq, pos, round(sum(CASE WHEN t_lp > '-inf'::DOUBLE THEN exp(t_lp) * (t_lp - s_lp) ELSE 0 END), 9) AS forward FROM s GROUP BY seq, pos""",
)
def kl_restricted(v):
    rows = lp.normalised(_sharp(v), "s_logit", "s_lp")
    return lp.divergence(rows).select("seq", "pos", r9(F.col("forward")).alias("forward"))


@query(
    "k02_kl_top_tokens",
    f"""WITH {_SOFT}, k AS (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY t_lp DESC, token_id) AS n FROM soft)
      SELECT seq, pos, round(sum(exp(t_lp) * (t_lp - s_lp)), 9) AS forward FROM k WHERE n <= 16 GROUP BY seq, pos""",
)
def kl_top_tokens(v):
    return lp.divergence(lp.top_tokens(_soft(v), "t_lp", 16)).select("seq", "pos", r9(F.col("forward")).alias("forward"))


@query(
    "k03_jensen_shannon",
    f"""WITH {_SOFT} SELECT seq, pos, round(0.3 * sum(exp(t_lp) * (t_lp - ln(0.3 * exp(t_lp) + 0.7 * exp(s_lp))))
        + 0.7 * sum(exp(s_lp) * (s_lp - ln(0.3 * exp(t_lp) + 0.7 * exp(s_lp)))), 9) AS jsd FROM soft GROUP BY seq, pos""",
)
def jensen_shannon(v):
    return lp.jensen_shannon(_soft(v), alpha=0.3).withColumn("jsd", r9(F.col("jsd")))


_SQL_SEQ = f"""WITH {_SOFT}, p AS (SELECT seq, pos, pos % 3 <> 0 AS mask, sum(exp(t_lp) * (t_lp - s_lp)) AS forward FROM soft GROUP BY seq, pos),
    q AS (SELECT seq, sum(CASE WHEN mask THEN forward ELSE 0 END) / greatest(count(*) FILTER (WHERE mask), 1) AS loss,
      count(*) FILTER (WHERE mask) AS masked, count(*) AS positions FROM p GROUP BY seq)"""


def _sequence_losses(v):
    positions = lp.divergence(_soft(v)).withColumn("mask", F.col("pos") % 3 != 0)
    return lp.masked_means(positions, "forward", "mask")


@query("k04_masked_mean_by_sequence", f"{_SQL_SEQ} SELECT seq, round(loss, 9) AS loss, masked, positions FROM q")
def masked_mean(v):
    return _sequence_losses(v).withColumn("loss", r9(F.col("loss")))


@query("k04_batch_mean", f"{_SQL_SEQ} SELECT round(avg(loss), 9) AS loss, count(*) AS sequences FROM q")
def batch_mean(v):
    return lp.batch_mean(_sequence_losses(v)).withColumn("loss", r9(F.col("loss")))


_LABELLED = f"WITH {_SOFT}, lab AS (SELECT *, pos % 3 <> 0 AS mask FROM soft WHERE token_id = (pos * 7) % 64)"


def _labelled(v):
    """The label's row of every position."""
    rows = _soft(v).filter(F.col("token_id") == (F.col("pos") * 7) % 64)
    return rows.withColumn("mask", F.col("pos") % 3 != 0)


@query(
    "k05_masked_nll",
    f"""{_LABELLED} SELECT seq, round(sum(CASE WHEN mask THEN -s_lp ELSE 0 END) / greatest(count(*) FILTER (WHERE mask), 1), 9) AS loss,
        count(*) FILTER (WHERE mask) AS masked, count(*) AS positions FROM lab GROUP BY seq""",
)
def masked_nll(v):
    return lp.masked_nll(_labelled(v), "s_lp", "mask").withColumn("loss", r9(F.col("loss")))


def _sql_drift(count: str) -> str:
    return f"""{_LABELLED}, r AS (SELECT *, CASE WHEN mask THEN s_lp - t_lp ELSE 0 END AS gap, seq % 3 - 1.0 AS adv FROM lab),
      x AS (SELECT *, exp(greatest(-10, least(10, gap))) AS ratio FROM r),
      y AS (SELECT *, greatest(0.8, least(1.2, ratio)) AS clipped FROM x)
    SELECT seq, round(sum(CASE WHEN mask THEN least(ratio * adv, clipped * adv) ELSE 0 END) / {count}, 9) AS surrogate,
      round(sum(gap) / {count}, 9) AS k1, round(sum(CASE WHEN mask THEN exp(greatest(-10, least(10, -gap))) - 1 + gap ELSE 0 END) / {count}, 9) AS k3,
      round(count(*) FILTER (WHERE mask AND ratio <> clipped) / {count}, 9) AS clip_share FROM y GROUP BY seq"""


def _drift(v, per_mask):
    rows = _labelled(v).select(
        "seq", "mask", F.col("s_lp").alias("logp_new"), F.col("t_lp").alias("logp_old"),
        (F.col("seq") % 3 - 1).cast("double").alias("adv"),
    )
    out = lp.drift(rows, per_mask=per_mask)
    return out.select("seq", *[r9(F.col(c)).alias(c) for c in ("surrogate", "k1", "k3", "clip_share")])


@query("k06_policy_drift_causal", _sql_drift("greatest(count(*) FILTER (WHERE mask), 1)"))
def drift_causal(v):
    return _drift(v, per_mask=True)


@query("k06_policy_drift_diffusion", _sql_drift("count(*)"))
def drift_diffusion(v):
    return _drift(v, per_mask=False)


@query(
    "k07_soft_cross_entropy",
    f"""WITH {_SOFT}, p AS (SELECT seq, pos, pos % 5 = 0 AS ignored, sum(-exp(t_lp) * s_lp) AS ce FROM soft GROUP BY seq, pos)
      SELECT round(sum(CASE WHEN NOT ignored THEN ce ELSE 0 END) / count(*) FILTER (WHERE NOT ignored), 9) AS loss, count(*) FILTER (WHERE NOT ignored) AS positions FROM p""",
)
def soft_cross_entropy(v):
    rows = _soft(v).withColumn("target", F.exp("t_lp")).withColumn("ignored", F.col("pos") % 5 == 0)
    return lp.soft_cross_entropy(rows, "target", "s_lp", "ignored").withColumn("loss", r9(F.col("loss")))
