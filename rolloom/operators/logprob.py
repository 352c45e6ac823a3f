"""Analytics over logged token log-probabilities, in long form.

One row per (seq, pos, token_id). Windows span one position, so their size is
the number of logged tokens per position whatever the length of a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = ["seq", "pos"]


def _ranked(value: str, *ties: str) -> Window:
    return Window.partitionBy(*POSITION).orderBy(F.col(value).desc(), *ties)


def top_tokens(rows: DataFrame, value: str, k: int, keep_ties: bool = False) -> DataFrame:
    """The k likeliest tokens of each position.

    Exactly k with the lower id first among equals, or all that reach the
    k-th value.
    """
    order = F.rank().over(_ranked(value)) if keep_ties else F.row_number().over(_ranked(value, "token_id"))
    return rows.withColumn("_rank", order).filter(F.col("_rank") <= k).drop("_rank")


def top_tokens_marked(rows: DataFrame, value: str, k: int, name: str = "exact") -> DataFrame:
    """All tokens that reach the k-th value; ``name`` marks the k of the exact choice.

    Both ranks come from one sort of each position.
    """
    place = F.row_number().over(_ranked(value, "token_id"))
    marked = rows.withColumn("_place", place).withColumn("_rank", F.rank().over(_ranked(value)))
    return marked.filter(F.col("_rank") <= k).withColumn(name, F.col("_place") <= k).drop("_place", "_rank")


def argmax_token(rows: DataFrame, value: str) -> DataFrame:
    """Likeliest token of each position, the lowest id among equals."""
    best = F.max_by("token_id", F.struct(F.col(value), -F.col("token_id")))
    return rows.groupBy(*POSITION).agg(best.alias("token_id"))


def align(teacher_top: DataFrame, student: DataFrame) -> DataFrame:
    """Student values at the teacher's tokens."""
    return teacher_top.join(student, [*POSITION, "token_id"])


def _log_sum_exp(value: Column, whole) -> Column:
    top = F.max(value).over(whole)
    return top + F.ln(F.sum(F.exp(value - top)).over(whole))


def normalised(
    rows: DataFrame,
    value: str,
    name: str,
    temperature: float = 1.0,
    top_k: int = 0,
    top_p: float = 1.0,
    min_p: float = 0.0,
) -> DataFrame:
    """Log-probabilities after temperature, top-k, top-p and min-p.

    Removed tokens stay as rows with minus infinity, so the support of the
    distribution is explicit.
    """
    whole = Window.partitionBy(*POSITION)
    gone = F.lit(float("-inf"))
    out = rows.withColumn(name, F.col(value) / F.lit(float(temperature)))
    if top_k > 0:
        # tokens equal to the k-th value stay
        kept = F.rank().over(_ranked(name)) <= top_k
        out = out.withColumn(name, F.when(kept, F.col(name)).otherwise(gone))
    if top_p < 1.0:
        # A token stays if the mass in front of it does not exceed top_p, so
        # the likeliest one always stays.
        mass = F.exp(F.col(name) - _log_sum_exp(F.col(name), whole))
        ahead = _ranked(name, "token_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_p", mass)
        out = out.withColumn("_before", F.coalesce(F.sum("_p").over(ahead), F.lit(0.0)))
        out = out.withColumn(name, F.when(F.col("_before") <= top_p, F.col(name)).otherwise(gone))
        out = out.drop("_p", "_before")
    if min_p > 0.0:
        top = F.max(name).over(whole)
        likely = F.exp(F.col(name) - top) >= min_p
        out = out.withColumn(name, F.when(likely, F.col(name)).otherwise(gone))
    return out.withColumn(name, F.col(name) - _log_sum_exp(F.col(name), whole))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def forward_terms(t: Column, s: Column) -> Column:
    """p_t * (t - s); tokens the teacher excludes add nothing."""
    return F.when(finite(t), F.exp(t) * (t - s)).otherwise(F.lit(0.0))


def reverse_terms(t: Column, s: Column) -> Column:
    """p_s * (s - t): infinite where the student uses an excluded token."""
    return F.exp(s) * (s - t)


def divergence(rows: DataFrame, t: str = "t_lp", s: str = "s_lp", reverse_weight: float = 0.0) -> DataFrame:
    """Forward, reverse and mixed KL of each position."""
    forward = F.sum(forward_terms(F.col(t), F.col(s)))
    reverse = F.sum(reverse_terms(F.col(t), F.col(s)))
    mixed = (1.0 - reverse_weight) * F.col("forward")
    if reverse_weight > 0:  # zero times an infinite term would be no number
        mixed = mixed + reverse_weight * F.col("reverse")
    totals = rows.groupBy(*POSITION).agg(forward.alias("forward"), reverse.alias("reverse"))
    return totals.withColumn("mixed", mixed)


def jensen_shannon(rows: DataFrame, t: str = "t_lp", s: str = "s_lp", alpha: float = 0.5) -> DataFrame:
    """Divergence of both sides from their mixture, weighted by alpha."""
    t_lp, s_lp = F.col(t), F.col(s)
    middle = F.ln(alpha * F.exp(t_lp) + (1.0 - alpha) * F.exp(s_lp))
    forward = F.when(finite(t_lp), F.exp(t_lp) * (t_lp - middle)).otherwise(F.lit(0.0))
    back = F.exp(s_lp) * (s_lp - middle)
    return rows.groupBy(*POSITION).agg((alpha * F.sum(forward) + (1.0 - alpha) * F.sum(back)).alias("jsd"))


def masked_means(positions: DataFrame, value: str, mask: str) -> DataFrame:
    """Mean over the masked positions of each sequence; 0 without any."""
    used = F.sum(F.when(F.col(mask), F.col(value)).otherwise(F.lit(0.0)))
    count = F.count_if(mask)
    return positions.groupBy("seq").agg(
        (used / F.greatest(count, F.lit(1))).alias("loss"), count.alias("masked"), F.count("*").alias("positions")
    )


def batch_mean(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.avg("loss").alias("loss"), F.count("*").alias("sequences"))


def masked_nll(positions: DataFrame, lp: str, mask: str) -> DataFrame:
    """Negative log-likelihood of the labels on masked positions."""
    return masked_means(positions.withColumn("_nll", -F.col(lp)), "_nll", mask)


def drift(
    tokens: DataFrame,
    new: str = "logp_new",
    old: str = "logp_old",
    advantage: str = "adv",
    mask: str = "mask",
    eps: float = 0.2,
    per_mask: bool = True,
) -> DataFrame:
    """Policy drift of each sequence.

    Clipped surrogate, the two estimators of the divergence from the old
    policy, and the share of clipped ratios. Sums are divided by the number of
    masked tokens, or by the number of all tokens if ``per_mask`` is off.
    """
    m = F.col(mask)
    gap = F.when(m, F.col(new) - F.col(old)).otherwise(F.lit(0.0))
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    ratio = F.exp(clamp(gap, -10.0, 10.0))
    clipped = clamp(ratio, 1 - eps, 1 + eps)
    surrogate = F.least(ratio * F.col(advantage), clipped * F.col(advantage))
    k3 = F.exp(clamp(-gap, -10.0, 10.0)) - 1.0 + gap
    count = F.greatest(F.count_if(mask) if per_mask else F.count("*"), F.lit(1))

    def total(c: Column) -> Column:
        return F.sum(F.when(m, c).otherwise(F.lit(0.0))) / count

    return tokens.groupBy("seq").agg(
        total(surrogate).alias("surrogate"),
        total(gap).alias("k1"),
        total(k3).alias("k3"),
        total((ratio != clipped).cast("double")).alias("clip_share"),
    )


def soft_cross_entropy(rows: DataFrame, target: str, logprob: str, ignored: str) -> DataFrame:
    """Mean over positions in use of the cross entropy with soft targets."""
    per_position = rows.groupBy(*POSITION).agg(
        F.sum(-F.col(target) * F.col(logprob)).alias("ce"), F.bool_or(ignored).alias("ignored")
    )
    used = F.sum(F.when(~F.col("ignored"), F.col("ce")).otherwise(F.lit(0.0)))
    return per_position.agg(
        (used / F.count_if(~F.col("ignored"))).alias("loss"), F.count_if(~F.col("ignored")).alias("positions")
    )
