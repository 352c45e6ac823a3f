"""Denoising trajectories to training rows (family J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import tokens as tk
from rolloom.functions.hashing import PORTABLE
from rolloom.operators import trajectory as tr
from rolloom.plans.base import query

PAD, END, MASK = 0, 3, 49


def bits(c):
    return F.array_join(F.transform(c, lambda m: F.when(m, "1").otherwise("0")), "")


def joined(c):
    return F.array_join(c, ",")


# Long form of the step maps for the checking side: one row per position.
_LONG = """long AS (SELECT resp_id, source, CAST(i - 1 AS INT) AS pos, step_map[i] AS step FROM f_step, LATERAL (SELECT unnest(range(1, len(step_map) + 1)) AS i) g)"""


@query(
    "j01_align_step_map",
    """SELECT resp_id, array_to_string(CASE WHEN resp_id % 5 = 0 THEN range(0, 10) WHEN len(step_map) >= 10 THEN step_map[1:10]
         ELSE list_concat(step_map, list_transform(range(0, 10 - len(step_map)), lambda x: list_max(step_map) + 1)) END, ',') AS step_map FROM f_step""",
)
def align_step_map(v):
    given = F.when(F.col("resp_id") % 5 != 0, F.col("step_map"))
    return v.f_step.select("resp_id", joined(tr.aligned(given, F.lit(10))).alias("step_map"))


@query(
    "j02_collapse_steps",
    f"""WITH {_LONG}, r AS (SELECT *, (dense_rank() OVER (PARTITION BY resp_id, pos // 4 ORDER BY step) - 1) // 2 AS g FROM long),
      c AS (SELECT resp_id, pos, max(step) OVER (PARTITION BY resp_id, pos // 4, g) AS s FROM r)
    SELECT resp_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY pos) AS step_map FROM c GROUP BY resp_id""",
)
def collapse_steps(v):
    return v.f_step.select("resp_id", joined(tr.collapsed(F.col("step_map"), 2, 4)).alias("step_map"))


def _sql_rounds(k: int) -> str:
    return f"""{_LONG}, r AS (SELECT *, (dense_rank() OVER (PARTITION BY resp_id, pos // 4 ORDER BY step) - 1) // {k} + 1 AS r FROM long),
      m AS (SELECT resp_id, max(r) AS rounds FROM r GROUP BY resp_id),
      x AS (SELECT resp_id, CAST(t AS INT) AS round FROM m, LATERAL (SELECT unnest(range(1, rounds + 1)) AS t) g)"""


@query(
    "j03_round_expansion",
    f"""WITH {_sql_rounds(1)} SELECT x.resp_id, x.round, string_agg(CASE WHEN r = round THEN '1' ELSE '0' END, '' ORDER BY pos) AS target,
        string_agg(CASE WHEN r >= round THEN '1' ELSE '0' END, '' ORDER BY pos) AS noise FROM x JOIN r ON r.resp_id = x.resp_id GROUP BY 1, 2""",
)
def round_expansion(v):
    rows = tr.expand_rounds(v.f_step, k=1, size=4)
    return rows.select("resp_id", "round", bits("target").alias("target"), bits("noise").alias("noise"))


@query(
    "j03_round_expansion_shrunk",
    f"""WITH {_sql_rounds(2)} SELECT x.resp_id, x.round, string_agg(CASE WHEN r = round THEN '1' ELSE '0' END, '' ORDER BY pos) AS target,
        string_agg(CASE WHEN r >= round THEN '1' ELSE '0' END, '' ORDER BY pos) AS noise FROM x JOIN r ON r.resp_id = x.resp_id GROUP BY 1, 2""",
)
def round_expansion_shrunk(v):
    rows = tr.expand_rounds(v.f_step, k=2, size=4)
    return rows.select("resp_id", "round", bits("target").alias("target"), bits("noise").alias("noise"))


# The registered queries draw from MD5, which the checking engine has too; the
# operators' default is a much cheaper hash.
def sql_uniform(seed: int, *keys: str) -> str:
    text = f"concat('{seed}:', {", ':', ".join(f'CAST({k} AS VARCHAR)' for k in keys)})"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496e0)"


def sql_pick(seed: int, n: str, *keys: str) -> str:
    text = f"concat('{seed}:', {", ':', ".join(f'CAST({k} AS VARCHAR)' for k in keys)})"
    return f"(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % ({n}))"


def sql_bits(condition: str) -> str:
    return f"string_agg(CASE WHEN {condition} THEN '1' ELSE '0' END, '' ORDER BY pos)"


@query(
    "j04_one_round_per_block",
    f"""WITH {_sql_rounds(1)}, b AS (SELECT *, {sql_pick(5, 'max(r) OVER (PARTITION BY resp_id, pos // 4)', 'resp_id', 'pos // 4')} + 1 AS t FROM r)
    SELECT resp_id, {sql_bits('r = t')} AS target, {sql_bits('r >= t')} AS noise FROM b GROUP BY resp_id""",
)
def one_round_per_block(v):
    rows = tr.one_round_per_block(v.f_step, "resp_id", seed=5, draws=PORTABLE)
    return rows.select("resp_id", bits("target").alias("target"), bits("noise").alias("noise"))


@query(
    "j05_block_random_mask",
    f"""WITH {_LONG}, u AS (SELECT resp_id, pos, pos // 4 AS blk, {sql_uniform(6, 'resp_id', 'pos')} < {sql_uniform(5, 'resp_id', 'pos // 4')} AS hit FROM long),
      b AS (SELECT *, count(*) FILTER (WHERE hit) OVER w AS hits, count(*) OVER w AS width FROM u WINDOW w AS (PARTITION BY resp_id, blk))
    SELECT resp_id, {sql_bits(f"hit OR (hits = 0 AND pos = blk * 4 + {sql_pick(7, 'width', 'resp_id', 'blk')})")} AS mask FROM b GROUP BY resp_id""",
)
def block_random_mask(v):
    mask = tr.block_random_mask(F.col("resp_id"), F.size("step_map"), 4, seed=5, draws=PORTABLE)
    return v.f_step.select("resp_id", bits(mask).alias("mask"))


_SQL_RANGE = f"{sql_uniform(5, 'resp_id', 'pos')} <= 0.2e0 + (0.8e0 - 0.2e0) * {sql_uniform(6, 'resp_id', 'pos')}"


def _range_mask():
    return tr.range_random_mask(F.col("resp_id"), F.size("step_map"), 0.2, 0.8, seed=5, draws=PORTABLE)


@query("j06_range_random_mask", f"WITH {_LONG} SELECT resp_id, {sql_bits(_SQL_RANGE)} AS mask FROM long GROUP BY resp_id")
def range_random_mask(v):
    return v.f_step.select("resp_id", bits(_range_mask()).alias("mask"))


@query(
    "j07_coupled_masks",
    f"""WITH {_LONG}, h AS (SELECT unnest([0, 1]) AS half) SELECT resp_id, half, {sql_bits(f'({_SQL_RANGE}) = (half = 0)')} AS mask
        FROM long, h GROUP BY resp_id, half""",
)
def coupled_masks(v):
    halves = tr.coupled(v.f_step.select("resp_id", _range_mask().alias("mask")), "mask")
    return halves.select("resp_id", "half", bits("mask").alias("mask"))


@query(
    "j08_mixed_sources",
    f"""WITH {_sql_rounds(1)} SELECT x.resp_id, 'student' AS source, x.round, {sql_bits('r = round')} AS target, {sql_bits('r >= round')} AS noise
        FROM x JOIN r ON r.resp_id = x.resp_id WHERE coalesce(r.source, 'student') = 'student' GROUP BY x.resp_id, x.round
      UNION ALL SELECT resp_id, 'teacher', 1, {sql_bits(_SQL_RANGE)}, {sql_bits(_SQL_RANGE)} FROM long WHERE source = 'teacher' GROUP BY resp_id""",
)
def mixed_sources(v):
    rows = tr.mixed_rows(v.f_step, "resp_id", seed=5, low=0.2, high=0.8, draws=PORTABLE)
    return rows.select("resp_id", "source", "round", bits("target").alias("target"), bits("noise").alias("noise"))


_SQL_TOK = """t AS (SELECT resp_id, prompt_len, CAST(i - 1 AS INT) AS pos, tokens[i] AS tok FROM f_tok, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS i) g)"""
# Noise of the checking rows: every position with (resp_id + pos) % 3 = 0.


def _noise(n):
    return F.transform(F.sequence(F.lit(0), n - 1), lambda p: (F.col("resp_id") + p) % 3 == 0)


@query(
    "j09_extended_sequence",
    f"""WITH {_SQL_TOK} SELECT resp_id, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos) || ',' ||
        string_agg(CAST(CASE WHEN (resp_id + pos - 6) % 3 = 0 THEN {MASK} ELSE tok END AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos >= 6) AS extended,
        string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos) AS labels FROM t GROUP BY resp_id""",
)
def extended_sequence(v):
    noise = _noise(F.size("tokens") - F.col("prompt_len"))
    ext = tr.extended(F.col("tokens"), F.col("prompt_len"), noise, MASK)
    return v.f_tok.select("resp_id", joined(ext).alias("extended"), joined(tr.labels(F.col("tokens"))).alias("labels"))


_TARGET = "(pos >= 6 AND (resp_id + pos) % 3 <> 0)"


def _target():
    return F.transform("tokens", lambda t, i: (i >= 6) & ((F.col("resp_id") + i) % 3 != 0))


@query(
    "j10_limit_pad_targets",
    f"""WITH {_SQL_TOK}, c AS (SELECT *, sum(CASE WHEN {_TARGET} AND tok = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY resp_id ORDER BY pos) AS n FROM t)
    SELECT resp_id, string_agg(CASE WHEN {_TARGET} AND NOT (tok = 0 AND n > 2) THEN '1' ELSE '0' END, '' ORDER BY pos) AS target FROM c GROUP BY resp_id""",
)
def limit_pad_targets(v):
    kept = tr.limit_pad_targets(_target(), F.col("tokens"), PAD, 2)
    return v.f_tok.select("resp_id", bits(kept).alias("target"))


@query(
    "j11_position_ids",
    f"""WITH {_SQL_TOK}, c AS (SELECT *, pos >= prompt_len OR tok <> 0 AS ok, tok <> 0 AS filled FROM t),
      d AS (SELECT *, CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w - 1 ELSE 1 END AS p,
        CASE WHEN filled THEN sum(CASE WHEN filled THEN 1 ELSE 0 END) OVER w - 1 ELSE 0 END AS q FROM c WINDOW w AS (PARTITION BY resp_id ORDER BY pos))
    SELECT resp_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) || ',' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos >= prompt_len) AS positions,
      string_agg(CAST(q AS VARCHAR), ',' ORDER BY pos) AS sampler FROM d GROUP BY resp_id""",
)
def position_ids(v):
    t = F.col("tokens")
    return v.f_tok.select(
        "resp_id",
        joined(tr.position_ids(t, F.col("prompt_len"), PAD)).alias("positions"),
        joined(tr.sampler_position_ids(t, PAD)).alias("sampler"),
    )


@query(
    "j12_rows_with_target",
    f"""WITH {_SQL_TOK} SELECT resp_id, count(*) FILTER (WHERE {_TARGET} AND tok % 7 = 5) AS targets FROM t GROUP BY resp_id HAVING count(*) FILTER (WHERE {_TARGET} AND tok % 7 = 5) > 0""",
)
def rows_with_target(v):
    target = F.zip_with(_target(), F.col("tokens"), lambda m, t: m & (t % 7 == 5))
    rows = tr.with_target(v.f_tok.select("resp_id", target.alias("target")))
    return rows.select("resp_id", F.size(F.filter("target", lambda m: m)).cast("bigint").alias("targets"))


def _ragged(v):
    """Prompts of 3 to 8 tokens, responses of 4 to 14, batches of 8."""
    r = F.col("resp_id")
    prompt = F.slice("tokens", F.lit(1), (3 + r % 6).cast("int"))
    response = F.slice("tokens", F.lit(5), (4 + r % 11).cast("int"))
    return v.f_tok.select("resp_id", F.floor(r / 8).cast("bigint").alias("batch"), prompt.alias("prompt"), response.alias("response"))


@query(
    "j13_padded_batch",
    """WITH g AS (SELECT resp_id, resp_id // 8 AS batch, tokens[1 : 3 + resp_id % 6] AS p, tokens[5 : 8 + resp_id % 11] AS r FROM f_tok WHERE 3 + resp_id % 6 <= 7),
      w AS (SELECT batch, max(len(p)) AS pw, least(max(len(r)), 12) AS rw FROM g GROUP BY batch)
    SELECT g.resp_id, CAST(pw AS INT) AS prompt_len, array_to_string(list_concat(list_concat(list_transform(range(0, pw - len(p)), lambda x: 0), p),
      list_concat(r[1:rw], list_transform(range(0, rw - len(r[1:rw])), lambda x: 0))), ',') AS tokens FROM g JOIN w ON w.batch = g.batch""",
)
def padded_batch(v):
    rows = tr.within_prompt_limit(_ragged(v), "prompt", 7)
    return tr.padded_batch(rows, "batch", "prompt", "response", PAD, 12).select(
        "resp_id", "prompt_len", joined("tokens").alias("tokens")
    )


@query(
    "j13_prompt_limit_report",
    "SELECT count(*) FILTER (WHERE 3 + resp_id % 6 > 7) AS dropped, count(*) FILTER (WHERE 3 + resp_id % 6 <= 7) AS kept FROM f_tok",
)
def prompt_limit_report(v):
    return tr.prompt_limit_report(_ragged(v), "prompt", 7)


@query(
    "j14_loss_mask",
    f"""WITH {_SQL_TOK}, n AS (SELECT *, CASE WHEN pos >= 6 AND (resp_id + pos - 6) % 3 = 0 THEN {MASK} ELSE tok END AS noised FROM t),
      e AS (SELECT *, coalesce(min(CASE WHEN pos >= 6 AND tok = {END} THEN pos END) OVER (PARTITION BY resp_id), 20) AS fin FROM n)
    SELECT resp_id, string_agg(CASE WHEN pos >= 6 AND pos <= fin AND noised = {MASK} THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask,
      string_agg(CASE WHEN pos >= 6 AND pos < fin AND noised = {MASK} THEN '1' ELSE '0' END, '' ORDER BY pos) AS strict FROM e GROUP BY resp_id""",
)
def loss_mask(v):
    t, n = F.col("tokens"), F.col("prompt_len")
    noise = F.transform("tokens", lambda x, i: F.when((i >= 6) & ((F.col("resp_id") + i - 6) % 3 == 0), F.lit(MASK)).otherwise(x))
    return v.f_tok.select(
        "resp_id",
        bits(tr.loss_mask(t, noise, n, PAD, END, MASK)).alias("mask"),
        bits(tr.loss_mask(t, noise, n, PAD, END, MASK, exclude_end=True)).alias("strict"),
    )


@query(
    "j15_decode_cut",
    f"""WITH {_SQL_TOK}, c AS (SELECT *, coalesce(min(CASE WHEN pos >= 6 AND tok IN ({END}, {PAD}, {MASK}) THEN pos END) OVER (PARTITION BY resp_id), 20) AS cut FROM t)
    SELECT resp_id, coalesce(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos >= 6 AND pos < cut), '') AS tokens FROM c GROUP BY resp_id""",
)
def decode_cut(v):
    response = F.slice("tokens", F.col("prompt_len") + 1, F.size("tokens"))
    return v.f_tok.select("resp_id", joined(tr.decode_cut(response, [END, PAD, MASK])).alias("tokens"))


@query(
    "j16_clean_token_ids",
    f"""WITH {_SQL_TOK} SELECT resp_id, string_agg(CAST(CASE WHEN (x IS NULL OR x < 0 OR x >= 40 OR x = {MASK}) AND coalesce(x NOT IN (45), true) THEN 0 ELSE x END AS VARCHAR), ',' ORDER BY pos) AS tokens
       FROM (SELECT resp_id, pos, CASE WHEN tok = 7 THEN -1 WHEN tok <> 9 THEN tok END AS x FROM t) y GROUP BY resp_id""",
)
def clean_token_ids(v):
    raw = F.transform("tokens", lambda t: F.when(t == 7, F.lit(-1)).when(t != 9, t))
    return v.f_tok.select("resp_id", joined(tr.cleaned_ids(raw, 40, MASK, [45])).alias("tokens"))


@query(
    "j17_response_length",
    """SELECT resp_id, CAST(len(list_filter(regexp_split_to_array(replace(concat(response, '<|pad|><|pad|>'), '<|pad|>', ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS INT) AS n_tokens FROM f_resp""",
)
def response_length(v):
    padded = F.concat(F.col("response"), F.lit("<|pad|><|pad|>"))
    return v.f_resp.select("resp_id", tk.token_length(padded, "<|pad|>").alias("n_tokens"))


_SQL_MASKED = "CAST(greatest(round_even({n} * (0.1e0 + (resp_id % 8) / 10.0e0), 0), 1) AS INT)"


@query(
    "j18_sequence_masking",
    f"""WITH {_SQL_TOK}, m AS (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY md5(concat('5:', CAST(resp_id AS VARCHAR), ':', CAST(pos AS VARCHAR))))
        <= {_SQL_MASKED.format(n=20)} AS hit FROM t)
    SELECT resp_id, {_SQL_MASKED.format(n=20)} AS n_masked, {sql_bits('hit')} AS mask,
      string_agg(CAST(CASE WHEN hit THEN {MASK} ELSE tok END AS VARCHAR), ',' ORDER BY pos) AS inputs,
      string_agg(CAST(CASE WHEN hit THEN tok ELSE -100 END AS VARCHAR), ',' ORDER BY pos) AS labels FROM m GROUP BY resp_id""",
)
def sequence_masking(v):
    r = F.col("resp_id")
    ratio = 0.1 + (r % 8) / 10.0
    count = tr.masked_count(F.size("tokens"), ratio)
    rows = v.f_tok.withColumn("mask", tr.scattered_mask(r, F.size("tokens"), count, seed=5, draws=PORTABLE))
    return rows.select(
        "resp_id",
        count.alias("n_masked"),
        bits("mask").alias("mask"),
        joined(tr.masked_inputs(F.col("tokens"), F.col("mask"), MASK)).alias("inputs"),
        joined(tr.masked_labels(F.col("tokens"), F.col("mask"))).alias("labels"),
    )


@query(
    "j18_rectangle_masking",
    f"""WITH c AS (SELECT resp_id, {_SQL_MASKED.format(n=16)} AS n FROM f_tok),
      h AS (SELECT *, CAST(ceil(n / 4.0) AS INT) AS lo FROM c),
      g AS (SELECT *, least(lo + {sql_pick(5, 'greatest(least(4, n), lo) - lo + 1', 'resp_id')}, 4) AS ht FROM h),
      w AS (SELECT *, least(CAST(ceil(n / CAST(ht AS DOUBLE)) AS INT), 4) AS wd FROM g),
      p AS (SELECT *, {sql_pick(6, '4 - ht + 1', 'resp_id')} AS y, {sql_pick(7, '4 - wd + 1', 'resp_id')} AS x FROM w),
      m AS (SELECT p.*, pos, pos // 4 >= y AND pos // 4 < y + ht AND pos % 4 >= x AND pos % 4 < x + wd AS hit FROM p, LATERAL (SELECT unnest(range(0, 16)) AS pos) q)
    SELECT resp_id, n AS n_masked, {sql_bits('hit')} AS mask,
      round(sum(CASE WHEN hit THEN 1.0e0 ELSE 1.0e0 - (1.0e0 - (0.1e0 + (resp_id % 8) / 10.0e0)) * 0.7e0 END), 9) AS weight FROM m GROUP BY resp_id, n""",
)
def rectangle_masking(v):
    r = F.col("resp_id")
    grid = F.slice("tokens", 1, 16)
    count = tr.masked_count(F.size(grid), 0.1 + (r % 8) / 10.0)
    rows = v.f_tok.withColumn("mask", tr.rectangle_mask(r, F.size(grid), count, seed=5, draws=PORTABLE))
    weights = tr.loss_weights(F.col("mask"), 0.1 + (r % 8) / 10.0)
    return rows.select(
        "resp_id", count.alias("n_masked"), bits("mask").alias("mask"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 9).alias("weight"),
    )


@query(
    "j19_commit_rule",
    f"""WITH {_SQL_TOK}, c AS (SELECT *, min(CASE WHEN pos >= 6 AND tok IN ({END}, 10) THEN pos END) OVER (PARTITION BY resp_id) AS stop FROM t),
      k AS (SELECT *, least(coalesce(stop + 1, 20), 20, 6 + 9) AS kept FROM c)
    SELECT resp_id, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos < kept) AS tokens,
      coalesce(string_agg(CAST((resp_id + pos) % 5 AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos >= 6 AND pos < kept), '') AS steps,
      bool_or(kept >= 15 OR coalesce(stop < kept, false)) AS finished FROM k GROUP BY resp_id""",
)
def commit_rule(v):
    steps = F.transform("tokens", lambda t, i: ((F.col("resp_id") + i) % 5).cast("int"))
    done = tr.committed(F.col("tokens"), steps, F.col("prompt_len"), [END, 10], 9)
    rows = v.f_tok.select("resp_id", done.alias("c"))
    return rows.select(
        "resp_id", joined("c.tokens").alias("tokens"), joined("c.steps").alias("steps"), F.col("c.finished").alias("finished")
    )


# What must hold for any draw, checked on all rows with the default hash.
_BLOCKS = "CAST(ceil(len(step_map) / 4.0) AS INT)"


def _per_block(mask, n):
    """Number of masked positions of each block."""
    blocks = F.sequence(F.lit(0), (F.ceil(n / 4) - 1).cast("int"))
    return F.transform(blocks, lambda b: F.size(F.filter(F.slice(mask, b * 4 + 1, 4), lambda m: m)))


@query(
    "j04_block_round_invariants",
    f"SELECT resp_id, {_BLOCKS} AS blocks_with_target, true AS target_in_noise, true AS one_step_per_block FROM f_step",
)
def block_round_invariants(v):
    rows = tr.one_round_per_block(v.f_step, "resp_id", seed=5)
    hit = F.filter(_per_block(F.col("target"), F.size("step_map")), lambda n: n > 0)
    steps = F.zip_with("target", "step_map", lambda t, s: F.when(t, s))

    def single(b):
        return F.size(F.array_distinct(F.filter(F.slice(steps, b * 4 + 1, 4), lambda s: s.isNotNull()))) == 1

    blocks = F.sequence(F.lit(0), (F.ceil(F.size("step_map") / 4) - 1).cast("int"))
    return rows.select(
        "resp_id",
        F.size(hit).alias("blocks_with_target"),
        F.forall(F.zip_with("target", "noise", lambda t, n: ~t | n), lambda ok: ok).alias("target_in_noise"),
        F.forall(blocks, single).alias("one_step_per_block"),
    )


@query("j05_block_mask_invariants", f"SELECT resp_id, {_BLOCKS} AS blocks_with_mask, CAST(len(step_map) AS INT) AS length FROM f_step")
def block_mask_invariants(v):
    mask = tr.block_random_mask(F.col("resp_id"), F.size("step_map"), 4, seed=5)
    rows = v.f_step.select("resp_id", mask.alias("mask"))
    hit = F.filter(_per_block(F.col("mask"), F.size("mask")), lambda n: n > 0)
    return rows.select("resp_id", F.size(hit).alias("blocks_with_mask"), F.size("mask").alias("length"))


@query(
    "j07_coupled_invariants",
    "SELECT resp_id, len(step_map) AS covered, CAST(2 AS BIGINT) AS halves FROM f_step",
)
def coupled_invariants(v):
    mask = tr.range_random_mask(F.col("resp_id"), F.size("step_map"), 0.2, 0.8, seed=5)
    halves = tr.coupled(v.f_step.select("resp_id", mask.alias("mask")), "mask")
    return halves.groupBy("resp_id").agg(
        F.sum(F.size(F.filter("mask", lambda m: m))).alias("covered"), F.count("*").alias("halves")
    )


@query(
    "j18_masking_invariants",
    "SELECT resp_id, CAST(greatest(round_even(20 * (0.1 + (resp_id % 8) / 10.0), 0), 1) AS INT) AS masked, true AS labels_match FROM f_tok",
)
def masking_invariants(v):
    r = F.col("resp_id")
    count = tr.masked_count(F.size("tokens"), 0.1 + (r % 8) / 10.0)
    rows = v.f_tok.withColumn("mask", tr.scattered_mask(r, F.size("tokens"), count, seed=5))
    rows = rows.withColumn("labels", tr.masked_labels(F.col("tokens"), F.col("mask")))
    fits = F.zip_with("mask", F.zip_with("tokens", "labels", lambda t, x: t == x), lambda m, same: m == same)
    return rows.select(
        "resp_id", F.size(F.filter("mask", lambda m: m)).alias("masked"), F.forall(fits, lambda ok: ok).alias("labels_match")
    )
