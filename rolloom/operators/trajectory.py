"""Denoising trajectories to training rows.

A response is one row with arrays: its tokens and its step map, which names
for every position the step that unmasked it. All operators here are
expressions over such a row. They need no shuffle, and the memory they use is
bounded by the length of one response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.hashing import FAST, Draws
from rolloom.functions.text import let


def _positions(n: Column) -> Column:
    """0 .. n-1; empty for n = 0 (a plain sequence would count down)."""
    empty = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(empty)


def _block(array: Column, pos: Column, size: int) -> Column:
    """The slice of the block that holds a position."""
    return F.slice(array, (F.floor(pos / size) * size + 1).cast("int"), size)


# --- step maps ---------------------------------------------------------------
def aligned(steps: Column, length: Column) -> Column:
    """Step map cut or padded to the response's length.

    Missing maps number the positions; padding gets one step more than the
    largest.
    """
    length = length.cast("int")
    padding = F.array_repeat(F.array_max(steps) + 1, F.greatest(length - F.size(steps), F.lit(0)))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, _positions(length)).otherwise(
        F.concat(F.slice(steps, F.lit(1), length), padding)
    )


def collapsed(steps: Column, k: int, size: int) -> Column:
    """Inside each block, every k distinct steps become the last of them."""

    def one(step: Column, pos: Column) -> Column:
        def within(distinct: Column) -> Column:
            rank = F.array_position(distinct, step) - 1
            last = F.least((F.floor(rank / k) + 1) * k, F.size(distinct)).cast("int")
            return F.element_at(distinct, last)

        return let(F.array_sort(F.array_distinct(_block(steps, pos, size))), within)

    return F.transform(steps, one)


def rounds(steps: Column, k: int, size: int) -> Column:
    """Round of each position: the group of its step within its block."""

    def one(step: Column, pos: Column) -> Column:
        earlier = F.filter(F.array_distinct(_block(steps, pos, size)), lambda s: s < step)
        return (F.floor(F.size(earlier) / k) + 1).cast("int")

    return F.transform(steps, one)


def expand_rounds(rows: DataFrame, steps: str = "step_map", k: int = 1, size: int = 4) -> DataFrame:
    """One row per denoising round of a response.

    ``target`` marks the positions unmasked in the round, ``noise`` those not
    unmasked before it. The number of rounds is at most ``ceil(size / k)``,
    so the rows grow by a constant.
    """
    ranked = rows.withColumn("_r", rounds(F.col(steps), k, size))
    each = ranked.withColumn("round", F.explode(F.transform(_positions(F.array_max("_r")), lambda i: i + 1)))
    t = F.col("round")
    return each.select(
        *rows.columns,
        "round",
        F.transform("_r", lambda r: r == t).alias("target"),
        F.transform("_r", lambda r: r >= t).alias("noise"),
    )


def one_round_per_block(
    rows: DataFrame, key: str, seed: int, steps: str = "step_map", k: int = 1, size: int = 4, draws: Draws = FAST
) -> DataFrame:
    """One row per response: each block shows a round drawn for it alone."""
    ranked = rows.withColumn("_r", rounds(F.col(steps), k, size))

    def drawn(pos: Column) -> Column:
        count = F.array_max(_block(F.col("_r"), pos, size))
        return draws.pick(seed, count, F.col(key), F.floor(pos / size)) + 1

    return ranked.select(
        *rows.columns,
        F.transform("_r", lambda r, p: r == drawn(p)).alias("target"),
        F.transform("_r", lambda r, p: r >= drawn(p)).alias("noise"),
    )


# --- random masks ------------------------------------------------------------
def block_random_mask(key: Column, length: Column, size: int, seed: int, draws: Draws = FAST) -> Column:
    """A ratio per block, a draw per position, at least one masked per block."""

    def draw(pos: Column) -> Column:
        return draws.uniform(seed + 1, key, pos)

    def one(pos: Column) -> Column:
        blk = F.floor(pos / size)
        first = blk * size
        width = F.least(F.lit(size), length - first)
        ratio = draws.uniform(seed, key, blk)
        block = F.transform(_positions(width.cast("int")), lambda i: draw((i + first).cast("int")))
        none = ~F.exists(block, lambda u: u < ratio)
        forced = first + draws.pick(seed + 2, width, key, blk)
        return (draw(pos) < ratio) | (none & (pos == forced))

    return F.transform(_positions(length.cast("int")), one)


def range_random_mask(
    key: Column, length: Column, low: float, high: float, seed: int, draws: Draws = FAST
) -> Column:
    """Masked where one draw does not exceed another from [low, high]."""

    def one(pos: Column) -> Column:
        bar = F.lit(low) + F.lit(high - low) * draws.uniform(seed + 1, key, pos)
        return draws.uniform(seed, key, pos) <= bar

    return F.transform(_positions(length.cast("int")), one)


def coupled(rows: DataFrame, mask: str) -> DataFrame:
    """Two rows per response: the mask and its complement."""
    both = F.array(F.col(mask), F.transform(mask, lambda m: ~m))
    others = [c for c in rows.columns if c != mask]
    return rows.select(*others, F.posexplode(both).alias("half", mask))


def mixed_rows(
    rows: DataFrame, key: str, seed: int, low: float, high: float, k: int = 1, size: int = 4, draws: Draws = FAST
) -> DataFrame:
    """Teacher rows get one random mask, student rows their rounds, in one pass."""
    source = F.coalesce("source", F.lit("student"))
    is_teacher = source == "teacher"
    mask = range_random_mask(F.col(key), F.size("step_map"), low, high, seed, draws)
    # a teacher's row has a single round and no ranks, a student's row no mask
    ranked = rows.select(
        *[source.alias(c) if c == "source" else c for c in rows.columns],
        F.when(~is_teacher, rounds(F.col("step_map"), k, size)).alias("_r"),
        F.when(is_teacher, mask).alias("_m"),
    )
    count = F.when(F.col("source") == "teacher", F.lit(1)).otherwise(F.array_max("_r"))
    each = ranked.withColumn("round", F.explode(F.transform(_positions(count), lambda i: i + 1)))
    t = F.col("round")
    return each.select(
        *rows.columns,
        "round",
        F.coalesce("_m", F.transform("_r", lambda r: r == t)).alias("target"),
        F.coalesce("_m", F.transform("_r", lambda r: r >= t)).alias("noise"),
    )


# --- token rows --------------------------------------------------------------
def extended(tokens: Column, prompt_len: Column, noise: Column, mask_id: int) -> Column:
    """Prompt, clean response, and the response with its noise masked."""
    clean = F.slice(tokens, prompt_len + 1, F.size(tokens))
    noised = F.zip_with(clean, noise, lambda t, m: F.when(m, F.lit(mask_id)).otherwise(t))
    return F.concat(tokens, noised)


def labels(tokens: Column) -> Column:
    return tokens


def limit_pad_targets(target: Column, tokens: Column, pad_id: int, most: int) -> Column:
    """Keep at most ``most`` targets that are padding, the first ones.

    All padding targets from number ``most`` on are dropped, so one position
    decides for the whole row.
    """
    is_pad = F.zip_with(target, tokens, lambda m, t: m & (t == pad_id))
    first_dropped = F.get(_indexes(is_pad), F.lit(most))

    def drop_from(cut: Column) -> Column:
        flags = F.zip_with(target, tokens, lambda m, t: F.struct(m.alias("m"), (t == pad_id).alias("pad")))
        return F.transform(flags, lambda f, i: f["m"] & ~(f["pad"] & F.coalesce(i >= cut, F.lit(False))))

    return let(first_dropped, drop_from)


def _indexes(flags: Column) -> Column:
    """0-based positions of the true flags."""
    return F.filter(F.transform(flags, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def _skips(tokens: Column, pad_id: int) -> Column:
    """Padding that can precede a token: the run at the left, and the rest.

    Rows are padded in one run at the left and one at the right. Counting the
    left run as a number and dropping the right one leaves a short list, so
    positions are found in one pass.
    """
    pads = _indexes(F.transform(tokens, lambda t: t == pad_id))
    first = F.coalesce(_first(tokens, lambda t, i: t != pad_id), F.size(tokens))
    last = F.size(tokens) - 1 - F.coalesce(
        _first(F.reverse(tokens), lambda t, i: t != pad_id), F.size(tokens)
    )
    inner = F.filter(pads, lambda i: (i > first) & (i < last))
    return F.struct(first.alias("run"), inner.alias("inner"))


def _place(i: Column, skips: Column) -> Column:
    """Index less the padding up to it."""
    return i - F.least(i + 1, skips["run"]) - F.size(F.filter(skips["inner"], lambda p: p <= i))


def position_ids(tokens: Column, prompt_len: Column, pad_id: int, invalid: int = 1) -> Column:
    """Positions that skip padding in the prompt.

    Skipped positions get ``invalid``; every position of the response counts.
    The response's positions are repeated for its noised copy.
    """

    def number(skips: Column) -> Column:
        return F.transform(
            tokens,
            lambda t, i: F.when((i < prompt_len) & (t == pad_id), F.lit(invalid)).otherwise(_place(i, skips)),
        )

    # the sentinel keeps padding at the end of the prompt inside the list
    prompt = F.concat(F.slice(tokens, F.lit(1), prompt_len), F.array(F.lit(pad_id + 1)))
    ids = let(_skips(prompt, pad_id), number)
    return let(ids, lambda x: F.concat(x, F.slice(x, prompt_len + 1, F.size(tokens))))


def sampler_position_ids(tokens: Column, pad_id: int) -> Column:
    """Running count of the tokens that are no padding, 0 at padding."""

    def number(skips: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.when(t != pad_id, _place(i, skips)).otherwise(F.lit(0)))

    return let(_skips(tokens, pad_id), number)


def with_target(rows: DataFrame, target: str = "target") -> DataFrame:
    """Rows that have something to learn from."""
    return rows.filter(F.exists(target, lambda m: m))


def within_prompt_limit(rows: DataFrame, prompt: str, limit: int) -> DataFrame:
    return rows.filter(F.size(prompt) <= limit)


def prompt_limit_report(rows: DataFrame, prompt: str, limit: int) -> DataFrame:
    return rows.agg(
        F.count_if(F.size(prompt) > limit).alias("dropped"), F.count_if(F.size(prompt) <= limit).alias("kept")
    )


def padded_batch(rows: DataFrame, batch: str, prompt: str, response: str, pad_id: int, max_gen: int) -> DataFrame:
    """Prompts padded at the left, responses at the right, to batch width.

    The response width is the longest of the batch, at most ``max_gen``.
    Widths are two numbers per batch, joined back to its rows.
    """
    widths = rows.groupBy(batch).agg(
        F.max(F.size(prompt)).alias("_p"), F.least(F.max(F.size(response)), F.lit(max_gen)).alias("_r")
    )
    joined = rows.join(widths, batch)
    left = F.array_repeat(F.lit(pad_id), F.col("_p") - F.size(prompt))
    right = F.array_repeat(F.lit(pad_id), F.greatest(F.col("_r") - F.size(response), F.lit(0)))
    tokens = F.concat(left, F.col(prompt), F.slice(response, F.lit(1), F.col("_r")), right)
    return joined.select(*rows.columns, F.col("_p").alias("prompt_len"), tokens.alias("tokens"))


def _first(tokens: Column, condition) -> Column:
    """0-based index of the first token that meets the condition, or NULL."""
    return F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(condition(t, i), i)), lambda i: i.isNotNull()))


def loss_mask(
    tokens: Column, noised: Column, prompt_len: Column, pad_id: int, end_id: int, mask_id: int, exclude_end: bool = False
) -> Column:
    """Masked response positions up to the first end token.

    ``tokens`` is the clean sequence, ``noised`` the same with the noised
    response. The end token itself counts unless excluded.
    """
    end = F.coalesce(_first(tokens, lambda t, i: (i >= prompt_len) & (t == end_id)), F.size(tokens))

    def with_end(last: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = (i < last) if exclude_end else (i <= last)
            return (i >= prompt_len) & before & (t != pad_id) & (t == mask_id)

        return F.transform(noised, one)

    return let(end, with_end)


def decode_cut(tokens: Column, stops: list[int]) -> Column:
    """Tokens before the first stop id."""
    cut = F.coalesce(_first(tokens, lambda t, i: t.isin(stops)), F.size(tokens))
    return F.slice(tokens, F.lit(1), cut)


def cleaned_ids(tokens: Column, vocab: int, mask_id: int, special: list[int]) -> Column:
    """Ids outside the vocabulary and mask ids become 0, special ids stay."""

    def one(t: Column) -> Column:
        bad = t.isNull() | (t < 0) | (t >= vocab) | (t == mask_id)
        keep = F.coalesce(t.isin(special), F.lit(False)) if special else F.lit(False)
        return F.when(bad & ~keep, F.lit(0)).otherwise(t)

    return F.transform(tokens, one)


def committed(tokens: Column, steps: Column, prompt_len: Column, stops: list[int], budget: int) -> Column:
    """Tokens up to the first stop id of the completion or the budget.

    Returns a struct: the committed ``tokens``, the ``steps`` of the
    completion alone, and whether the sequence is ``finished``. Stop ids in
    the prompt do not count; the stop token itself is kept.
    """
    stop = _first(tokens, lambda t, i: (i >= prompt_len) & t.isin(stops))
    kept = F.least(
        F.coalesce(stop + 1, F.size(tokens)), F.size(tokens), F.greatest(prompt_len, F.lit(0)) + budget
    )

    def cut(n: Column) -> Column:
        done = (stop.isNotNull() & (stop < n)) | (n >= prompt_len + budget)
        return F.struct(
            F.slice(tokens, F.lit(1), n).alias("tokens"),
            F.slice(steps, prompt_len + 1, F.greatest(n - prompt_len, F.lit(0))).alias("steps"),
            done.alias("finished"),
        )

    return let(kept, cut)


# --- whole-sequence masking --------------------------------------------------
IGNORED = -100  # fixed value: label of positions without loss


def masked_count(length: Column, ratio: Column) -> Column:
    """Number of masked positions: rounded half to even, at least one."""
    return F.greatest(F.bround(length * ratio, 0), F.lit(1)).cast("int")


def scattered_mask(key: Column, length: Column, count: Column, seed: int, draws: Draws = FAST) -> Column:
    """``count`` positions: those whose hash is among the smallest."""
    ranked = F.transform(
        _positions(length), lambda p: F.struct(draws.order(seed, key, p).alias("h"), p.alias("p"))
    )

    def mark(items: Column) -> Column:
        bar = F.get(F.array_sort(items), count - 1)
        return let(bar, lambda last: F.transform(items, lambda item: item <= last))

    return let(ranked, mark)


def rectangle_mask(key: Column, length: Column, count: Column, seed: int, draws: Draws = FAST) -> Column:
    """A rectangle of about ``count`` cells on the square grid of the tokens."""
    side = F.floor(F.sqrt(length)).cast("int")

    def between(n: int, lo: Column, hi: Column) -> Column:
        return (lo + draws.pick(seed + n, hi - lo + 1, key)).cast("int")

    low = F.ceil(count / side).cast("int")
    height = F.least(between(0, low, F.greatest(F.least(side, count), low)), side)

    def place(h: Column) -> Column:
        width = F.least(F.ceil(count / h).cast("int"), side)
        shape = F.struct(
            h.alias("h"),
            width.alias("w"),
            between(1, F.lit(0), side - h).alias("y"),
            between(2, F.lit(0), side - width).alias("x"),
        )

        def fill(s: Column) -> Column:
            def inside(p: Column) -> Column:
                row, col = F.floor(p / side), p % side
                return (
                    (row >= s["y"]) & (row < s["y"] + s["h"]) & (col >= s["x"]) & (col < s["x"] + s["w"])
                )

            return F.transform(_positions(length), inside)

        return let(shape, fill)

    return let(height, place)


def masked_inputs(tokens: Column, mask: Column, mask_id: int) -> Column:
    return F.zip_with(tokens, mask, lambda t, m: F.when(m, F.lit(mask_id)).otherwise(t))


def masked_labels(tokens: Column, mask: Column) -> Column:
    return F.zip_with(tokens, mask, lambda t, m: F.when(m, t).otherwise(F.lit(IGNORED)))


def loss_weights(mask: Column, ratio: Column, floor: float = 0.3) -> Column:
    """1 at masked positions, less at the others the lower the ratio."""
    drop = (F.lit(1.0) - ratio) * (1.0 - floor)
    return F.transform(mask, lambda m: F.when(m, F.lit(1.0)).otherwise(F.lit(1.0) - drop))
