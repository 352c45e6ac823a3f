"""Trajectory operators against a direct simulation of the rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rolloom.functions.plugins import ExpandRounds
from rolloom.operators import trajectory as tr


def simulated_rounds(steps, k, size):
    """Rounds by repeatedly unmasking the lowest group of every block."""
    groups = []
    for start in range(0, len(steps), size):
        block = steps[start : start + size]
        order = sorted(set(block))
        groups += [order.index(s) // k for s in block]
    left, out = list(groups), []
    while any(g is not None for g in left):
        target, noise = [], []
        for start in range(0, len(left), size):
            block = left[start : start + size]
            alive = [g for g in block if g is not None]
            low = min(alive) if alive else None
            target += [g is not None and g == low for g in block]
            noise += [g is not None and g >= low for g in block] if alive else [False] * len(block)
        out.append((target, noise))
        left = [None if t else g for g, t in zip(left, target)]
    return out


def random_maps(n=300, seed=0):
    rng = random.Random(seed)
    return [(i, [rng.randint(0, 6) for _ in range(rng.randint(1, 23))]) for i in range(n)]


@pytest.fixture(scope="module")
def maps(spark):
    return random_maps(), spark.createDataFrame(random_maps(), "id int, step_map array<int>").repartition(5)


@pytest.mark.parametrize("k,size", [(1, 4), (2, 4), (3, 8), (1, 1), (1, 32)])
def test_round_expansion(maps, k, size):
    plain, frame = maps
    got = {(r.id, r.round): (r.target, r.noise) for r in tr.expand_rounds(frame, k=k, size=size).collect()}
    want = {
        (i, t + 1): pair for i, steps in plain for t, pair in enumerate(simulated_rounds(steps, k, size))
    }
    assert got == want
    table = {(i, t): (a, b) for i, steps in plain for t, a, b in ExpandRounds().eval(steps, k, size)}
    assert table == want


def test_collapse(maps):
    plain, frame = maps

    def collapse(steps, k, size):
        out = []
        for s in range(0, len(steps), size):
            block = steps[s : s + size]
            order = sorted(set(block))
            out += [order[min((order.index(v) // k + 1) * k, len(order)) - 1] for v in block]
        return out

    rows = frame.select("id", tr.collapsed(F.col("step_map"), 2, 4).alias("c")).collect()
    assert {r.id: r.c for r in rows} == {i: collapse(s, 2, 4) for i, s in plain}


def test_aligned(apply):
    rows = [([3, 1],), ([],), (None,), ([1, 2, 3, 4, 5],)]
    assert apply(tr.aligned(F.col("s"), F.lit(4)), rows, "s array<int>") == [
        [3, 1, 4, 4], [0, 1, 2, 3], [0, 1, 2, 3], [1, 2, 3, 4],
    ]


def test_one_round_per_block(maps):
    plain, frame = maps
    rows = tr.one_round_per_block(frame, "id", seed=1).collect()
    drawn = set()
    for r in rows:
        possible = simulated_rounds(r.step_map, 1, 4)
        for s in range(0, len(r.step_map), 4):
            block = (r.target[s : s + 4], r.noise[s : s + 4])
            matching = [t for t, (a, b) in enumerate(possible) if any(a[s : s + 4]) and (a[s : s + 4], b[s : s + 4]) == block]
            assert matching, r
            drawn.update(matching)
    assert len(drawn) > 1
    again = tr.one_round_per_block(frame.repartition(2), "id", seed=1).collect()
    assert {r.id: r.target for r in rows} == {r.id: r.target for r in again}


def test_block_random_mask(maps):
    _, frame = maps
    mask = tr.block_random_mask(F.col("id"), F.size("step_map"), 4, seed=9)
    rows = frame.select("step_map", mask.alias("m")).collect()
    assert all(any(r.m[s : s + 4]) for r in rows for s in range(0, len(r.m), 4))
    assert all(len(r.m) == len(r.step_map) for r in rows)
    share = sum(map(sum, (r.m for r in rows))) / sum(len(r.m) for r in rows)
    assert 0.45 < share < 0.75


def test_range_random_mask_and_complement(spark):
    frame = spark.range(400).select("id", tr.range_random_mask(F.col("id"), F.lit(50), 0.2, 0.8, 1).alias("m"))
    share = frame.select(F.avg(F.size(F.filter("m", lambda m: m)))).first()[0] / 50
    assert share == pytest.approx(0.5, abs=0.03)
    halves = tr.coupled(frame, "m").collect()
    by_id = {}
    for r in halves:
        by_id.setdefault(r.id, {})[r.half] = r.m
    assert all([a != b for a, b in zip(h[0], h[1])] == [True] * 50 for h in by_id.values())


def test_mixed_rows(spark):
    rows = [(1, [0, 0, 1], "teacher"), (2, [0, 1, 1], None), (3, [2, 1, 0], "student")]
    frame = spark.createDataFrame(rows, "id int, step_map array<int>, source string")
    got = tr.mixed_rows(frame, "id", 1, 0.2, 0.8).collect()
    assert sorted((r.id, r.round) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_token_rows(apply):
    t = F.col("s")
    arr = "s array<int>"
    noise = F.array(F.lit(True), F.lit(False))
    assert apply(tr.extended(t, F.lit(1), noise, 9), [([1, 2, 3],)], arr) == [[1, 2, 3, 9, 3]]
    target = F.transform(t, lambda x, i: i >= 1)
    assert apply(tr.limit_pad_targets(target, t, 0, 1), [([0, 0, 5, 0, 6, 0],), ([0, 5, 0],)], arr) == [
        [False, True, True, False, True, False], [False, True, True],
    ]
    assert apply(tr.decode_cut(t, [0, 7]), [([1, 2, 7, 3],), ([7],), ([1],)], arr) == [[1, 2], [], [1]]
    assert apply(tr.cleaned_ids(t, 10, 4, [12]), [([1, -1, 4, 10, 12, None],)], arr) == [[1, 0, 0, 0, 12, 0]]


def simulated_positions(tokens, start, pad):
    out, n = [], 0
    for i, t in enumerate(tokens):
        valid = i >= start or t != pad
        n += valid
        out.append(n - 1 if valid else 1)
    return out + out[start:]


def test_position_ids(apply):
    rng = random.Random(5)
    rows = [([rng.choice([0, 0, 1, 2]) for _ in range(9)],) for _ in range(200)] + [([0] * 9,), ([1] * 9,)]
    got = apply(tr.position_ids(F.col("s"), F.lit(4), 0), rows, "s array<int>")
    assert got == [simulated_positions(r[0], 4, 0) for r in rows]

    def sampler(tokens):
        n, out = 0, []
        for t in tokens:
            n += t != 0
            out.append(n - 1 if t != 0 else 0)
        return out

    assert apply(tr.sampler_position_ids(F.col("s"), 0), rows, "s array<int>") == [sampler(r[0]) for r in rows]


def test_loss_mask(apply):
    clean, noised = F.col("s"), F.col("n")
    rows = [([1, 3, 5, 3, 6], [1, 9, 9, 9, 9]), ([1, 5, 5, 5, 0], [1, 9, 5, 9, 0])]
    schema = "s array<int>, n array<int>"
    assert apply(tr.loss_mask(clean, noised, F.lit(1), 0, 3, 9), rows, schema) == [
        [False, True, False, False, False], [False, True, False, True, False],
    ]
    assert apply(tr.loss_mask(clean, noised, F.lit(1), 0, 3, 9, exclude_end=True), rows[:1], schema) == [[False] * 5]


def test_commit(apply):
    done = tr.committed(F.col("s"), F.col("s"), F.lit(2), [7], 3)
    rows = [([7, 1, 2, 7, 3],), ([1, 1, 2, 3, 4, 5],), ([1, 1, 2],), ([1],)]
    got = apply(done, rows, "s array<int>")
    assert [(g.tokens, g.steps, g.finished) for g in got] == [
        ([7, 1, 2, 7], [2, 7], True), ([1, 1, 2, 3, 4], [2, 3, 4], True), ([1, 1, 2], [2], False), ([1], [], False),
    ]


def test_sequence_masks(spark):
    n, key = 16, F.col("id")
    count = ((F.col("id") % 15) + 1).cast("int")
    rows = spark.range(300).select(
        "id", count.alias("c"), tr.scattered_mask(key, F.lit(n), count, 1).alias("s"),
        tr.rectangle_mask(key, F.lit(n), count, 1).alias("r"),
    ).collect()
    assert all(sum(r.s) == r.c for r in rows)
    for r in rows:
        cells = [(i // 4, i % 4) for i, m in enumerate(r.r) if m]
        ys, xs = {y for y, _ in cells}, {x for _, x in cells}
        assert len(cells) == len(ys) * len(xs) and cells
        assert max(ys) - min(ys) + 1 == len(ys) and max(xs) - min(xs) + 1 == len(xs)
        assert len(cells) >= min(r.c, 1)


def test_mask_counts(apply):
    assert apply(tr.masked_count(F.lit(10), F.col("s")), [(0.25,), (0.35,), (0.0,), (1.0,)], "s double") == [2, 4, 1, 10]
    assert apply(tr.loss_weights(F.array(F.lit(True), F.lit(False)), F.col("s")), [(0.5,)], "s double") == [
        [1.0, pytest.approx(0.65)]
    ]
