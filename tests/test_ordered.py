"""Order-dependent operators against plain Python, small buckets forced."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rolloom.functions.hashing import order_key
from rolloom.operators import logprob as lp
from rolloom.operators import ordered as od
from rolloom.operators import rewards as rw
from rolloom.operators import schedule as sc
from rolloom.operators import verdicts as vd


def hot_rows(n=3000, seed=0):
    """(key, order, value): key 'hot' holds more than a third of the rows."""
    rng = random.Random(seed)
    orders = rng.sample(range(n * 5), n)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", o, rng.randint(0, 9)) for o in orders]


@pytest.mark.parametrize("levels,width", [(0, 10), (1, 64), (2, 8), (3, 4)])
def test_running_sums(spark, levels, width):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = {(r.k, r.o): r.v_before for r in od.running_sums(frame, ["k"], "o", ["v"], levels, width).collect()}
    want, totals = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[(k, o)] = totals.get(k, 0)
        totals[k] = totals.get(k, 0) + v
    assert got == want


@pytest.mark.parametrize("levels,width", [(0, 10), (1, 64), (2, 8), (3, 4)])
def test_last_seen(spark, levels, width):
    rows = [(k, o, v if v > 7 else None) for k, o, v in hot_rows(seed=1)]
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    seen = od.last_seen(frame, ["k"], "o", F.col("v"), "h", levels, width)
    got = {(r.k, r.o): r.h for r in seen.collect()}
    want, last = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        last[k] = last.get(k) if v is None else v
        want[(k, o)] = last[k]
    assert got == want


def hashes(n, seed=2):
    """Pairs whose first value is a 64-bit hash; one of them holds 40 %."""
    rng = random.Random(seed)
    wide = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    return list({(7 if rng.random() < 0.4 else rng.choice(wide), rng.randint(0, 2000)) for _ in range(n)})


@pytest.mark.parametrize("parts", [None, 1, 23])
def test_dense_index(spark, parts):
    pairs = hashes(2000)
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {(r.a, r.b): r.gi for r in od.dense_index(frame, "a", "b", parts=parts).collect()}
    assert got == {p: i for i, p in enumerate(sorted(pairs))}
    assert od.dense_index(frame.limit(0), "a", "b").count() == 0


def test_positions_need_no_single_task(spark):
    """Sparse ids, one of them hot: ranges stay even, and no plan gathers the rows."""
    frame = spark.createDataFrame(hashes(4000), "a long, b long")
    placed = od.positions(frame, ["a", "b"], "at", parts=16)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    spread = frame.repartitionByRange(16, "a", "b").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) >= 12 and max(r["count"] for r in spread) < 0.2 * frame.count()
    assert placed.count() == frame.count()


def test_positions_with_ties_and_nulls(spark):
    rows = [(None, 1), (5, None), (None, None), (5, 5), (5, 5), (5, 5), (-1, 2)]
    frame = spark.createDataFrame(rows, "a long, b long")
    got = od.positions(frame, ["a", "b"], "at", parts=3).orderBy("at").collect()
    assert [r.at for r in got] == list(range(len(rows)))
    least = -(1 << 70)
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: tuple(least if x is None else x for x in r))


@pytest.mark.parametrize("parts", [None, 9])
def test_keyed_index(spark, parts):
    rows = [(k if k != "k3" else None, o) for k, o, _ in hot_rows(1500, 4)]
    frame = spark.createDataFrame(rows, "k string, o long").withColumn("h", order_key(1, F.col("o")))
    got = od.keyed_index(frame, ["k"], ["h", "o"], "i", parts).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.i, r.h) for r in got if r.k == key)
        assert [i for i, _ in mine] == list(range(len(mine))) and [h for _, h in mine] == sorted(h for _, h in mine)
    whole = od.keyed_index(frame, [], ["h", "o"], "i", parts).orderBy("i").collect()
    assert [r.i for r in whole] == list(range(len(rows))) and [r.h for r in whole] == sorted(r.h for r in whole)


@pytest.mark.parametrize("n,chunk,epochs", [(10, 3, 2), (12, 4, 3), (7, 7, 2), (25, 4, 1), (100, 7, 4)])
def test_epoch_chunks(spark, n, chunk, epochs):
    rows = sc.epoch_chunks(spark.range(n), "id", chunk, epochs, seed=3).collect()
    steps = -(-n // chunk) * epochs
    assert {r.step for r in rows} == set(range(1, steps + 1))
    assert sorted(r.position for r in rows) == list(range(1, steps * chunk + 1))
    for epoch in range(1, epochs + 1):  # every prompt once per whole epoch
        assert sorted(r.id for r in rows if r.epoch == epoch) == list(range(n))
    orders = [[r.id for r in sorted(rows, key=lambda r: r.position) if r.epoch == e] for e in (1, 2)]
    assert n < 20 or epochs == 1 or orders[0] != orders[1]


@pytest.mark.parametrize("n,parts", [(10, 3), (3, 7), (100, 8), (7, 7), (1, 4)])
def test_chunks_match_slices(spark, n, parts):
    size = -(-n // parts)
    i, m = F.col("id"), F.lit(n)
    rows = spark.range(n).select(
        "id", sc.ceil_chunk(i, m, parts).alias("a"), sc.balanced_chunk(i, m, parts).alias("b"),
        sc.front_loaded_chunk(i, m, parts).alias("c"), sc.strided(i, parts).alias("d"),
    ).orderBy("id").collect()
    ceil = [c for c in range(parts) for _ in range(c * size, min((c + 1) * size, n))]
    floor = [c for c in range(parts) for _ in range(n * c // parts, n * (c + 1) // parts)]
    front = [c for c in range(parts) for _ in range(n // parts + (c < n % parts))]
    assert [r.a for r in rows] == ceil
    assert [r.b for r in rows] == floor
    assert [r.c for r in rows] == front
    assert [r.d for r in rows] == [k % parts for k in range(n)]


def test_sample_is_stable_and_bounded(spark):
    picks = [
        {r.id for r in sc.sample(spark.range(50).repartition(p), "id", 8, seed=1).collect()} for p in (1, 5)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 8
    assert sc.sample(spark.range(3), "id", 8, seed=1).count() == 3


def test_schedules(apply):
    s = F.col("s")
    steps = [(i,) for i in (0, 1, 50, 100, 200)]
    assert apply(sc.scheduled_budget(s, 100, 2000, 100, "linear"), steps, "s int") == [100, 120, 1048, 2000, 2000]
    assert apply(sc.scheduled_budget(s, 1, 2, 100, "cos"), [(0,)], "s int") == [4]
    got = apply(sc.scheduled_threshold(s, 0.9, 0.5, hold=50, ramp=100), steps, "s int")
    assert got == [pytest.approx(v) for v in (0.9, 0.9, 0.9, 0.7, 0.5)]
    with pytest.raises(ValueError):
        sc.scheduled_threshold(s, 0.9, 0.5, hold=50, ramp=None, total=50)
    with pytest.raises(ValueError):
        sc.scheduled_budget(s, 1, 2, 3, "square")


def test_z_scores_on_a_hot_key(spark):
    rows = hot_rows(seed=4)
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.reward for r in rw.z_scored(frame, "k", "v").collect()}
    by_key = {}
    for k, _, v in rows:
        by_key.setdefault(k, []).append(v)
    for k, o, v in rows:
        vals = by_key[k]
        mean = sum(vals) / len(vals)
        sd = (sum((x - mean) ** 2 for x in vals) / len(vals)) ** 0.5
        assert got[(k, o)] == pytest.approx((v - mean) / sd)
    flat = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v long")
    assert [r.reward for r in rw.z_scored(flat, "k", "v").collect()] == [0.0, 0.0]


def test_caps(apply):
    c = rw.capped(F.lit(True), F.col("s"), F.col("cap"))
    rows = [(95, 100), (94, 100), (50, -1), (50, None), (50, 0)]
    assert apply(c, rows, "s int, cap int") == [False, True, True, True, True]


def test_pass_at_equals_counting(apply):
    from math import comb

    cases = [(n, c) for n in range(1, 9) for c in range(n + 1)]
    for k in (1, 2, 5):
        got = apply(vd.pass_at(F.col("n"), F.col("c"), k, 1.0), cases, "n long, c long")
        for (n, c), value in zip(cases, got):
            want = 1.0 if n - c < k else 1 - comb(n - c, k) / comb(n, k)
            assert value == pytest.approx(want), (n, c, k)


def test_pass_table_needs_enough_samples(spark):
    problems = spark.createDataFrame([(1, 5, 1), (2, 3, 3)], "sample_id long, n long, c long")
    rows = {r.k: r.value for r in vd.pass_at_table(problems, [1, 3, 4]).collect()}
    assert set(rows) == {1, 3} and rows[1] == pytest.approx((20 + 100) / 2)


def test_missing_verdicts_fail(spark):
    rows = [(1, 0, 0, True), (1, 0, 1, None), (1, 1, 0, True)]
    got = vd.per_candidate(spark.createDataFrame(rows, "sample_id long, resp_idx int, test_idx int, passed boolean"))
    assert {r.resp_idx: (r.n_passed, r.solved) for r in got.collect()} == {0: (1, False), 1: (1, True)}


def test_divergence_ignores_excluded_teacher_tokens(spark):
    ninf = float("-inf")
    rows = [(1, 1, 0, 0.0, -0.5), (1, 1, 1, ninf, -0.9)]
    frame = spark.createDataFrame(rows, "seq long, pos long, token_id int, t_lp double, s_lp double")
    out = lp.divergence(frame).first()
    assert out.forward == pytest.approx(0.5) and out.mixed == pytest.approx(0.5) and out.reverse == float("inf")
    assert lp.divergence(frame, reverse_weight=0.5).first().mixed == float("inf")


def test_top_p_keeps_the_likeliest(spark):
    rows = [(1, 1, i, v) for i, v in enumerate([5.0, 1.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "seq long, pos long, token_id int, x double")
    kept = lp.normalised(frame, "x", "lp", top_p=0.01).filter(lp.finite(F.col("lp"))).collect()
    assert [(r.token_id, r.lp) for r in kept] == [(0, 0.0)]
    ties = lp.normalised(frame, "x", "lp", top_k=2).filter(lp.finite(F.col("lp"))).collect()
    assert sorted(r.token_id for r in ties) == [0, 1, 2]
