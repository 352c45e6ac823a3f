"""Registry rules, step schedules, counted writes and routed checkers."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolloom.functions import plugins as pl
from rolloom.operators import grids
from rolloom.operators import prepare as pr
from rolloom.operators import rules
from rolloom.operators import schedule as sc
from rolloom.operators import verdicts as vd
from rolloom.sources import registry as rg

NONE = F.lit(None).cast("string")


def answers(spark, rows, **more):
    frame = spark.createDataFrame(rows, "dataset string, domain string, text string")
    got = rules.answer(F.col("text"), F.col("dataset"), F.col("domain"), NONE, **more)
    return [r[0] for r in frame.coalesce(1).select(got).collect()]


def test_each_dataset_by_its_rule(spark):
    rows = [
        ("BBH", None, "So the answer is (B)."), ("BBH", "math", "So the answer is (B)."), ("HellaSwag", None, "I pick c, not d"),
        ("LCB_v6", None, "```python\nx\n``` then\n```python\ny\n```"), ("MMLU", None, "It is E or D"), ("MMLU_Pro", None, "It is D or E"),
        ("GSM8K", None, "so \\boxed{7}"), (None, None, "so \\boxed{7}"), (None, "science", "It is D or E"), ("GSM8K", "science", "It is C"),
    ]
    assert answers(spark, rows) == ["B", "B", "C", "y", "D", "E", "7", "7", "E", "C"]


def test_new_datasets_and_hooks(spark):
    sets = {**rg.DATASETS, "Mine": rg.Dataset("Mine.json", "math", extract="shout", check="same", letters="AB")}
    assert answers(spark, [("Mine", None, "ab"), ("MMLU", None, "A then E")], datasets=sets, extractors={"shout": F.upper}) == ["AB", "A"]
    with pytest.raises(ValueError, match="shout"):
        rules.answer(F.col("text"), F.col("dataset"), F.col("domain"), NONE, datasets=sets)
    with pytest.raises(ValueError, match="same"):
        rules.correct(F.col("p"), F.array("g"), F.col("d"), F.col("o"), datasets=sets)
    with pytest.raises(Exception, match="unknown dataset Nowhere"):
        answers(spark, [("Nowhere", None, "x")])
    assert rules.letter_sets(sets) == ["AB", "ABCD", "ABCDE", "ABCDEFGHIJ"]


def test_one_branch_for_each_distinct_rule(spark):
    """Datasets that share a rule share its branch."""
    frame = spark.createDataFrame([("BBH", "math", "x")], "dataset string, domain string, text string")
    size = lambda sets: str(frame.select(rules.answer(F.col("text"), F.col("dataset"), F.col("domain"), NONE, datasets=sets))._jdf.queryExecution().analyzed()).count("regexp")
    one = {"BBH": rg.DATASETS["BBH"], "MMLU": rg.DATASETS["MMLU"]}
    many = {**one, **{f"B{i}": rg.DATASETS["BBH"] for i in range(30)}}
    assert size(one) == size(many)


def test_verdicts_by_dataset(spark):
    rows = [("BBH", "(B)", "b", False), ("HellaSwag", "c", "(C)", False), ("LCB_v6", "x", "y", True), ("GSM8K", "1/2", "\\frac{1}{2}", False), ("TriviaQA", "paris", "Paris", False), ("MMLU", None, "A", True)]
    frame = spark.createDataFrame(rows, "dataset string, pred string, gold string, recorded boolean")
    got = rules.correct(F.col("pred"), F.array("gold"), F.col("dataset"), NONE, recorded=F.col("recorded"))
    assert [r[0] for r in frame.coalesce(1).select(got).collect()] == [True, True, True, True, True, False]


def test_few_shot_datasets(spark):
    rows = spark.createDataFrame([("BBH_3shot", 1, "why?"), ("MMLU", 1, "no")], "dataset string, subject int, question string")
    shots = spark.createDataFrame([(1, i, f"q{i}", f"g{i}") for i in range(5)], "subject int, rank int, q string, gold string")
    (row,) = rg.few_shot_chats(rows, "dataset", shots).collect()
    assert [x in row.prompt for x in ("q0", "g2", "q3", "why?")] == [True, True, False, True]


def test_schedule_table_follows_the_steps(spark):
    facts = spark.createDataFrame([(1, 97), (1, 90), (2, 197), (2, 90), (9, 10**6), (None, 5)], "step int, n int")
    table = sc.schedule_table(facts.where("step < 9"), lambda s: s * 100, lambda s: s / 10)
    assert sorted(map(tuple, table.collect())) == [(1, 100, 0.1), (2, 200, 0.2)]
    from rolloom.operators import rewards as rw

    rows = sc.at_step(facts, table).select("step", "n", rw.capped(F.lit(True), F.col("n"), F.col("budget")).alias("c"))
    assert {(r.step, r.n): r.c for r in rows.collect()} == {(1, 97): False, (1, 90): True, (2, 197): False, (2, 90): True, (9, 10**6): True, (None, 5): True}


def test_written_splits_count_in_one_pass(spark, data, tmp_path):
    from rolloom.plans.base import Inputs

    v = Inputs(spark, data)
    for cap in (None, 3, 10**6):
        path = str(tmp_path / str(cap))
        got = pr.write_split(v.f_cf, v.f_cf_tests, "train", path, cap)
        kept = pr.keep_contest_problems(v.f_cf.where("split = 'train'"), v.f_cf_tests)
        n = kept.count()
        assert got == {"total": v.f_cf.where("split = 'train'").count(), "fit": n, "kept": min(n, cap or n)}
        ids = [r.id for r in spark.read.parquet(path).select("id").collect()]
        assert sorted(ids) == sorted(r.id for r in kept.orderBy("id").limit(min(n, cap or n)).select("id").collect())


def test_first_recorded_pair(spark):
    rows = [(3, (0.1, 0.2)), (1, None), (2, (0.5, None))]
    items = spark.createDataFrame(rows, "at int, recorded struct<base:double,plus:double>")
    assert [tuple(r) for r in vd.first_recorded_pair(items, "at").collect()] == [(0.5, None)]
    assert vd.first_recorded_pair(items.where("at = 1"), "at").count() == 0


def test_checkers_see_their_own_rows_only(spark, tmp_path):
    """Every row a Python checker is called for leaves a file behind."""
    hooks = pl.Plugins()
    for name in ("a", "b"):
        folder = str(tmp_path / name)
        os.mkdir(folder)

        def judge(pred, gold, folder=folder):
            open(os.path.join(folder, pred), "w").close()
            if pred.endswith("7"):
                raise ValueError(pred)
            return pred == gold

        hooks.register_checker(name, pl.python_checker(judge))
    rows = [(f"a{i}" if i % 3 else None, f"a{i}", "abn"[i % 3]) for i in range(30)] + [("x", "x", None)]
    frame = spark.createDataFrame(rows, "p string, g string, hook string").repartition(3)
    got = frame.select("p", "g", "hook", hooks.verdict(F.col("hook"), F.col("p"), F.col("g")).alias("ok")).collect()
    for r in got:
        assert r.ok == (r.hook in ("a", "b") and r.p is not None and not r.p.endswith("7") and r.p == r.g)
    for name in ("a", "b"):
        assert set(os.listdir(tmp_path / name)) == {p for p, _, h in rows if h == name and p}


def test_frames_are_judged_whole(spark, tmp_path):
    def judge(frame: pd.DataFrame) -> pd.Series:
        open(tmp_path / f"{len(frame)}-{frame.x.iloc[0]}", "w").close()
        if (frame.x == 13).any():
            raise ValueError("unlucky")
        return frame.x > 5

    frame = spark.range(40).selectExpr("cast(id as int) as x").coalesce(1)
    got = {r.x: r.correct for r in pl.scored_by_frames(frame, judge).collect()}
    assert got == {x: x > 5 and x != 13 for x in range(40)}
    fine = pl.scored_by_frames(frame.where("x <> 13"), lambda f: pd.Series([None, *[True] * (len(f) - 1)]))
    assert sum(r.correct for r in fine.collect()) == 38


def test_houses_by_any_name(spark):
    """Usual names win over names that only hold the label; a missing house fails."""
    from rolloom.operators import grids

    cell = lambda v: {"Pet Kind": v}
    import json

    replies = {
        1: {"solution": {"House 1": cell("Cat"), "House 2": cell(" dog ")}},
        2: {"Building 1": cell("cat"), "house_2": cell("dog")},
        3: {"solution": [cell("cat"), cell("dog")]},
        4: {"solution": {"Building 2": cell("cat"), "House 1": cell("cat"), "#2": cell("dog")}},
        5: {"solution": {"Building 21": cell("cat"), "2": cell("dog")}},
        6: {"solution": {"House 1": cell("cat")}},
        7: {"solution": {"House 1": "cat", "House 2": cell("dog")}},
        8: {"solution": {"House 1": {"pet": "cat"}, "House 2": {"the pet_kind": "dog"}}},
        9: {"other": 1},
    }
    rows = [(k, "well: " + json.dumps(r)) for k, r in replies.items()] + [(10, "no json"), (11, None)]
    gold = [(p, h, "pet kind", v) for p in range(1, 13) for h, v in (("1", "cat"), ("2", "dog"))]
    got = grids.judged_replies(spark.createDataFrame(rows, "puzzle int, reply string"), spark.createDataFrame(gold, "puzzle int, house string, attr string, val string"))
    assert {r.puzzle for r in got.collect() if r.solved} == {1, 2, 3, 4, 5, 8} and got.count() == 12


def test_complete_contest_records(spark, data):
    from rolloom.plans.base import Inputs

    v = Inputs(spark, data)
    rows = pr.contest_records(v.f_cf, v.f_cf_tests, F.col("title"), part_size=5).collect()
    tests = {}
    for r in v.f_cf_tests.collect():
        tests.setdefault(r.id, []).append((r.ord, (r.input or "").replace("\r\n", "\n").replace("\r", "\n"), (r.output or "").replace("\r\n", "\n").replace("\r", "\n")))
    tests = {i: [x[1:] for x in sorted(found)] for i, found in tests.items()}
    kept = {r.id for r in pr.keep_contest_problems(v.f_cf, v.f_cf_tests).collect()}
    assert {r.task_id for r in rows} == kept
    for r in rows:
        assert list(zip(r.test_input, r.test_output)) == tests[r.task_id][5 * r.part : 5 * r.part + 5] != []
        assert r.platform == "codeforces" and r.test_method == "stdio" and r.tags


def test_verdicts_are_read_once(spark, data):
    """The responses are searched before the result's plan, which reads narrow rows."""
    import __spark_entry__ as entry

    for name in ("g01_reward_from_responses", "g05_accuracy_from_responses"):
        plan = entry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan and "response" not in plan.lower()


def test_replies_are_parsed_by_all_tasks(spark, tmp_path):
    """A file that one task reads is dealt before its replies are parsed."""
    reply = '{"solution": {"House 1": {"Pet": "cat"}}}'
    rows = spark.createDataFrame([(i, reply if i % 3 else "none") for i in range(200)], "puzzle long, reply string")
    rows.coalesce(1).write.parquet(str(tmp_path / "replies"))
    replies = spark.read.parquet(str(tmp_path / "replies"))
    gold = replies.select("puzzle", F.lit("1").alias("house"), F.lit("Pet").alias("attr"), F.lit("cat").alias("val"))
    judged = grids.judged_replies(replies, gold)
    assert {(r.puzzle, r.solved, r.cells) for r in judged.collect()} == {(i, i % 3 > 0, 1) for i in range(200)}
    lines = judged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed = next(i for i, line in enumerate(lines) if "solution" in line)
    assert any("RepartitionByExpression [puzzle" in line for line in lines[parsed:])
