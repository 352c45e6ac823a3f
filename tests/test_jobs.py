"""Files, streams, grouping in parts, hooks, and the shape of plans."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolloom.functions import extract as ex
from rolloom.functions import plugins as pl
from rolloom.operators import grids
from rolloom.operators import metrics as mt
from rolloom.operators import prompts as pm
from rolloom.operators import reshape as rs
from rolloom.operators import rewards as rw
from rolloom.operators import schedule as sc
from rolloom.sources import config as cf
from rolloom.sources import files as fs
from rolloom.streaming import jobs


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "x\ny"}, {"id": 2, "t": None}], indent=1))
    rows = fs.read_json_arrays(spark, str(tmp_path / "a.json"), "id int, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "x\ny"), (2, None)]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n   \n{"id": \n{"id": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        fs.read_json_lines(spark, str(tmp_path / "l.jsonl"), "id int").collect()
    good = fs.read_json_lines(spark, str(tmp_path / "l.jsonl"), "id int", keep_bad=True).filter("_bad IS NULL").drop("_bad")
    assert sorted(r.id for r in good.collect()) == [1, 3]
    bad = fs.read_json_lines(spark, str(tmp_path / "l.jsonl"), "id int", keep_bad=True).filter("_bad IS NOT NULL")
    assert [r._bad.strip() for r in bad.collect()] == ['{"id":']


def test_missing_chunk_fails(spark):
    chunks = spark.createDataFrame([(0, 1), (2, 5)], "chunk_id int, row int")
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "chunk_id int")
    merged = fs.merged_chunks(chunks, wanted, ["chunk_id"])
    for act in (lambda: merged.collect(), lambda: merged.count(), lambda: merged.write.format("noop").mode("overwrite").save()):
        with pytest.raises(Exception, match="missing chunks: 1, the first is 1"):
            act()
    assert fs.merged_chunks(chunks, wanted.filter("chunk_id <> 1"), ["chunk_id"]).count() == 2
    # building the plan reads nothing, reading it fails, also without any chunk
    late = fs.merged_chunks(chunks.limit(0), wanted, ["chunk_id"])
    with pytest.raises(Exception, match="missing chunks: 3"):
        late.collect()
    assert fs.merged_chunks(chunks.limit(0), wanted.limit(0), ["chunk_id"]).count() == 0


def test_run_catalogue(spark, tmp_path):
    for run, text in (("a", '{"current_epoch": 3}'), ("b", "{broken"), ("c", "{}")):
        os.makedirs(tmp_path / f"run={run}")
        (tmp_path / f"run={run}" / "metadata.json").write_text(text)
    runs = fs.read_run_catalogue(spark, str(tmp_path))
    assert {r.run: r.meta.current_epoch if r.meta else None for r in runs.collect()} == {"a": 3, "b": None, "c": None}


def test_latest_run_and_resume(spark):
    rows = [
        ("x_1", 10, 4, True, True, False), ("x_2", 30, None, True, True, False), ("x_3", 20, 7, True, False, False),
        ("y_1", 40, 1, True, False, True), ("z_1", 5, 2, False, True, False),
    ]
    runs = spark.createDataFrame(
        rows, "run string, mtime long, current_epoch int, has_config boolean, has_weights boolean, has_adapter boolean"
    )
    assert mt.latest_run(runs).first()[:] == ("y_1", 1)
    assert mt.latest_run(runs, prefix="x_").first()[:] == ("x_3", 7)
    plan = {r.run: (r.resume, r.next_step) for r in mt.resume_plan(runs).collect()}
    assert plan == {"x_1": (True, 5), "x_2": (False, None), "x_3": (False, None), "y_1": (True, 2), "z_1": (False, None)}


def test_flatten_config(spark):
    doc = {"a": {"b": [1, {"c": "x"}], "d": None}, "e": True, "f": {}, "g": 1.5}
    rows = cf.flattened(spark.createDataFrame([(1, json.dumps(doc))], "run int, doc string"), "run", "doc")
    assert {r.key: r.value for r in rows.collect()} == {"a.b.0": "1", "a.b.1.c": "x", "a.d": None, "e": "true", "g": "1.5"}


def test_log_pairing(spark):
    lines = [
        "  Dataset: A (max=1)", "noise", "train step: 1  acc: 0.5  avg length: 10.0  avg tok/step: 1.0",
        "train step: 1  acc: 0.9  avg length: 1.0  avg tok/step: 2.0", "  Dataset: B (x)", "  Dataset: C (x)",
        "train step: 2  acc: 0.25  avg length: 3.0  avg tok/step: 1.5  [x]", "train step: 10  acc: 0.75", "  Dataset: D (x)",
    ]
    log = spark.createDataFrame([(0, i, s) for i, s in enumerate(lines)], "shard int, line_no long, line string")
    got = sorted((r.dataset, r.step, r.acc) for r in mt.paired_results(log).collect())
    assert got == [("A", 1, 0.5), ("C", 10, 0.75)]
    got = sorted((r.dataset, r.step, r.acc) for r in mt.paired_results(log, "train step:").collect())
    assert got == [("A", 1, 0.5), ("C", 2, 0.25)]


def test_regroup_splits_hot_keys(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    parts = rs.regroup(rows, "k", "i", ["v"], part_size=64).collect()
    assert len(parts) == 16 and max(len(p.v) for p in parts) == 64
    assert [x for p in sorted(parts, key=lambda p: p.part) for x in p.v] == [2 * i for i in range(1000)]
    flat = rs.flatten_lists(rs.regroup(rows, "k", "i", ["v"], 64), ["k", "part"], ["v"])
    assert flat.count() == 1000


def test_few_shot(spark):
    pool = [("a_b", r, f"q{r}", ["one", None], "A") for r in range(9)]
    shots = spark.createDataFrame(pool, "subject string, rank int, q string, options array<string>, gold string")
    asks = spark.createDataFrame(
        [("a_b", "x", ["p", "q"]), ("none", "y", [])], "subject string, question string, options array<string>"
    )
    rows = {r.subject: r.messages for r in pm.few_shot_chat(asks, shots, 2).collect()}
    assert [m.role for m in rows["a_b"]] == ["user", "assistant"] * 2 + ["user"]
    assert rows["a_b"][0].content == (
        "There is a single choice question about a b. Answer the question by replying A, B, C or D.\nQuestion: q0\nA. one\nB. \nAnswer:"
    )
    assert rows["a_b"][-1].content.endswith("Question: x\nA. p\nB. q\nAnswer:")
    assert len(rows["none"]) == 1
    texts = {r.subject: r.prompt for r in pm.few_shot_text(asks, shots).collect()}
    assert texts["a_b"].count("Let's think") == 4 and texts["none"].startswith("Q: y")


def test_grid(spark):
    gold = [(1, 1, "Pet Name", "Cat"), (1, 1, "Color", "red"), (2, 1, "Color", "red"), (3, 1, "Zip", "1")]
    pred = [(1, 1, "pet_name", " cat ", 0), (1, 1, "the color", "RED", 1), (2, 1, "Color", "blue", 0), (3, 1, "Other", "1", 0)]
    out = grids.exact_match(
        spark.createDataFrame(gold, "puzzle int, house int, attr string, val string"),
        spark.createDataFrame(pred, "puzzle int, house int, attr string, val string, ord int"),
    )
    assert {r.puzzle: (r.solved, r.cells) for r in out.collect()} == {1: (True, 2), 2: (False, 1), 3: (False, 1)}


def test_single_subdivision_is_left_out(spark):
    rows = [("math", None, "en", True, True), ("mc", "x", "en", False, True), ("mc", "y", "de", True, False)]
    frame = spark.createDataFrame(rows, "domain string, category string, subdivision string, correct boolean, scorable boolean")
    got = {(r.level, r.label): (r.n_correct, r.n) for r in rw.accuracy(frame).collect()}
    assert got == {("all", None): (1, 2), ("domain", "math"): (1, 1), ("domain", "mc"): (0, 1), ("category", "x"): (0, 1)}


def test_hooks(spark):
    hooks = pl.Plugins()
    hooks.register_template("t", lambda row: F.concat(F.lit("<"), row["q"], F.lit(">")))
    hooks.register_checker("raise", pl.python_checker(lambda p, g: 1 / 0))
    rows = spark.createDataFrame([("t", "a"), ("u", "b")], "name string, q string")
    assert [r[0] for r in rows.select(hooks.prompt(rows, "name", F.col("q"))).collect()] == ["<a>", "b"]
    verdict = hooks.verdict(F.lit("raise"), F.col("q"), F.col("q"))
    assert [r[0] for r in rows.select(verdict).collect()] == [False, False]


def test_stream_scores_each_file_once(spark, tmp_path):
    inbox, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    score = lambda s: s.select("id", ex.mc_letter(F.col("text")).alias("letter"))
    for start in (0, 10):
        rows = spark.range(start, start + 10).select("id", F.lit("Answer: B").alias("text"))
        rows.write.mode("append").json(inbox)
        jobs.append_scored(jobs.new_files(spark, inbox, "id long, text string"), score, sink, state)
    jobs.append_scored(jobs.new_files(spark, inbox, "id long, text string"), score, sink, state)
    out = spark.read.parquet(sink).collect()
    assert sorted(r.id for r in out) == list(range(20)) and {r.letter for r in out} == {"B"}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f03_candidate_test_cross", "e08_grid_exact_match", "f06_log_pairing", "b11_month_windows", "j03_round_expansion"])
def test_no_cartesian_product(spark, data, name):
    plan = plan_of(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_trajectories_need_no_shuffle(spark, tmp_path):
    from rolloom.operators import trajectory as tr

    maps = spark.range(10).select("id", F.array(F.lit(0), F.lit(1)).alias("step_map"))
    assert "Exchange" not in plan_of(tr.expand_rounds(maps))


def test_few_shot_limits_before_the_shuffle(spark, data):
    plan = plan_of(entry.queries()["c06_few_shot_chat"](spark, data))
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_used_columns(spark, data):
    plan = plan_of(entry.queries()["g15_domain_counts"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("name", ["g01_z_scored_reward", "h03_ceil_chunks", "h06_cumulative_ledger", "f06_log_pairing", "j04_one_round_per_block", "h01_epoch_chunks"])
def test_result_does_not_depend_on_partitions(spark, data, name):
    results = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, entry.queries()[name](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_late_and_repeated_deliveries(spark, tmp_path):
    inbox, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "id bigint, at string"
    for rows in ([(1, "10:00")], [(2, "12:00")], [(3, "10:00"), (1, "12:30")], [(3, "10:00")]):
        spark.createDataFrame(rows, schema).write.mode("append").json(inbox)
        jobs.append_distinct(jobs.new_files(spark, inbox, schema), ["id"], sink, state)
    kept = spark.read.parquet(sink).select("id", "at").collect()
    assert sorted(map(tuple, kept)) == [(1, "10:00"), (2, "12:00"), (3, "10:00")]


def test_results_stay_line_by_line(spark):
    rows = spark.createDataFrame([("A", 0.5, 9.5, 1.0), ("A", 0.4, 10.5, 2.0)], "dataset string, acc double, avg_len double, tok_per_step double")
    got = sorted(map(tuple, mt.results_table(rows).collect()))
    assert got == [("A", "0.4000", "10.5", "2.000"), ("A", "0.5000", "9.5", "1.000")]


def test_schedule_changes_over_gaps(spark):
    rows = spark.createDataFrame([("r", 300), ("r", 301), ("r", 305)], "run string, step int")
    assert sc.changes(rows, lambda step: F.least(step, F.lit(100)), "value").count() == 0
    assert [r.step for r in sc.changes(rows, lambda step: F.floor(step / 5), "value").orderBy("step").collect()] == [300, 305]


def test_python_steps_run_outside_the_folder(data, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from rolloom.session import local_session\n"
        "s = local_session(2)\n"
        f"print('rows', [e.queries()[q](s, {data!r}).count() for q in ('d17_json_answer', 'o03_batch_scoring')])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [" in out.stdout, out.stderr[-2000:]
