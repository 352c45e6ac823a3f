"""Ledgers and ingest over many triggers, restarts and replays."""

from __future__ import annotations

import collections
import glob
import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from rolloom.sources import folders
from rolloom.streaming import jobs


def deliver(spark, rows, schema, inbox):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)


def test_snapshots_stay_small(spark, tmp_path):
    """Twelve triggers, each with some keys: right totals, a bounded sink."""
    inbox, sink, state = (str(tmp_path / d) for d in ("inbox", "sink", "state"))
    schema, r = "run string, tokens bigint, loss bigint", random.Random(1)
    want = collections.Counter()
    for trigger in range(12):
        rows = [(r.choice([None, *"abcdefghij"]), r.randint(1, 9), 1) for _ in range(6)]
        deliver(spark, rows, schema, inbox)
        jobs.running_totals(jobs.new_files(spark, inbox, schema), "run", ["tokens", "loss"], sink, state, buckets=3)
        for run, tokens, loss in rows:
            want[run, "tokens"] += tokens
            want[run, "loss"] += loss
        got = {(x.run, n): x[n] for x in jobs.latest_totals(spark, sink, "run", ["tokens", "loss"]).collect() for n in ("tokens", "loss")}
        assert got == dict(want)
        held = glob.glob(f"{sink}/generation=*/bucket=*")
        assert len(held) <= 3 * 2 and len(glob.glob(f"{sink}/generation=*")) <= 6
    read = jobs.latest_totals(spark, sink, "run", ["tokens"]).inputFiles()
    assert len({os.path.dirname(f) for f in read}) <= 3


def test_ledger_after_a_crash(spark, tmp_path):
    """The last trigger fails before, in and after its write; a restart mends it."""
    schema = "run string, tokens bigint"
    for damage in ("nothing written", "half written", "written, not logged"):
        inbox, sink, state = (str(tmp_path / damage.replace(" ", "-") / d) for d in ("inbox", "sink", "state"))
        for rows in ([("a", 1), ("b", 2)], [("a", 10), ("c", 3)], [("b", 20)]):
            deliver(spark, rows, schema, inbox)
            jobs.running_totals(jobs.new_files(spark, inbox, schema), "run", ["tokens"], sink, state, buckets=2)
        last = max(glob.glob(f"{sink}/generation=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
        for log in glob.glob(f"{state}/commits/{last.rsplit('=', 1)[1]}") + glob.glob(f"{state}/commits/.{last.rsplit('=', 1)[1]}.crc"):
            os.rename(log, f"{tmp_path}/{os.path.basename(log)}-{damage[:4]}")
        if damage == "nothing written":
            folders.remove(spark, last)
        if damage == "half written":
            os.rename(f"{last}/_SUCCESS", f"{tmp_path}/half")
        if damage != "written, not logged":
            # what is not finished is not read
            assert {r.run: r.tokens for r in jobs.latest_totals(spark, sink, "run", ["tokens"]).collect()} == {"a": 11, "b": 2, "c": 3}
        jobs.running_totals(jobs.new_files(spark, inbox, schema), "run", ["tokens"], sink, state, buckets=2)
        assert {r.run: r.tokens for r in jobs.latest_totals(spark, sink, "run", ["tokens"]).collect()} == {"a": 11, "b": 22, "c": 3}


SCHEMA = "run string, step int, id bigint, at string"
IDS = ["run", "step", "id"]


def ingest(spark, rows, place, by):
    inbox, sink, state = (str(place / d) for d in ("inbox", "sink", "state"))
    deliver(spark, rows, SCHEMA, inbox)
    jobs.append_distinct(jobs.new_files(spark, inbox, SCHEMA), IDS, sink, state, by=by, buckets=4)
    return sink


def kept(spark, sink):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(sink).select("run", "step", "id", "at").collect()), key=repr)


def test_late_rows_and_repeats(spark, tmp_path):
    for by in (["run", "step"], None):
        place = tmp_path / str(bool(by))
        ingest(spark, [("r/1 %", 1, 1, "10:00"), ("r/1 %", 1, 1, "10:00"), (None, 2, 1, "10:01")], place, by)
        # a step much later, then a new row and a repeat of the old step
        ingest(spark, [("r/1 %", 900, 1, "23:00")], place, by)
        sink = ingest(spark, [("r/1 %", 1, 2, "09:00"), ("r/1 %", 1, 1, "23:30"), (None, 2, 1, "23:30"), (None, None, 4, "x"), ("007", 1, 1, "y")], place, by)
        want = [("r/1 %", 1, 1, "10:00"), (None, 2, 1, "10:01"), ("r/1 %", 900, 1, "23:00"), ("r/1 %", 1, 2, "09:00"), (None, None, 4, "x"), ("007", 1, 1, "y")]
        assert kept(spark, sink) == sorted(want, key=repr)
        sink = ingest(spark, [(None, None, 4, "z"), ("007", 1, 1, "z")], place, by)
        assert kept(spark, sink) == sorted(want, key=repr)


def test_replay_of_a_batch(spark, tmp_path):
    """The second batch runs again after later ones: the sink does not change."""
    for rows in ([("a", 1, 1, "x"), ("a", 1, 2, "x")], [("a", 1, 2, "y"), ("a", 1, 3, "y"), ("b", 1, 1, "y")]):
        sink = ingest(spark, rows, tmp_path, ["run", "step"])
    before = kept(spark, sink)
    for log in glob.glob(f"{tmp_path}/state/commits/1") + glob.glob(f"{tmp_path}/state/commits/.1.crc"):
        os.rename(log, f"{tmp_path}/{os.path.basename(log)}-gone")
    jobs.append_distinct(jobs.new_files(spark, str(tmp_path / "inbox"), SCHEMA), IDS, sink, str(tmp_path / "state"), by=["run", "step"])
    assert kept(spark, sink) == before and len(before) == 4


def test_a_batch_reads_its_own_partitions_only(spark, tmp_path):
    """Unreadable files in every other partition do not matter to a batch."""
    sink = ingest(spark, [("a", s, i, "x") for s in range(5) for i in range(3)], tmp_path, ["run", "step"])
    copies = []
    for step in range(5):
        if step != 3:
            for path in glob.glob(f"{sink}/run=a/step={step}/batch=0/*.parquet"):
                copies.append((path, shutil.copy(path, f"{tmp_path}/{len(copies)}")))
                with open(path, "wb") as f:
                    f.write(b"not a table")
                crc = re.sub(r"([^/]+)$", r".\1.crc", path)
                if os.path.exists(crc):
                    os.rename(crc, f"{tmp_path}/crc{len(copies)}")
    ingest(spark, [("a", 3, 2, "late"), ("a", 3, 9, "late"), ("a", 77, 0, "new")], tmp_path, ["run", "step"])
    for path, copy in copies:
        shutil.copy(copy, path)
    got = kept(spark, sink)
    assert len(got) == 17 and ("a", 3, 2, "x") in got and ("a", 3, 9, "late") in got


@pytest.fixture
def fixed_tasks(spark):
    """As many tasks as shuffle partitions, however few rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_files_grow_with_partitions_not_with_tasks(spark, tmp_path, fixed_tasks):
    """However many tasks remove repeats, a partition gets about one file of a batch."""
    sink = ingest(spark, [("a", s, i, "x") for s in range(12) for i in range(40)], tmp_path, ["run", "step"])
    assert len(glob.glob(f"{sink}/run=a/step=*/batch=0/*.parquet")) == 12
    ingest(spark, [("a", 3, i, "late") for i in range(20, 400)], tmp_path, ["run", "step"])
    # one partition is written by several tasks
    assert 1 < len(glob.glob(f"{sink}/run=a/step=3/batch=1/*.parquet")) <= 8
    assert len(kept(spark, sink)) == 12 * 40 + 360


def test_folders(spark, tmp_path):
    place = str(tmp_path / "x=1")
    spark.range(3).withColumn("v", F.lit(1)).write.parquet(place)
    assert folders.exists(spark, place) and folders.matching(spark, f"{tmp_path}/x=*")[0].endswith("x=1")
    folders.remove(spark, place)
    folders.remove(spark, place)
    assert not folders.exists(spark, place) and folders.matching(spark, f"{tmp_path}/none/*") == []
