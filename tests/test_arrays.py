"""One JSON array read in many ranges, against the parser that reads it whole."""

from __future__ import annotations

import json
import random

import pytest

import __spark_entry__ as entry
from rolloom.sources import arrays, files

SCHEMA = "id bigint, text string, tags array<string>, more struct<x:double,y:map<string,int>>"
NASTY = ["", ",", '"', "\\", '\\"', "],[", "}{", '","', "a\\\\", "line\nbreak", "ä漢", "[{", '"}],', "\\,", "tab\t", "{" * 5]


def problems(n, seed=1):
    r = random.Random(seed)
    for i in range(n):
        text = "".join(r.choice([*NASTY, "word ", "and, "]) for _ in range(r.randint(0, 12)))
        yield {
            "id": i, "text": text, "tags": [r.choice(NASTY) for _ in range(r.randint(0, 3))],
            "more": {"x": i / 4, "y": {r.choice("abc"): i}} if i % 3 else None,
        }


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def rows(frame):
    return sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("limit", [arrays.RANGES, 0])
@pytest.mark.parametrize("indent", [None, 1])
def test_large_arrays(spark, tmp_path, small_ranges, indent, limit, monkeypatch):
    monkeypatch.setattr(arrays.array_elements, "__defaults__", (limit,))
    path = str(tmp_path / "one.json")
    with open(path, "w") as f:
        f.write(" \n" + json.dumps(list(problems(150)), indent=indent, ensure_ascii=bool(indent)) + "\n")
    frame = arrays.read_large_arrays(spark, path, SCHEMA)
    assert rows(frame) == rows(files.read_json_arrays(spark, path, SCHEMA)) == list(problems(150))
    assert len({r.at for r in arrays._pieces(spark, path).select("at").distinct().collect()}) > 10


def test_several_files_and_wide_elements(spark, tmp_path, small_ranges):
    """Elements longer than several ranges, an empty array, an array of one."""
    for name, content in (("a", list(problems(5))), ("b", []), ("c", [{"id": 9, "text": "wide, " * 900, "tags": ["[,"] * 400}]), ("d", list(problems(60, 2)))):
        with open(tmp_path / f"{name}.json", "w") as f:
            json.dump(content, f)
    found = arrays.to_parquet(spark, str(tmp_path / "*.json"), SCHEMA, str(tmp_path / "out"))
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "*.json"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 66


@pytest.mark.parametrize(
    "text",
    [
        '[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": 2}', '[{"id": 1, "text": "open', '[{"id": 1}]]', '[{"id": 1}] [{"id": 2}]', '[{"id": 1}],[{"id": 2}]',
        '[{"id": 1},]', '[{"id": 1},,{"id": 2}]', '{"id": 1}', '[{"id": 1} {"id": 2}]', '{"id": 1}, {"id": 2}', "[,]", '[{"id": 1}, {"id": }]', '[{"id": 1}]}{',
    ],
)
def test_broken_arrays_fail(spark, tmp_path, text):
    path = str(tmp_path / "bad.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises(Exception):
        print(arrays.read_large_arrays(spark, path, SCHEMA).collect())


def test_a_cut_file_fails_wherever_it_is_cut(spark, tmp_path, small_ranges):
    whole = json.dumps(list(problems(40)))
    for cut in (len(whole) - 1, len(whole) - 2, len(whole) // 2, len(whole) // 3, 700, 2):
        path = str(tmp_path / f"{cut}.json")
        with open(path, "w") as f:
            f.write(whole[:cut])
        with pytest.raises(Exception):
            print(cut, arrays.array_elements(spark, path).count())


def test_arrays_of_a_table_with_repeated_and_missing_ids(spark, tmp_path):
    """Each language is one whole array, whichever task writes it and however ids repeat."""
    docs = [(i // 2 if i % 5 else None, f"a, [{i}] \"b", ["en", "de", "", None][i % 4]) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["a01_large_arrays"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, docs))
