"""One large JSON array, read by many tasks.

A JSON array is not splittable by lines: it may be a single line, and only the
state of quotes and brackets tells which comma ends an element. The file is
therefore read as the pieces between commas, which every reader of a byte range
can find, and the state is worked out in two passes:

1. Each range is reduced to one row: whether it flips between inside and outside
   of a string, and how far it moves the nesting, for either way it may begin.
2. A running total over these few rows gives the state in which every range
   begins. With it a range knows its commas of the outer array, puts its whole
   elements together and hands over only what hangs over its two ends.

The overhanging ends, two for a range, are joined by file and place.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloom.functions.text import let
from rolloom.session import work_dir

# One row of a few numbers for each range of a file is broadcast, up to here; a
# hundred thousand ranges of 128 MB are 12 TB of arrays. Beyond, ranges are
# brought together with their state by a shuffle.
RANGES = 100_000

BLANK = r"\A[ \t\r\n]*+\z"


def _moves(text: Column) -> Column:
    """Opening less closing brackets outside of strings, and whether one is odd.

    Behind a closing bracket only a comma, another one or white space may stand.
    ``text`` has no escapes.
    """
    bare = F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "v")

    def counted(t: Column) -> Column:
        plain = F.length(F.translate(t, "[{", "")) - F.length(F.translate(t, "]}", ""))
        # fewer characters without closing ones, more without opening ones
        return F.struct((-plain).cast("int").alias("by"), F.regexp_like(t, F.lit(r"[\]}][ \t\r\n]*[^\]} \t\r\n]")).alias("odd"))

    return let(bare, counted)


def _pieces(spark: SparkSession, paths) -> DataFrame:
    """Pieces between commas: file, first byte of the range, and what they do.

    ``outside`` holds if the piece begins outside of a string, ``inside`` if not.
    """
    read = spark.read.option("lineSep", ",").text(paths)
    plain = F.regexp_replace("value", r"(?s)\\.", "")

    def states(t: Column) -> Column:
        quotes = F.length(t) - F.length(F.translate(t, '"', ""))
        return F.struct((quotes % 2 == 1).alias("flips"), _moves(t).alias("outside"), _moves(F.concat(F.lit('"'), t)).alias("inside"))

    rows = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", let(plain, states).alias("s")
    )
    parts = [F.col(f"s.{x}.{y}").alias(f"{x}_{y}") for x in ("outside", "inside") for y in ("by", "odd")]
    return rows.select("file", "at", "value", F.col("s.flips").alias("flips"), *parts)


def _folded(batches):
    """One row for each range, which is a run of rows of a task."""
    key, flips, moved, out = None, False, [0, 0], []
    for batch in batches:
        for file, at, turn, outside, inside in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, at) != key:
                if key is not None:
                    out.append((*key, flips, *moved))
                key, flips, moved = (file, at), False, [0, 0]
            step = (inside, outside) if flips else (outside, inside)
            moved = [moved[0] + step[0], moved[1] + step[1]]
            flips ^= turn
    if key is not None:
        out.append((*key, flips, *moved))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["file", "at", "flips", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _begins(ranges: list) -> list[tuple[str, int, bool, int]]:
    """The state in which every range begins. Fails if a file does not end closed."""
    out = []
    for file, group in groupby(sorted(ranges), key=lambda r: r[0]):
        within, depth = False, 0
        for _, at, flips, outside, inside in group:
            out.append((file, at, within, depth))
            depth += inside if within else outside
            within ^= flips
        if within or depth:
            raise ValueError(f"{file} is cut off: it ends {'inside a string' if within else f'at depth {depth}'}")
    return out


def _elements(batches):
    """Whole elements of every range, and the ends that hang over.

    ``part`` is null for an element, 0 for what stands before the first comma of
    the outer array in a range, 1 for what stands behind the last one; a range
    without such a comma is all 0. ``fresh`` says that an element begins there.
    """
    place, text, out = None, [], []

    def ended(part) -> None:
        out.append((*place, part, part != 0 or fresh, ",".join(text)))

    for batch in batches:
        for file, at, value, flips, out_by, out_odd, in_by, in_odd, begins, depth_there in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, at) != place:
                if place is not None:
                    ended(1 if cut else 0)
                place, text, cut, within, depth = (file, at), [], False, begins, depth_there
                fresh = not within and depth <= 1
            elif not within and depth == 1:
                ended(None if cut else 0)
                text, cut = [], True
            if not within and depth < 1 and at + bool(text) > 0:
                raise ValueError(f"{file} holds more than one value")
            if in_odd if within else out_odd:
                raise ValueError(f"{file} is no array of values: near {value[:80]!r}")
            text.append(value)
            depth += in_by if within else out_by
            within ^= flips
        if out:
            yield _rows(out)
            out = []
    if place is not None:
        ended(1 if cut else 0)
        yield _rows(out)


def _rows(found: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["file", "at", "part", "fresh", "text"])


def _with_states(pieces: DataFrame, states: DataFrame, few: bool) -> DataFrame:
    """Pieces of every range in order, with the state in which it begins."""
    names = pieces.columns
    if few:
        joined = pieces.join(F.broadcast(states), ["file", "at"], "left")
    else:
        numbered = pieces.withColumn("n", F.monotonically_increasing_id())
        joined = numbered.join(states, ["file", "at"], "left").repartition("file", "at").sortWithinPartitions("file", "at", "n")
    changed = F.raise_error(F.lit("the ranges of the files have changed between two reads"))
    begins = F.when(F.col("begins").isNull(), changed.cast("boolean")).otherwise(F.col("begins"))
    return joined.select(*names, begins.alias("begins"), "depth")


def array_elements(spark: SparkSession, paths, ranges: int = RANGES) -> DataFrame:
    """The elements of JSON array files as text: ``file, element``, in no order.

    Files may be of any size and lie in any store Spark reads. A file that is
    cut off, or that holds anything but one array of values, fails. The result
    is written to the shared folder, so the files are read twice in all.
    """
    pieces = _pieces(spark, paths)
    narrow = pieces.select("file", "at", "flips", "outside_by", "inside_by")
    found = narrow.mapInArrow(_folded, "file string, at bigint, flips boolean, outside bigint, inside bigint").collect()
    begins = _begins([tuple(r) for r in found])
    states = spark.createDataFrame(begins, "file string, at bigint, begins boolean, depth bigint")
    split = _with_states(pieces, states, len(begins) <= ranges)
    path = work_dir(spark, "elements")
    schema = "file string, at bigint, part int, fresh boolean, text string"
    split.mapInArrow(_elements, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    whole = rows.where("part IS NULL").select("file", _filled(F.col("text")).alias("element"))
    return whole.unionAll(_joined(rows.where("part IS NOT NULL")))


def _filled(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(BLANK)), F.raise_error(F.lit("an array lacks a value between two commas")).cast("string")).otherwise(text)


def _joined(ends: DataFrame) -> DataFrame:
    """Elements that cross ranges, and those at the ends of a file."""
    order = Window.partitionBy("file").orderBy("at", "part")
    # without the texts: two short rows for each range of the file
    numbers = ends.select("file", "at", "part", F.sum(F.col("fresh").cast("int")).over(order).alias("number"))
    last = numbers.groupBy("file").agg(F.max("number").alias("last"))
    pieces = ends.join(numbers, ["file", "at", "part"]).groupBy("file", "number")
    texts = pieces.agg(F.array_sort(F.collect_list(F.struct("at", "part", "text"))).alias("t")).join(last, "file")
    text = F.array_join(F.transform("t", lambda x: x["text"]), ",")
    opened = F.when(F.col("number") > 1, text).otherwise(_without(text, r"\A[ \t\r\n]*\[", "does not begin with a bracket"))
    closed = let(opened, lambda t: F.when(F.col("number") < F.col("last"), t).otherwise(_without(t, r"\][ \t\r\n]*\z", "does not end with a bracket")))
    bare = texts.select("file", closed.alias("element"), (F.col("last") == 1).alias("only"))
    # an array without elements has a single blank one
    empty = F.col("only") & F.regexp_like("element", F.lit(BLANK))
    return bare.where(~empty).select("file", _filled(F.col("element")).alias("element"))


def _without(text: Column, pattern: str, message: str) -> Column:
    fails = F.raise_error(F.concat(F.col("file"), F.lit(f" {message}"))).cast("string")
    return F.when(~F.regexp_like(text, F.lit(pattern)), fails).otherwise(F.regexp_replace(text, pattern, ""))


def read_large_arrays(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Rows of JSON array files, read by as many tasks as the files have ranges."""
    row = F.from_json("element", schema, {"mode": "FAILFAST"})
    return array_elements(spark, paths).select(row.alias("r")).select("r.*")


def to_parquet(spark: SparkSession, paths, schema: str, target: str) -> DataFrame:
    """Converts JSON array files once; returns the table that was written."""
    rows = read_large_arrays(spark, paths, schema)
    rows.write.parquet(target)
    return spark.read.schema(rows.schema).parquet(target)
