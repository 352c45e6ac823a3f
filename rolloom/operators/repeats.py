"""Repetition of texts by ranking their suffixes relationally.

For a table of short texts the suffixes are rows: one for each text and place.
They are ranked by their first ``WIDTH`` characters, inside the partition their
text was dealt to; neighbours that differ there show their common prefix at once.
Only places that still share a rank go on, by prefix doubling: a rank by the
first w characters, and the rank of the place w further on, give the rank by 2w
characters, within their rank, so a window spans the suffixes with one common
beginning. The ranks of all rounds, of texts that need them, stay as tables and
give the common prefix of these neighbours bit by bit.

A text becomes as many rows as it has characters: for whole long documents
``functions.latex.repetition`` scores a text inside one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.text import let
from rolloom.session import work_dir

# Characters of the first rank, a power of two.
WIDTH = 32


def _written(rows: DataFrame, label: str) -> DataFrame:
    path = work_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _places(texts: DataFrame) -> DataFrame:
    """Every place of every text and the ``WIDTH`` characters from there on."""
    signs = F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0))
    keys = let(signs, lambda s: F.transform(s, lambda _, i: F.array_join(F.slice(s, i + 1, F.lit(WIDTH)), "")))
    return texts.select("d", F.posexplode(keys).alias("i", "key"))


def _with_shared(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds how many characters two different keys have in common, 0 if one is NULL."""
    out, step = rows.withColumn(name, F.lit(0)), WIDTH // 2
    while step:
        size = F.col(name) + step
        equal = F.substring(F.col(a), F.lit(1), size) == F.substring(F.col(b), F.lit(1), size)
        out = out.withColumn(name, F.when(equal, size).otherwise(F.col(name)))
        step //= 2
    return out


def _ranked_further(ranks: DataFrame, width: int) -> DataFrame:
    """Ranks by ``2 * width`` characters from those by ``width``."""
    behind = ranks.select("d", (F.col("i") - width).alias("i"), F.col("r").alias("b"))
    # a suffix that ends here comes before those that go on
    beside = ranks.where("tied").join(behind, ["d", "i"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    again = F.col("r") + F.rank().over(Window.partitionBy("d", "r").orderBy("b")) - 1
    tied = F.count("*").over(Window.partitionBy("d", "r", "b")) > 1
    return ranks.where("NOT tied").unionByName(beside.select("d", "i", "g", again.alias("r"), tied.alias("tied")))


def _neighbours(ranks: DataFrame) -> DataFrame:
    """Neighbours in the final order among places that shared their first rank."""
    after = F.lead("i").over(Window.partitionBy("d", "g").orderBy("r"))
    return ranks.where("g IS NOT NULL").select("d", "i", after.alias("j"), F.lit(0).alias("l")).where("j IS NOT NULL")


def repeat_scores(rows: DataFrame, text: str, name: str = "score") -> DataFrame:
    """Adds the sum of common prefixes of neighbouring suffixes over ``n(n + 1) / 2``.

    NULL for NULL, 0 for texts of up to one character. Rows may repeat.
    """
    numbered = _written(rows.withColumn("_d", F.monotonically_increasing_id()), "texts")
    texts = numbered.select(F.col("_d").alias("d"), F.col(text).alias("text"))
    # dealt as texts: the windows over their places need no further shuffle
    own = Window.partitionBy("d").orderBy("key")
    ranked = _places(texts.repartition("d")).select(
        "d", "i", "key", F.rank().over(own).cast("bigint").alias("r"), F.lag("key").over(own).alias("above"), F.lead("key").over(own).alias("below")
    )
    again = F.coalesce(F.col("key") == F.col("above"), F.lit(False))
    tied = again | F.coalesce(F.col("key") == F.col("below"), F.lit(False))
    # equal neighbours are counted below, with those that share more
    first = _with_shared(ranked.select("*", tied.alias("tied"), again.alias("again")), "key", "above", "l")
    first = _written(first.select("d", "i", "r", "tied", F.when(F.col("again"), 0).otherwise(F.col("l")).alias("l")), "ranks")
    found = first.select("d", "l")

    def unfinished(ranks: DataFrame) -> DataFrame:
        return ranks.where("tied").select("d").distinct()

    open_texts = _written(unfinished(first), "open")
    if not open_texts.isEmpty():
        marked = first.select("d", "i", F.when(F.col("tied"), F.col("r")).alias("g"), "r", "tied")
        levels, ended = [_written(marked.join(open_texts, "d", "left_semi"), "ranks")], []
        left = open_texts
        while not left.isEmpty():
            further = _written(_ranked_further(levels[-1], WIDTH << (len(levels) - 1)), "ranks")
            left = _written(unfinished(further), "open")
            ended.append(_neighbours(further.join(left, "d", "left_anti")))
            levels.append(further.join(left, "d", "left_semi"))
        pairs = _written(reduce(DataFrame.unionAll, ended), "pairs")
        for k in reversed(range(len(levels) - 1)):
            # equal ranks of two places: both go on for so many characters
            left, right = (levels[k].select("d", F.col("i").alias(p), F.col("r").alias(f"r{p}")) for p in "xy")
            at = pairs.withColumn("x", F.col("i") + F.col("l")).withColumn("y", F.col("j") + F.col("l"))
            met = at.join(left, ["d", "x"], "left").join(right, ["d", "y"], "left")
            longer = F.when(F.col("rx") == F.col("ry"), F.col("l") + (WIDTH << k)).otherwise(F.col("l"))
            pairs = _written(met.select("d", "i", "j", longer.alias("l")), "pairs")
        keys = _places(texts.join(open_texts, "d", "left_semi"))
        at = pairs.select("d", "l", (F.col("i") + F.col("l")).alias("x"), (F.col("j") + F.col("l")).alias("y"))
        met = at.join(keys.select("d", F.col("i").alias("x"), F.col("key").alias("a")), ["d", "x"], "left")
        met = met.join(keys.select("d", F.col("i").alias("y"), F.col("key").alias("b")), ["d", "y"], "left")
        rest = _with_shared(met, "a", "b", "more")
        found = found.unionAll(rest.select("d", (F.col("l") + F.col("more")).alias("l")))
    sums = found.groupBy(F.col("d").alias("_d")).agg(F.sum("l").alias("_l"))
    n = F.length(text)
    score = F.when(n > 1, 2.0 * F.coalesce("_l", F.lit(0)) / (n * (n + 1))).when(n.isNotNull(), F.lit(0.0))
    return numbered.join(sums, "_d", "left").select(*rows.columns, score.alias(name))


def sql_scores(table: str, key: str, text: str, levels: int) -> str:
    """The same as SQL with a fixed number of rounds: ``id, n, score`` of a table.

    Texts may have up to ``2 ** levels`` characters in common with themselves.
    """
    parts = [
        f"t AS (SELECT row_number() OVER () AS d, {key} AS id, {text} AS text, length({text}) AS n FROM {table})",
        """c0 AS MATERIALIZED (SELECT d, n, CAST(i AS INT) AS i, rank() OVER (PARTITION BY d ORDER BY x) AS r FROM
           (SELECT d, n, unnest(range(0, n)) AS i, unnest(list_transform(string_split(text, ''), lambda z: unicode(z))) AS x FROM t) u)""",
    ]
    for k in range(levels):
        parts.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT d, n, i, CASE WHEN m = 1 THEN r ELSE r + rank() OVER (PARTITION BY d, r ORDER BY b) - 1 END AS r
            FROM (SELECT a.*, coalesce(b.r, 0) AS b FROM (SELECT *, count(*) OVER (PARTITION BY d, r) AS m FROM c{k}) a
                  LEFT JOIN c{k} b ON a.m > 1 AND b.d = a.d AND b.i = a.i + {1 << k}) q)"""
        )
    parts.append(f"p{levels} AS MATERIALIZED (SELECT d, i, lead(i) OVER (PARTITION BY d ORDER BY r) AS j, 0 AS l FROM c{levels})")
    for k in reversed(range(levels)):
        parts.append(
            f"""p{k} AS MATERIALIZED (SELECT p.d, p.i, p.j, p.l + CASE WHEN a.r = b.r AND a.i + {1 << k} <= a.n AND b.i + {1 << k} <= b.n THEN {1 << k} ELSE 0 END AS l
            FROM p{k + 1} p LEFT JOIN c{k} a ON a.d = p.d AND a.i = p.i + p.l LEFT JOIN c{k} b ON b.d = p.d AND b.i = p.j + p.l WHERE p.j IS NOT NULL)"""
        )
    score = "CASE WHEN n > 1 THEN 2.0 * coalesce(l, 0) / (n * (n + 1)) WHEN n IS NOT NULL THEN 0.0 END"
    return f"WITH {', '.join(parts)} SELECT id, n, {score}::DOUBLE AS score FROM t LEFT JOIN (SELECT d, sum(l) AS l FROM p0 GROUP BY d) s USING (d)"
