"""Mixing sources to target weights by a budget that flows down a tree.

The tree is domain, language, source. Every node has a weight among its
siblings and a capacity: the tokens below it times the epochs a leaf may be
read. A node's budget is shared among its children by weight; a child never
gets more than its capacity, and what it cannot take goes to the siblings with
room, by weight again. Since a node's budget never exceeds its own capacity,
its shortage has already gone to *its* siblings one level up: siblings serve
before ancestors do.

Sharing is in closed form. Ordered by capacity per weight, the children that
fill up are a prefix, so running sums over one row per child decide it.

Each leaf then reads seeded epochs: in each one its documents come in the
order of a hash of seed, epoch and id, and the leaf takes the prefix that
holds its tokens; the last document may be taken in part. Running token counts
go through buckets of the hash, so no window spans a leaf, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.common import stage

TREE = ["domain", "lang", "source"]
EPOCHS = 4
SEED = 17
# Leading hexadecimal digits of the order hash that name a bucket of a leaf.
DIGITS = 3


def token_count(text: Column) -> Column:
    """Words separated by white space; 0 for null and blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\r]+"))).cast("long")


def _share(nodes: DataFrame, parent: list[str], ties: list[str]) -> DataFrame:
    """Adds ``budget`` from the parent's ``total``, with ``w`` and ``cap``.

    Child j fills up exactly when ``cap_j * (w_j + w_{j+1} + ...) <= w_j *
    (total - cap_1 - ... - cap_{j-1})``. Weights are whole numbers, so sums do
    not depend on their order.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), *ties)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    placed = nodes.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("long").alias("used"),
        F.sum("w").over(after).alias("left_w"),
    )
    fair = F.col("w").cast("double") * (F.col("total") - F.col("used")) / F.col("left_w")
    fills = F.col("cap") <= fair
    placed = placed.select("*", F.when(fills, F.col("cap").cast("double")).alias("filled"))
    # the level of the others follows from those that fill up
    every = Window.partitionBy(*parent)
    placed = placed.select(
        "*",
        F.coalesce(F.sum(F.when(fills, F.col("cap"))).over(every), F.lit(0)).alias("full_cap"),
        F.sum(F.when(fills, 0).otherwise(F.col("w"))).over(every).alias("open_w"),
    )
    level = F.col("w").cast("double") * (F.col("total") - F.col("full_cap")) / F.col("open_w")
    budget = F.when(fills, F.col("cap")).otherwise(F.floor(level + F.lit(1e-6))).cast("long")
    return placed.select(*nodes.columns, budget.alias("budget"))


def budgets(leaves: DataFrame, total: int | Column, weights: list[Column], epochs: int = EPOCHS) -> DataFrame:
    """Token budget of every leaf of ``leaves(*TREE, tokens)``.

    ``weights[i]`` is the whole-number weight, at least 1, of a node of level i,
    computed from the tree columns up to that level.
    """
    caps = leaves.select(*TREE, (F.col("tokens") * epochs).alias("cap"))
    now = None
    for depth in range(len(TREE)):
        path = TREE[: depth + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).where("cap > 0").withColumn("w", weights[depth].cast("long"))
        if now is None:
            whole = nodes.agg(F.sum("cap").alias("all")).select(F.least(F.lit(total) if isinstance(total, int) else total, F.col("all")).cast("long").alias("total"))
            nodes = nodes.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one").drop("_one")
        else:
            nodes = nodes.join(now, TREE[:depth])
        now = _share(nodes, TREE[:depth] or ["total"], path).select(*path, F.col("budget").alias("total"))
    return now.withColumnRenamed("total", "budget")


def domain(source: Column) -> Column:
    """Sources fall into four domains by the first digit of a hash of their name."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1)) - 1
    return F.concat(F.lit("d"), F.pmod(digit, F.lit(4)).cast("string"))


def target_weights() -> list[Column]:
    """Domains 4:3:2:1, English five times any other language, sources alike."""
    return [
        F.lit(4) - F.substring("domain", 2, 1).cast("int"),
        F.when(F.col("lang") == "en", 5).otherwise(1),
        F.lit(1),
    ]


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, the tree columns and ``tokens``; null names become ``''``."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        source.alias("source"),
        token_count(F.col("text").cast("string")).alias("tokens"),
    )


def mixed(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """The mixture: ``doc_id, domain, lang, source, epoch, tokens, taken``.

    The whole budget is half of the tokens of the table. One row per document
    and epoch in which it is read; ``taken`` is at most ``tokens`` and smaller
    only for the last document of a leaf. Documents without tokens and rows
    with a null id are not drawn; a null language or source is the name ``''``.
    Rows that repeat an id are rows of their own, ordered by their token count,
    equal rows by no rule (they are the same). Other columns are ignored; an
    empty table gives an empty mixture.
    """
    rows = stage(leaf_rows(docs).where("tokens > 0"), "leaves")
    leaves = stage(rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens")), "leaf_totals")
    whole = (leaves.agg(F.sum("tokens")).first()[0] or 0) // 2
    given = budgets(leaves, whole, target_weights(), epochs).join(leaves.withColumnRenamed("tokens", "size"), TREE)
    given = stage(given, "budgets")
    # epochs before the last are read whole, the last one in part
    spans = given.select(
        *TREE, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "size",
        "budget",
    ).select(*TREE, "epoch", "size", (F.col("budget") - F.col("epoch") * F.col("size")).alias("want")).where("want > 0")
    drawn = rows.join(spans, TREE).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id").cast("binary")))
    full = drawn.where("want >= size").select("doc_id", *TREE, "epoch", "tokens", F.col("tokens").alias("taken"))
    part = drawn.where("want < size").withColumn("b", F.substring("h", 1, digits))
    keys = [*TREE, "epoch"]
    buckets = part.groupBy(*keys, "b").agg(F.sum("tokens").alias("in_bucket"))
    prior = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*keys, "b", F.coalesce(F.sum("in_bucket").over(prior), F.lit(0)).alias("start"))
    # a bucket that begins beyond the budget holds nothing to take
    inside = Window.partitionBy(*keys, "b").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = part.join(starts, [*keys, "b"]).where("start < want")
    before = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = placed.select("*", before.alias("before")).where("before < want")
    cut = placed.select("doc_id", *TREE, "epoch", "tokens", F.least(F.col("tokens"), F.col("want") - F.col("before")).alias("taken"))
    return full.unionAll(cut)


def _share_sql(name: str, parent: str, ties: str) -> str:
    """The sharing rule in SQL over ``nodes(<path>, cap, w, total)``."""
    by = f"PARTITION BY {parent}"
    return f"""
{name}_1 AS (SELECT *,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM {name}_0 WINDOW o AS ({by} ORDER BY cap::DOUBLE / w, {ties})),
{name}_2 AS (SELECT *, cap <= w::DOUBLE * (total - used)::DOUBLE / left_w AS fills FROM {name}_1),
{name}_3 AS (SELECT *, coalesce(sum(CASE WHEN fills THEN cap END) OVER ({by}), 0) AS full_cap,
    sum(CASE WHEN fills THEN 0 ELSE w END) OVER ({by}) AS open_w FROM {name}_2),
{name} AS (SELECT * EXCLUDE (total, used, left_w, fills, full_cap, open_w, cap, w),
    CASE WHEN fills THEN cap ELSE floor(w::DOUBLE * (total - full_cap)::DOUBLE / open_w + 1e-6) END::BIGINT AS total
  FROM {name}_3)"""


SQL = f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS t
  FROM documents WHERE doc_id IS NOT NULL),
rows_ AS (
  SELECT doc_id, 'd' || ((instr('0123456789abcdef', substr(md5(source), 1, 1)) - 1) % 4) AS domain, lang, source,
    len(string_split_regex(t, '[ \\t\\n\\r]+')) AS tokens
  FROM named WHERE t <> ''),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size FROM rows_ GROUP BY ALL),
whole AS (SELECT least(sum(size) // 2, sum(size) * {EPOCHS})::BIGINT AS total FROM leaves),
a_0 AS (SELECT domain, (sum(size) * {EPOCHS})::BIGINT AS cap, 4 - substr(domain, 2, 1)::INT AS w,
  (SELECT total FROM whole) AS total FROM leaves GROUP BY domain),
{_share_sql("a", "total", "domain")},
b_0 AS (SELECT domain, lang, (sum(size) * {EPOCHS})::BIGINT AS cap, CASE WHEN lang = 'en' THEN 5 ELSE 1 END AS w,
  any_value(a.total) AS total FROM leaves JOIN a USING (domain) GROUP BY domain, lang),
{_share_sql("b", "domain", "domain, lang")},
c_0 AS (SELECT domain, lang, source, (sum(size) * {EPOCHS})::BIGINT AS cap, 1 AS w,
  any_value(b.total) AS total FROM leaves JOIN b USING (domain, lang) GROUP BY domain, lang, source),
{_share_sql("c", "domain, lang", "domain, lang, source")},
spans AS (
  SELECT domain, lang, source, epoch, size, c.total - epoch * size AS want
  FROM c JOIN leaves USING (domain, lang, source), range({EPOCHS}) e(epoch) WHERE c.total - epoch * size > 0),
placed AS (
  SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens, want,
    coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch
      ORDER BY md5(concat_ws(':', '{SEED}', epoch, doc_id)), doc_id, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ JOIN spans USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch, tokens, least(tokens, want - before)::BIGINT AS taken
FROM placed WHERE before < want
"""
