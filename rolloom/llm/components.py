"""Connected components of an edge table, and work lists inside components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import Forest, stage

# Edges of a task that are contracted at once.
HELD = 1 << 19


def _forest(batches):
    """The same connections by fewer edges: every node of a stretch to its root."""

    def flush(held):
        ends = np.concatenate(held, axis=1)
        names, number = np.unique(ends, return_inverse=True)
        number = np.unique(number.reshape(ends.shape), axis=1)
        forest = Forest(len(names))
        for u, v in zip(*number.tolist()):
            forest.join(u, v)
        roots = np.array([forest.root(i) for i in range(len(names))])
        # a node that has no edge but to itself stays known
        own = np.zeros(len(names), bool)
        own[np.unique(roots[roots != np.arange(len(names))])] = True
        keep = ~own
        return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[roots[keep]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= HELD:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _digest(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(found)


def _hang(pairs: DataFrame, own: str) -> DataFrame:
    """For each ``own`` the smallest of itself and its neighbours, beside its pairs.

    The smallest is an aggregate joined back, so a node with very many
    neighbours is reduced first and its join can be split.
    """
    least = pairs.groupBy(own).agg(F.least(F.min("near"), F.col(own)).alias("low"))
    return pairs.join(least, own)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(u long, v long)`` to ``(id, comp)``; comp is the smallest id of the group.

    Alternates two rules until nothing changes: every node hands its larger
    neighbours to the smallest one it knows, then its smaller ones. Loops and
    repeated edges are allowed; rows with a null end are ignored. Rounds grow
    with the logarithm of the longest chain; each is written to the shared
    folder. An empty table gives an empty table.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    # each task first keeps a forest of its edges, so fewer rows and shorter
    # chains come to the first exchange
    contracted = edges.select("u", "v").mapInArrow(_forest, "u long, v long")
    ordered = contracted.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(ordered.distinct(), label)
    seen = _digest(now)
    while True:
        proper = now.where("u <> v")
        both = proper.select(F.col("u").alias("own"), F.col("v").alias("near")).unionAll(
            proper.select(F.col("v").alias("own"), F.col("u").alias("near"))
        )
        large = _hang(both, "own").where("near > own").select(F.col("near").alias("u"), F.col("low").alias("v"))
        large = large.unionAll(now.where("u = v")).distinct()
        down = large.select(F.col("u").alias("own"), F.col("v").alias("near"))
        hung = _hang(down, "own")
        small = hung.select(F.col("near").alias("u"), F.col("low").alias("v")).unionAll(
            hung.select(F.col("own").alias("u"), F.col("low").alias("v"))
        )
        now = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        was, seen = seen, _digest(now)
        if was == seen:
            break
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))


def tasks(members: DataFrame, limit: int) -> DataFrame:
    """Splits the comparison of all members of a component into bounded tasks.

    ``members`` has ``id`` and ``comp`` and any further columns. A component of
    up to ``limit`` members is one task; a larger one is dealt into blocks, and
    every two blocks form a task, so each pair meets exactly once. Adds
    ``task`` (first and last block) and ``block``.
    """
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("nb", F.ceil(F.col("n") / limit).cast("int"))
    dealt = members.join(sizes.select("comp", "nb"), "comp").withColumn(
        "block", F.expr("cast(pmod(xxhash64(id, 7), nb) as int)")
    )
    other = F.explode(F.expr("sequence(0, nb - 1)")).alias("other")
    return (
        dealt.select("*", other)
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("other")
    )
