"""Jaccard join of documents on word shingles by chosen paths.

Every distinct text becomes a vector of minimum hashes over its five-word
shingles. A run starts with all texts in one node. A node draws one or two
coordinates from its own name, and hands each text to the child named by the
coordinate and the text's value there: on average 1/0.8 children a text, so a
pair at the threshold is expected to stay together in one path at any depth.
Nodes of at most ``leaf`` texts are compared directly, larger ones are split
again. Every run draws from coordinates of its own, and there are as many runs
as the target recall needs at the deepest level a run can reach.

Leaves only propose. Texts that hang together through proposals are then
compared pair by pair on their whole shingle sets, in bounded tasks; links and
groups come from these exact comparisons.

Exact copies (same words in the same order) are one text throughout, and count
again in the number of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import (
    Forest,
    chunks,
    grouped,
    lists,
    lowered,
    mix,
    range_hash,
    segments,
    session,
    shingles,
    signed,
    stage,
    sums_before,
    tokens,
)
from rolloom.llm.components import components, tasks

WORDS = 5
THRESHOLD = 0.8
# Coordinates that estimate similarity, and those each run draws paths from.
COORDINATES = 64
DRAWN = 16
# Splits before a node is looked at, and levels of splits after these.
FIRST = 3
DEPTH = 8
LEAF = 256
BLOCK = 512
# Leaves' worth of rows in large nodes that are compared in blocks at once
# instead of being split further: more levels would cost more than they save.
REST = 32
# Texts up to which a shared value is counted pair by pair; columns of a matrix
# and pairs that are counted at once.
FEW = 48
COLUMNS = 4096
PAIRS = 1 << 22
# Bytes of text that a task cuts into words at once: its arrays are 60 times that.
TEXT = 1 << 18
# Share of the pairs at the threshold that the runs bring together, even where
# every node on their way is split down to the last level.
TARGET = 0.999

# Estimates from 64 coordinates have a standard deviation of 0.05 at 0.8: a
# pair at the threshold falls below LIKELY in fewer than one of ten thousand cases.
LIKELY = 38 / 64


def survival(splits: int) -> float:
    """Chance that one run leaves a pair at the threshold together after ``splits``."""
    kept = 1.0
    for _ in range(splits):
        apart = 1 - THRESHOLD * kept
        more = 1 / THRESHOLD - 1
        kept = 1 - (1 - more) * apart - more * apart**2
    return kept


def runs_needed(splits: int, target: float = TARGET) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - survival(splits)))


RUNS = runs_needed(FIRST + DEPTH)


def _factors(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(first, first + count, dtype=np.uint64)
    return mix(at), mix(at + np.uint64(1 << 32)) | np.uint64(1)


def text_shingles(texts: pa.Array, n: int = WORDS):
    """Per chunk: first row, key of each text, its words, shingle hashes, owners.

    A text of one to ``n - 1`` words has one shingle, all its words; a text
    without words has none.
    """
    for first, last, data, offsets in chunks(lowered(texts), TEXT):
        rows = last - first
        start, end = tokens(data, offsets)
        hashes = range_hash(sums_before(data), start, end)
        owner = np.searchsorted(offsets, start, "right") - 1
        count = np.bincount(owner, minlength=rows)
        ends = np.cumsum(count)
        whole = sums_before_words(hashes)
        keys = range_hash(whole, ends - count, ends) ^ mix(count.astype(np.uint64))
        found, of = shingles(hashes, owner, n)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            found, of = np.r_[found, keys[short]], np.r_[of, short]
            order = np.argsort(of, kind="stable")
            found, of = found[order], of[order]
        yield first, keys, count, found, of


def sums_before_words(hashes: np.ndarray) -> np.ndarray:
    return sums_before(mix(hashes))


def _signatures(batches, runs: int):
    """Minimum hashes of each text: ``sig`` to compare by, ``drawn`` for the paths of the runs."""
    count = COORDINATES + runs * DRAWN
    salt, odd = _factors(1, count)
    for batch in batches:
        ids, marks, texts = batch.column(0), batch.column(1), batch.column(2)
        for first, keys, _, found, of in text_shingles(texts):
            at, owners = segments(of)
            if not len(owners):
                continue
            sig = np.empty((len(owners), count), np.int32)
            for k in range(count):
                low = np.minimum.reduceat((found ^ salt[k]) * odd[k], at)
                sig[:, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at = pa.array(owners + first)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), marks.take(at), pa.array(signed(keys[owners])), _rows(sig[:, :COORDINATES]), _rows(sig[:, COORDINATES:])],
                ["doc_id", "t", "k", "sig", "drawn"],
            )


def _rows(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _drawn(node: Column, run: Column) -> Column:
    """One coordinate of the node's run, in a quarter of the cases a second one."""
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(DRAWN)).cast("int")
    step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(DRAWN - 1)).cast("int")
    two = F.pmod(one + 1 + step, F.lit(DRAWN)).cast("int")
    more = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(100)) < int(100 * (1 / THRESHOLD - 1))
    own = run * DRAWN
    return F.explode(F.when(more, F.array(own + one, own + two)).otherwise(F.array(own + one)))


def _children(rows: DataFrame) -> DataFrame:
    """Rows ``(node, run, k, label, drawn)`` handed to the children of their nodes."""
    split = rows.select("node", "run", "k", "label", "drawn", _drawn(F.col("node"), F.col("run")).alias("c"))
    return split.select(F.xxhash64("node", "c", F.get("drawn", F.col("c"))).alias("node"), "run", "k", "label", "drawn")


def _proposals(batches):
    """Edges that connect what is LIKELY inside each leaf."""
    for batch in batches:
        us, vs = [], []
        members = batch.column(0)
        offsets = np.r_[0, np.cumsum(members.value_lengths().to_numpy())]
        flat = members.flatten()
        all_keys, all_sigs = flat.field(0).to_numpy(), flat.field(1).flatten().to_numpy().reshape(-1, COORDINATES)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            keys, sig = all_keys[a:b].tolist(), all_sigs[a:b]
            forest = Forest(len(keys))
            for i in range(len(keys) - 1):
                near = (sig[i + 1 :] == sig[i]).mean(axis=1) >= LIKELY
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    if forest.join(i, j):
                        us.append(keys[i])
                        vs.append(keys[j])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _leaf_links(leaves: DataFrame, texts: DataFrame) -> DataFrame:
    """``leaves(node, k)`` with at most LEAF rows a node; equal leaves count once."""
    sets = leaves.groupBy("node").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    sets = sets.select(F.xxhash64("ks").alias("leaf"), "ks").dropDuplicates(["leaf"])
    rows = sets.select("leaf", F.explode("ks").alias("k")).join(texts.select("k", "sig"), "k")
    packed = rows.groupBy("leaf").agg(F.collect_list(F.struct("k", "sig")).alias("members"))
    return packed.select("members").mapInArrow(_proposals, "u long, v long")


def _closed(rows: DataFrame, leaf: int) -> DataFrame:
    """Leaves ``(node, k)`` that compare the few members apart with all others."""
    parts = F.ceil(F.col("met_n") / leaf).cast("int")
    own = F.array(F.pmod(F.xxhash64("k", "node"), parts).cast("int"))
    part = F.explode(F.when(F.col("met"), own).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part")
    return rows.select("node", "k", part).select(F.xxhash64("node", "part").alias("node"), "k")


def shared_counts(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many values every two of ``n`` texts share, from distinct ``(text, value)``.

    Values of one text count for no pair and those of all texts for every pair.
    Of the others, values of many texts are columns of a 0/1 matrix, whose
    product with itself counts them in blocks of columns; a value of few texts
    counts for its own pairs one by one.
    """
    order = np.argsort(value, kind="stable")
    text, value = text[order], value[order]
    at, _ = segments(value)
    often = np.diff(np.r_[at, len(value)])
    out = np.full((n, n), int((often == n).sum()), np.int64)
    many = np.flatnonzero((often > FEW) & (often < n))
    for low in range(0, len(many), COLUMNS):
        part = many[low : low + COLUMNS]
        column = np.repeat(np.arange(len(part)), often[part])
        place = np.repeat(at[part], often[part]) + np.arange(len(column)) - np.repeat(np.cumsum(often[part]) - often[part], often[part])
        held = np.zeros((n, len(part)), np.float32)
        held[text[place], column] = 1
        out += (held @ held.T).astype(np.int64)
    for f in range(2, min(FEW, n - 1) + 1):
        holders = np.flatnonzero(often == f)
        left, right = np.triu_indices(f, 1)
        for low in range(0, len(holders), max(1, PAIRS // len(left))):
            who = text[at[holders[low : low + max(1, PAIRS // len(left))], None] + np.arange(f)]
            both = np.bincount((who[:, left] * n + who[:, right]).ravel(), minlength=n * n).reshape(n, n)
            out += both + both.T
    return out


def _exact(batches):
    """Links of each text of a task, and its root among the linked ones.

    One task holds one or two blocks of a component. In a task of two blocks
    only pairs across them count.
    """
    for table in grouped(batches, ["comp", "lo", "hi"]):
        table = table.combine_chunks()
        keys = table.column("k").to_numpy()
        weight = table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        values, offsets = lists(table.column("shingles").combine_chunks())
        n, size = len(keys), np.diff(offsets)
        shared = shared_counts(np.repeat(np.arange(n), size), values, n)
        hit = shared >= THRESHOLD * (size[:, None] + size - shared) - 1e-9
        np.fill_diagonal(hit, False)
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            hit &= block[:, None] != block
        links = hit @ weight
        order = np.argsort(keys, kind="stable")
        # the label of a linked group is the place of its smallest key
        label = np.empty(n, np.int64)
        label[order] = np.arange(n)
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            met = np.unique(label[np.r_[i, np.flatnonzero(hit[i])]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        root = keys[order][label]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links.astype(np.int64)), pa.array(root)], ["k", "links", "root"])


def _sets(batches):
    for batch in batches:
        wanted = batch.column(1).to_numpy()
        for first, keys, _, found, of in text_shingles(batch.column(2)):
            at, owners = segments(of)
            ends = np.r_[at[1:], len(of)]
            ks, rows, lengths = [], [], [0]
            for a, b, o in zip(at.tolist(), ends.tolist(), owners.tolist()):
                if signed(keys[o : o + 1])[0] == wanted[first + o]:
                    rows.append(np.unique(found[a:b]))
                    ks.append(wanted[first + o])
                    lengths.append(len(rows[-1]))
            if ks:
                flat = signed(np.concatenate(rows))
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), sets], ["k", "shingles"])


def proposals(texts: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Edges ``(u, v)`` between ``texts(k, sig, drawn)``: what they connect is compared.

    ``drawn`` has ``DRAWN`` coordinates for each run.

    A large node compares its members with one of them, its centre, drawn by a
    hash of node and member. Labels name what is connected: all labels that are
    LIKELY linked to the centre become the centre's. A node whose members share
    one label is connected already and is not split further; nor is a node with
    one member, nor one in which at most ``leaf`` members are apart from the
    centre: these are compared with all others, a part of them in each leaf.
    The leaves of all levels are compared in one job.
    """
    run = F.explode(F.array(*[F.lit(r) for r in range(runs)])).alias("run")
    rows = texts.select(run, "k", F.col("k").alias("label"), "drawn").withColumn("node", F.col("run").cast("long"))
    for _ in range(FIRST):
        rows = _children(rows)
    nodes = stage(rows.drop("drawn"), "paths")
    leaves, found = [], []
    for _ in range(depth):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sized = stage(nodes.join(sizes.where("lo < hi").select("node", "n"), "node"), "nodes")
        leaves.append(sized.where(F.col("n") <= leaf).select("node", "k"))
        large = sized.where(F.col("n") > leaf).drop("n")
        if large.count() <= REST * leaf:
            left = large
            break
        # A member that is missed by one centre meets another one at the next level.
        drawn = F.min(F.struct(F.xxhash64("node", "k"), F.col("k").alias("centre"), F.col("label").alias("middle"))).alias("c")
        centre = large.groupBy("node").agg(drawn).select("node", "c.centre", "c.middle")
        centre = centre.join(texts.select(F.col("k").alias("centre"), F.col("sig").alias("other")), "centre")
        near = large.join(centre, "node").join(texts.select("k", "sig"), "k")
        agree = F.size(F.filter(F.zip_with("sig", "other", lambda a, b: a == b), lambda x: x)) / COORDINATES
        near = stage(near.select("node", "run", "k", "label", "centre", "middle", (agree >= LIKELY).alias("likely")), "centres")
        found.append(near.where(F.col("likely") & (F.col("k") != F.col("centre"))).select(F.col("centre").alias("u"), F.col("k").alias("v")).distinct())
        labels = near.groupBy("node", "label").agg(F.max("likely").alias("met"), F.min("middle").alias("middle"), F.count("*").alias("n"))
        counts = labels.groupBy("node").agg(F.sum(F.when(F.col("met"), F.col("n"))).alias("met_n"), F.sum(F.when(~F.col("met"), F.col("n"))).alias("apart"))
        labels = labels.drop("n").join(counts.where("apart > 0"), "node")
        rest = near.select("node", "run", "k", "label").join(labels, ["node", "label"])
        rest = stage(rest.withColumn("label", F.when(F.col("met"), F.col("middle")).otherwise(F.col("label"))), "mixed")
        leaves.append(_closed(rest.where(F.col("apart") <= leaf), leaf))
        rest = rest.where(F.col("apart") > leaf).select("node", "run", "k", "label").join(texts.select("k", "drawn"), "k")
        nodes = stage(_children(rest).drop("drawn"), "paths")
    else:
        sizes = nodes.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node")
        left = nodes.join(sizes, "node", "left_semi")
    # What is still large after the last level, or is little, is compared in blocks.
    left = left.select(F.col("node").alias("comp"), F.col("k").alias("id"))
    leaves.append(tasks(left, leaf).select(F.xxhash64("comp", "lo", "hi").alias("node"), F.col("id").alias("k")))
    found.append(stage(_leaf_links(_union(leaves), texts), "leaf_links"))
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def classes(docs: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Per row with words: ``doc_id, t`` (hash of the text), the class and its first row.

    ``first`` is the smallest (doc_id, t) of the class; see near_duplicates.
    """
    session(docs)
    docs = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text")
    )
    scan = lambda batches: _signatures(batches, runs)
    known = stage(docs.mapInArrow(scan, "doc_id long, t long, k long, sig array<int>, drawn array<int>"), "signatures")
    texts = known.groupBy("k").agg(
        F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("drawn").alias("drawn")
    )
    texts = stage(texts, "texts")
    groups = components(proposals(texts, runs, leaf, depth), "proposed")
    members = stage(groups.join(texts.select(F.col("k").alias("id"), "first", "copies"), "id"), "members")
    # copies are at least 1: a filter lets Spark build a Bloom filter from it
    wanted = members.where("copies > 0").select("first.*", F.col("id").alias("k"))
    sets = docs.join(wanted, ["doc_id", "t"]).select("doc_id", "k", "text").mapInArrow(_sets, "k long, shingles array<long>")
    sets = sets.dropDuplicates(["k"])
    dealt = tasks(members.select("id", "comp", "copies"), block).withColumnRenamed("id", "k")
    pieces = dealt.join(sets, "k").repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "k")
    pieces = pieces.select("comp", "lo", "hi", "block", "copies", "k", "shingles")
    exact = stage(pieces.mapInArrow(_exact, "k long, links long, root long"), "exact")
    linked = exact.groupBy("k").agg(F.sum("links").alias("links"))
    joined = components(exact.select(F.col("k").alias("u"), F.col("root").alias("v")), "classes")
    joined = joined.select(F.col("id").alias("k"), "comp").join(linked, "k")
    named = texts.select("k", F.col("first").alias("copy"), "copies").join(joined, "k", "left")
    named = stage(named.withColumn("comp", F.coalesce("comp", "k")), "named")
    first = named.groupBy("comp").agg(F.min("copy").alias("first"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = named.join(first, "comp").select("k", F.col("copy.doc_id").alias("copy_id"), "first", links)
    return known.select("doc_id", "t", "k").join(named, "k").select("doc_id", "t", "first", "copy_id", "n_links")


def near_duplicates(docs: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: class_id, copy_id, n_links.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of 0.8 or more with the row's; ``copy_id`` is the smallest id
    with the same words; ``class_id`` the smallest id of the group that links
    connect. Links are exact; a link is lost only where no run and no chain of
    other links brings its ends together.

    Rows with a null id are not returned. A null, empty or wordless text has no
    links and is its own class; a text of one to four words has one shingle,
    all its words. Rows that repeat an id are rows of their own, linked by
    their texts alone. Other columns are ignored; an empty table gives an empty
    result.
    """
    found = classes(docs, runs, leaf, depth, block)
    out = found.select("doc_id", F.col("first.doc_id").alias("class_id"), "copy_id", "n_links")
    blank = docs.where(F.col("doc_id").isNotNull() & ~has_words(F.col("text"))).select(F.col("doc_id").cast("long").alias("doc_id"))
    alone = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionAll(alone)


def has_words(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).rlike("[a-zA-Z0-9\\x{80}-\\x{10FFFF}]")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the first row of every class; rows without id or words stay.

    Of rows that repeat both id and text one stays.
    """
    found = stage(classes(docs).select("doc_id", "t", "first"), "found")
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    names = [F.col("doc_id").alias("_llm_id"), F.col("t").alias("_llm_t")]
    gone = stage(found.where(~own).select(*names).distinct(), "gone")
    again = stage(found.where(own).groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select(*names), "again")
    this = (docs["doc_id"].cast("long") == F.col("_llm_id")) & (F.xxhash64(docs["text"]) == F.col("_llm_t"))
    left = docs.join(gone, this, "left_anti")
    if again.isEmpty():
        return left
    this = (left["doc_id"].cast("long") == F.col("_llm_id")) & (F.xxhash64(left["text"]) == F.col("_llm_t"))
    return left.join(again, this, "left_anti").unionAll(left.join(again, this, "left_semi").dropDuplicates(["doc_id", "text"]))
