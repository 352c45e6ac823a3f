"""Decision lists, the radix draw and periodic runs against plain computations."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rolloom.llm import decisions, periodic, radix

DOCS = "doc_id bigint, text string, n_words int, rank string, _block int, _at string, rule double, kept string"
SPLIT = re.compile("[^\x20\x09-\x0d]+")
random.seed(8)
VOCABULARY = ["".join(random.choice("aeioubcdfgklmn") for _ in range(random.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def texts():
    loop = "again and once more " * 30
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a " * 7), (5, "x\x1cy \x85 z w " * 9), (6, loop), (7, prose(200, 1) + " " + loop + prose(60, 2)),
        (8, prose(30, 3) + "\n" + prose(30, 4) + "\n" + prose(30, 3) + "\n \n" + prose(30, 3)), (9, "B" * 900), (10, "##|| <b> $5 " * 20), (11, prose(5000, 5)),
        (None, prose(100, 6)), (6, loop), (12, "Ünï ÇØDÉ 漢字 漢字 " * 25), (6, prose(70, 9)), (-5, "1 2 3 " * 40), *[(i, prose(20 + i % 50, i)) for i in range(20, 90)],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 2, "y", 0.5, "z") for i, t in texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- decision lists -----------------------------------------------------------
def plain_counts(text):
    text = text or ""
    w = SPLIT.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_and_base(docs, none, spark):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id bigint, quality int, rule int")
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in decisions.judged(docs, labels).collect())
    want = collections.Counter()
    for i, t in texts():
        n, *more, repeats = plain_counts(t)
        failed = n < 50 or 100 * repeats > 50 * n
        # labels of one kind only: no rules
        want[(i, n, *more, repeats, failed, not failed)] += 1
    assert got == want
    assert decisions.judged(none, labels).count() == 0 and decisions.judged(none, labels.limit(0)).count() == 0


def plain_best(rows, bad, names):
    """The best condition by trying every share, side and cut."""
    p0, n0 = sum(bad), len(bad) - sum(bad)
    best = (1e-9, None)
    for name in names:
        values = sorted({r[name] for r in rows})
        for above in (False, True):
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                inside = [(r[name] > cut) == above for r in rows]
                p = sum(x and y for x, y in zip(inside, bad))
                n = sum(x and not y for x, y in zip(inside, bad))
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0
                if gain > best[0] + 1e-9:
                    best = (gain, (name, above, cut))
    return best[1]


def test_conditions_are_the_best_ones():
    r = random.Random(1)
    for _ in range(25):
        names = list(decisions.SHARES)
        rows = [{n: float(r.randint(0, 6)) for n in names} for _ in range(40)]
        bad = [x[names[2]] + x[names[4]] + r.randint(0, 3) > 8 for x in rows]
        if not any(bad) or all(bad):
            continue
        got = decisions.best_condition(pd.DataFrame(rows), np.array(bad))
        assert tuple(got) == plain_best(rows, bad, names)


def test_rules_are_learned_pruned_and_applied_alike(spark):
    """Two kinds of junk: rules name both, and the expression agrees with the list."""
    r = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        w = prose(r.randint(60, 200), 5000 + i).split()
        bad = i % 3 == 0
        if i % 6 == 0:
            w = [x + "###" for x in w]
        elif bad:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w)))
        # some labels are wrong
        marks.append((i, int(not bad) if i % 50 else int(bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    table = decisions.labelled(decisions.statistics(frame), labels)
    rules = decisions.learn(table, precision=0.9)
    assert 2 <= len(rules) <= 6 and all(1 <= len(x) <= decisions.CONDITIONS for x in rules)
    got = {x.doc_id: x.rule for x in decisions.judged(frame, labels, precision=0.9).collect()}
    for x in table.itertuples():
        holds = [n for n, rule in enumerate(rules, 1) if all((getattr(x, c.share) > c.cut) == c.above for c in rule)]
        assert got[x.doc_id] == (holds[0] if holds else None)
    right = sum((got[i] is not None) == (i % 3 == 0) for i in range(900))
    assert right >= 890
    # the bound holds, and a smaller sample still gives rules
    assert len(decisions.labelled(decisions.statistics(frame), labels, sample=300)) == 300
    assert decisions.described(frame, labels, sample=300)


# --- radix draw -----------------------------------------------------------------
def plain_features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_draw(rows, target):
    """Row by row: features, gains, weights, scores, sorted ranks."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in rows for f in plain_features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k in s}
    out = []
    for i, text in rows:
        w, f = plain_features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in out if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0], r[5]))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return collections.Counter(map(tuple, out))


def test_draw(spark, docs, none):
    target = [prose(40, 20), None, "", prose(30, 31), "Ünï 漢字"]
    bench = spark.createDataFrame([(x, 1) for x in target], "text string, score int")
    for block in (7, 1 << 20):
        got = collections.Counter(map(tuple, radix.drawn(docs, bench, block=block).collect()))
        assert got == plain_draw(texts(), target)
    empty = collections.Counter(map(tuple, radix.drawn(docs, bench.limit(0)).collect()))
    assert empty == plain_draw(texts(), [])
    assert radix.drawn(none, bench).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = (prose(300, 4) + " Ä" * 3 + "  " + "y" * 90).encode()
    whole = [np.concatenate(x) for x in zip(*radix.checksums(text))]
    monkeypatch.setattr(radix, "PIECE", 50)
    assert len(list(radix.pieces(text))) > 10
    assert all((np.concatenate(a) == b).all() for a, b in zip(zip(*radix.checksums(text)), whole))
    assert [zlib.crc32(x.encode()) for x in plain_features(text.decode())[1]] == [*whole[0], *whole[1]]


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_radix_positions(spark, block):
    """Order of two signed keys, one descending, with ties and extremes."""
    r = random.Random(block)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 5000, -70000]
    rows = [(r.choice(values), r.choice([*values, r.randint(-99, 99)]), i) for i in range(150)] + [(5, 5, 1), (5, 5, 1)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, c int")
    got = radix.sort_positions(frame, {"a": True, "b": False}, "at", block).orderBy("at").collect()
    assert [x.at for x in got] == list(range(len(rows)))
    assert [tuple(x)[:3] for x in got] == sorted(rows, key=lambda x: (-x[0], x[1], x[2]))
    same = radix.sort_positions(frame.select(a := __import__("pyspark").sql.functions.lit(4).cast("long").alias("a"), "c"), {"a": False}, "at", block)
    assert sorted(x.at for x in same.collect()) == list(range(len(rows))) and a is not None
    assert radix.sort_positions(frame.limit(0), {"a": True, "b": False}, "at", block).count() == 0


# --- periodic runs ----------------------------------------------------------------
def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_report(doc_id, text, plant):
    w = SPLIT.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 4
    if runs:
        s, m, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
        best = (s, m, q, 1000 * m // q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made_texts():
    r = random.Random(5)
    for k in range(400):
        v = [f"w{i}" for i in range(r.choice([1, 2, 3, 5, 30]))]
        w = [r.choice(v) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            unit = [r.choice(v) for _ in range(r.randint(1, 9))]
            at = r.randint(0, len(w))
            w[at:at] = (unit * r.randint(2, 7))[: r.randint(1, 80)]
        yield k, r.choice([" ", "\n", " \t"]).join(w)


@pytest.mark.parametrize("plant", [True, False])
def test_runs(spark, docs, none, plant):
    got = collections.Counter(tuple(r)[:8] for r in periodic.run_report(docs, plant).collect())
    # the longest text is left to the next test: the plain scan is cubic
    short = [(i, t) for i, t in texts() if i != 11]
    assert not collections.Counter(plain_report(i, t, plant) for i, t in short) - got
    rows = list(made_texts())
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter(tuple(r)[:8] for r in periodic.run_report(frame, plant).collect())
    assert got == collections.Counter(plain_report(i, t, plant) for i, t in rows)
    assert periodic.run_report(none, plant).count() == 0


def numbered(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)


def test_splitting_loses_no_run():
    """Scanning the whole text and scanning the surviving segments agree."""
    for _, text in made_texts():
        ids = numbered(text.split() or ["x"])
        bounds = np.array([0, len(ids)])
        whole = periodic.scan_lags(ids, bounds[:1], bounds[1:])
        assert all((a == b).all() for a, b in zip(periodic.periodic_runs(ids, bounds), whole))
    r = random.Random(3)
    prose_like = numbered([f"{min(int(r.paretovariate(0.6)), 9999)}" for _ in range(4000)] + ["a", "b", "c"] * 9)
    start, end = periodic.split_by_frequency(prose_like, np.array([0, len(prose_like)]))
    assert (end - start).sum() < 1000 and ((start <= 4000) & (end >= 4027)).any()


def test_equal_hashes_of_different_words_do_not_count(monkeypatch):
    """With a hash that calls everything equal the plain scan still decides."""
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, at, width, lag: np.ones(len(at), bool))
    for _, text in list(made_texts())[:60]:
        w = text.split()
        if len(w) >= 8:
            s, e, q = periodic.scan_lags(numbered(w), np.array([0]), np.array([len(w)]))
            assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == plain_runs(w)


def test_long_periodic_texts_stay_cheap():
    n = 300_000
    for words in (["a"] * n, [str(x) for x in np.random.default_rng(1).integers(0, 2, n)]):
        s, e, q = periodic.periodic_runs(numbered(words), np.array([0, n]))
        assert len(s) and (words[0] != "a" or (s[0], e[0], q[0]) == (0, n, 1))


def test_collapsed(docs, none):
    out = periodic.collapsed(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (4, "a ") in got and (6, "again and once more ") in got and (0, None) in got and (1, "") in got
    assert (11, prose(5000, 5)) in got and (7, prose(200, 1) + " again and once more " + prose(60, 2)) in got
    assert periodic.collapsed(none).count() == 0


def test_batches_of_null_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([None, 4], pa.int64()), pa.array([None, None], pa.string())], ["doc_id", "text"])
    (out,) = periodic._rows(True)([batch])
    assert out.column("n_runs").to_pylist() == [0, 0] and out.column("start").to_pylist() == [None, None]
