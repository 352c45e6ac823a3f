"""Quality rules: a decision list learned by sequential covering.

Every text is reduced to a row of counts, and shares are formed from these. From
a bounded sample of labelled rows, conjunctions of thresholds on the shares are
learned one after the other: a rule is grown condition by condition on two
thirds of the rows by the information it gains, pruned from its end on the
other third, and kept if it is right there often enough; the rows it covers
are taken out before the next rule is grown. The list becomes one conditional
expression over the counts, tried in order, so all rows are judged in the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.common import session, stage
from rolloom.llm.words import SPACE, Words, numbers, pieces, runs, words

LABELS = 20_000
SEED = 11
# A rule must be right on so many of the pruning rows it covers: a good
# document lost costs more than a bad one kept.
PRECISION = 0.95
# Covered rows of the pruning third below which a rule proves nothing.
SUPPORT = 3
# Conditions of one rule; a longer one is no longer read by a person.
CONDITIONS = 4

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?\"'()[]{}+=_^~@/\\`:;")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row has; ``offsets`` are the rows' bounds."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and how often each number occurs."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    return number, times


def _repeated(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that its row holds twice or more."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < 3:
        return out
    at = np.flatnonzero(row[2:] == row[:-2])
    # numbers of pairs, triples and triples of one row: each step is exact
    key = ids[at] * (n + 1) + ids[at + 1]
    for more in (ids[at + 2], row[at]):
        number, _ = _groups(key)
        key = number * (n + 1) + more
    number, times = _groups(key)
    twice = at[times[number] > 1]
    for k in range(3):
        out[twice + k] = True
    return out


def _duplicate_lines(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per row, and those of them equal to an earlier line."""
    data, offsets = part.data, part.offsets
    start, end = runs(data != 10, offsets)
    blank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=blank[1:])
    some = blank[end] > blank[start]
    start, end = start[some], end[some]
    row = np.searchsorted(offsets, start, "right") - 1
    rows = len(offsets) - 1
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    lines = pieces(data[np.cumsum(inside[:-1]) > 0], np.r_[0, np.cumsum(end - start)])
    distinct = np.unique(row * (len(start) + 1) + numbers(lines))
    count = np.bincount(row, minlength=rows)
    return count, count - np.bincount(distinct // (len(start) + 1), minlength=rows)


def counted(part: Words) -> list[np.ndarray]:
    """The columns ``COUNTS`` for the rows of a chunk."""
    data, offsets, bounds = part.data, part.offsets, part.bounds
    rows = len(bounds) - 1
    ids = numbers(part.words)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    # bytes that begin a character
    head = (data & 0xC0) != 0x80
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    lines, repeats = _duplicate_lines(part)
    distinct = np.unique(row * (len(ids) + 1) + ids) // (len(ids) + 1)
    return [
        np.diff(bounds),
        _per_row(head & ~SPACE[data], offsets),
        _per_row(_SYMBOL[data], offsets),
        repeats,
        np.bincount(row[_repeated(ids, row)], minlength=rows),
        lines,
        np.bincount(distinct, minlength=rows),
        _per_row(upper, offsets),
        _per_row(lower | upper, offsets),
        _per_row((data >= 48) & (data <= 57), offsets),
        _per_row(_MARK[data], offsets),
    ]


def _scan(batches):
    for batch in batches:
        for part in words(batch.column(1)):
            ids = batch.column(0).slice(part.first, len(part.bounds) - 1)
            columns = [pa.array(c.astype(np.int64)) for c in counted(part)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` per row; a null text has no words."""
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS]]))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


# What the rules speak about.
SHARES = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
    "distinct_words": lambda: _share("n_distinct_words", "n_words"),
    "upper_letters": lambda: _share("n_upper", "n_letters"),
    "digits_per_char": lambda: _share("n_digits", "word_chars"),
    "marks_per_word": lambda: _share("n_marks", "n_words"),
    "words_per_line": lambda: _share("n_words", "n_lines"),
}


class Condition(NamedTuple):
    share: str
    above: bool
    cut: float

    def __str__(self):
        return f"{self.share} {'>' if self.above else '<='} {self.cut:.6g}"

    def covers(self, table: pd.DataFrame) -> np.ndarray:
        x = table[self.share].to_numpy()
        return x > self.cut if self.above else x <= self.cut

    def column(self) -> Column:
        x = SHARES[self.share]()
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(table), bool)
    for condition in rule:
        out &= condition.covers(table)
    return out


def best_condition(table: pd.DataFrame, bad: np.ndarray) -> Condition | None:
    """The threshold that gains most information about the bad rows it keeps.

    The gain is FOIL's: bad rows kept times the bits saved in saying that one
    of the rows kept is bad. Ties go to the first share, then the lower cut.
    """
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return None
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for share in SHARES:
        x = table[share].to_numpy()
        order = np.argsort(x, kind="stable")
        v = x[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(bad[order])[cut], np.cumsum(~bad[order])[cut]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = p * (np.log2(np.maximum(p, 0.5) / np.maximum(p + n, 0.5)) - base)
            gain[p == 0] = 0
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], Condition(share, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return found


def grow(table: pd.DataFrame, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(table), bool)
    while len(rule) < CONDITIONS and (~bad[inside]).any():
        condition = best_condition(table[inside], bad[inside])
        if condition is None:
            break
        rule += (condition,)
        inside &= condition.covers(table)
    return rule


def prune(rule: Rule, table: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best balance, and what it covers."""
    best, worth = ((), 0, 0), -np.inf
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], table)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            best, worth = (rule[:k], p, n), (p - n) / (p + n)
    return best


def learn(table: pd.DataFrame, precision: float = PRECISION) -> list[Rule]:
    """Rules that recognise the rows of quality 0, in the order they are tried.

    ``table`` has the shares, ``quality`` and ``hold``, true for the third that
    prunes. Every accepted rule takes rows out, so the list ends.
    """
    rules: list[Rule] = []
    while True:
        bad = table["quality"].to_numpy() == 0
        hold = table["hold"].to_numpy()
        rule = grow(table[~hold], bad[~hold])
        if not rule:
            return rules
        rule, p, n = prune(rule, table[hold], bad[hold])
        if p < SUPPORT or p < precision * (p + n):
            return rules
        rules.append(rule)
        table = table[~covers(rule, table)]


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        test = F.lit(True)
        for condition in rules[number - 1]:
            test = test & condition.column()
        out = F.when(test, F.lit(number)).otherwise(out)
    return out


def labelled(stats: DataFrame, labels: DataFrame, sample: int = LABELS, seed: int = SEED) -> pd.DataFrame:
    """Shares of at most ``sample`` labelled ids, chosen by a hash of the id.

    An id labelled twice has its worse label; an id that several rows bear
    stands with each of them, as far as the bound goes.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(seed))
    known = known.orderBy(order, "doc_id").limit(sample)
    hold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) == 0
    rows = stats.join(known, "doc_id").select("doc_id", "quality", hold.alias("hold"), *[c().alias(n) for n, c in SHARES.items()])
    return rows.orderBy(order, *rows.columns).limit(sample).toPandas()


def failed_base(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or repeating itself for more than half."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judged(docs: DataFrame, labels: DataFrame, sample: int = LABELS, precision: float = PRECISION) -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``rule``.

    ``rule`` is the number of the learned rule that rejects the row, null if
    none does. A null or empty text has no words and fails the base. Rows with
    a null id are judged, never learned from; rows that repeat an id are judged
    each. Without labels of both kinds there are no rules. Other columns are
    ignored; an empty table gives an empty result.
    """
    stats = stage(statistics(docs), "counts")
    rules = learn(labelled(stats, labels, sample), precision)
    failed = failed_base(F.col("n_words"), F.col("n_repeat_words"))
    rule = verdict(rules)
    return stats.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def described(docs: DataFrame, labels: DataFrame, sample: int = LABELS) -> list[str]:
    """The learned rules as text, in order."""
    rules = learn(labelled(stage(statistics(docs), "counts"), labels, sample))
    return [" and ".join(map(str, rule)) for rule in rules]
