"""Personal data by candidate gradient boosting.

Four patterns with checks give the base spans. Generators of high recall
propose many more stretches, which may overlap: any run of digits with
separators, anything around an at sign, dotted numbers, spelled-out addresses.
Boosted trees score each proposal by its format and its context. They learn
from the corpus itself: a proposal is positive if it is a base span, negative
if it has the shape of one but fails its check; so do digit
runs beyond a phone's 10 to 15 digits and prose like 'at home. The'. What else
only a generator proposes has no label; all but base spans are scored. The checks themselves (Luhn, octets, the plus sign)
are no features, and a spelled-out address is described as it reads with its
signs. The labelled proposals of two thirds of the rows train the trees, those of the
rest calibrate, per kind, the lowest threshold that keeps the wanted precision. Selected proposals that overlap no base span are
added, the likelier one of two that overlap; base spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm import spans
from rolloom.llm.common import session, stage

KINDS = ["email", "ip", "card", "phone", "email_like", "ip_like", "card_like", "phone_like"]
BASE = 4
TREES = 10
DEPTH = 4
PRECISION = 0.98
# Scores are compared by so many digits.
PLACES = 5
SEED = 11

# The base patterns, written so that no start is tried twice.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators beyond the base patterns.
SPELLED = re.compile(r"[A-Za-z0-9._+-]{1,64}\x20?[\[(]?\x20?(?:@|\bat\b)\x20?[\])]?\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]?\x20?(?:\.|\bdot\b)\x20?[\])]?\x20?[A-Za-z]{2,24}\b", re.ASCII)
NUMBERS = re.compile(r"(?<![0-9])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")

# Signs written out: in brackets, or as words if both are.
WRITTEN = re.compile(r"\x20?[\[(]\x20?(at|dot)\x20?[\])]\x20?")
WORDED = re.compile(r"\x20at\x20(?=[A-Za-z0-9-]+\x20?[\[(]?\x20?dot\b)|\x20dot\x20")
# A phone is described without its country code, as it reads at home.
COUNTRY = re.compile(r"^\+(?:[0-9]{1,3}[\x20.-]+)?")

CUES = ["mail", "phone", "tel", "call", "fax", "card", "visa", "pay", "ip", "host", "server", "order", "version", "token"]
FEATURES = ["kind", "length", "digits", "letters", "spaces", "dashes", "dots", "brackets", "at", "groups", "first_group",
            "longest_group", "before_word", "after_word", "upper", "cues"]

# Labels: a base span, a base shape that fails its check, neither, and what overlaps a base span.
GOOD, FAILED, OPEN, COVERED = 1, 0, -1, -2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each at sign back to the run's start, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        # a run that failed at this sign is not looked at again
        end = max(end, at + 1) if not m else end
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m.group())]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of everything that looks remotely alike."""
    found = {(s, e): 4 for s, e in emails(text)}
    if "@" in text or " at " in text or "(at)" in text or "[at]" in text:
        for m in SPELLED.finditer(text):
            found.setdefault(m.span(), 4)
    for m in IP.finditer(text):
        found.setdefault(m.span(), 5)
    for m in CARD.finditer(text):
        if 12 <= sum(c.isdigit() for c in m.group()) <= 24:
            found.setdefault(m.span(), 6)
    for m in PHONE.finditer(text):
        found.setdefault(m.span(), 7)
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() <= 40:
            found.setdefault(m.span(), 7)
    return [(s, k, e) for (s, e), k in found.items()]


def merged(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and disjoint."""
    starts, ends = [], []
    for start, end in sorted((s, e) for s, _, e in found):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def signed_out(span: str) -> str:
    """An address with its written-out signs put back."""
    span = WRITTEN.sub(lambda m: "@" if m.group(1) == "at" else ".", span)
    return WORDED.sub(lambda m: "@" if "at" in m.group() else ".", span)


def fails(span: str, kind: int) -> bool:
    """Whether a proposal that is no base span has a base shape that fails its check."""
    n = sum(c.isdigit() for c in span)
    if kind == 4:
        # an address has no blanks: prose like 'stays at home. The'
        return " " in signed_out(span)
    if kind == 6:
        return 14 <= n <= 19
    if kind == 7:
        return not 10 <= n <= 15 or PHONE.fullmatch(span) is not None
    return True


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one proposal, in the order of FEATURES."""
    span = signed_out(text[start:end]) if kind == 4 else COUNTRY.sub("", text[start:end])
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    ahead = text[max(0, start - 24) : start].lower()
    return [
        float(x)
        for x in (
            kind, len(span), len(digits), sum(c.isalpha() for c in span), span.count(" "), span.count("-"), span.count("."),
            span.count("(") + span.count(")"), span.count("@"), len(groups),
            len(groups[0]) if groups else 0, max(map(len, groups), default=0),
            start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum(),
            sum(c.isupper() for c in span), sum(c in ahead for c in CUES),
        )
    ]


_SPAN = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]


def _scan(batches):
    base_type = pa.list_(pa.struct(_SPAN))
    wide = pa.list_(pa.struct([*_SPAN, ("label", pa.int32()), ("x", pa.list_(pa.float64()))]))
    for batch in batches:
        bases, wides = [], []
        for text in batch.column(2).to_pylist():
            base = base_spans(text)
            exact = {(s, e) for s, _, e in base}
            starts, ends = merged(base)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            out = []
            for s, k, e in proposals(text):
                at = bisect_right(ends, s)
                clash = at < len(ends) and starts[at] < e
                label = GOOD if (s, e) in exact else COVERED if clash else FAILED if fails(text[s:e], k) else OPEN
                out.append({"start": s, "kind": k, "end": e, "label": label, "x": describe(text, s, k, e)})
            wides.append(out)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bases, base_type), pa.array(wides, wide)], ["rid", "doc_id", "base", "wide"])


def _settled(batches):
    """Of the selected spans of a row, the likeliest that overlap no other."""
    for batch in batches:
        out = []
        for row in batch.column(1).to_pylist():
            taken, starts, ends = [], [], []
            for s in sorted(row, key=lambda s: (-s["p"], s["start"], s["end"], s["kind"])):
                # taken spans are disjoint: the first that ends behind the start decides
                at = bisect_right(ends, s["start"])
                if at == len(ends) or starts[at] >= s["end"]:
                    starts.insert(at, s["start"])
                    ends.insert(at, s["end"])
                    taken.append(s)
            out.append([{k: s[k] for k in ("start", "kind", "end")} for s in taken])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct(_SPAN)))], ["rid", "added"])


def _selected(each: DataFrame) -> DataFrame | None:
    """``(rid, added)`` by trees trained on every labelled proposal of two thirds of
    the rows, with cuts from all those of the last third; None without two classes."""
    known = each.where("label >= 0")
    held = F.pmod(F.xxhash64("rid", F.lit(SEED + 1)), F.lit(3)) == 0
    learnt = known.where(~held)
    counts = {r["label"] for r in learnt.select("label").distinct().collect()}
    if counts != {0, 1}:
        return None
    assembler = VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="features")

    def vectors(rows: DataFrame) -> DataFrame:
        return assembler.transform(rows.select("*", *[F.get("x", F.lit(i)).alias(f"_{f}") for i, f in enumerate(FEATURES)]))

    # equal leaves add up to scores that differ in their last digits
    p = F.round(vector_to_array("probability")[1], PLACES).alias("p")
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="all")
    model = trees.fit(vectors(learnt).select("features", "label"))
    cut = F.lit(2.0)
    for kind, value in _cuts(model.transform(vectors(known.where(held))).select("kind", "label", p)).items():
        cut = F.when(F.col("kind") == kind, F.lit(value)).otherwise(cut)
    scored = model.transform(vectors(each.where(F.col("label").isin(FAILED, OPEN)))).select("rid", "start", "kind", "end", p).where(F.col("p") >= cut)
    rows = scored.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end", "p")).alias("picked"))
    return rows.mapInArrow(_settled, f"rid long, added {spans.SPANS}")


def _cuts(checked: DataFrame) -> dict[int, float]:
    """Per kind the lowest score from which on the wanted precision holds.

    Rows are reduced to counts of equal scores first, so the window spans at most
    as many of them as scores of ``PLACES`` digits, however many rows there are.
    """
    counts = checked.where("p >= 0.5").groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    down = Window.partitionBy("kind").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.select("kind", "p", (F.sum("good").over(down) / F.sum("n").over(down)).alias("precision")).where(F.col("precision") >= PRECISION)
    return {int(r["kind"]): r["cut"] for r in reached.groupBy("kind").agg(F.min("p").alias("cut")).collect()}


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Added spans have the kinds ``email_like`` to ``phone_like``. A null text is
    empty and has no spans; rows with a null id are returned too, and rows that
    repeat count each. Without proposals of both classes nothing is added. Other
    columns are ignored; an empty table gives an empty result.
    """
    session(docs)
    wide = "array<struct<start:int,kind:int,end:int,label:int,x:array<double>>>"
    rows = spans.numbered(docs)
    found = stage(rows.mapInArrow(_scan, f"rid long, doc_id long, base {spans.SPANS}, wide {wide}"), "scanned")
    each = found.select("rid", F.explode("wide").alias("s")).select("rid", "s.*")
    added = _selected(each)
    if added is None:
        added = found.limit(0).select("rid", F.array().cast(spans.SPANS).alias("added"))
    return spans.report(found.select("rid", "doc_id", "base"), added, KINDS, BASE)
