"""Secret scan with corpus-wide ownership frequency.

Three patterns give the base spans. A wider generator proposes every long
token that mixes letters and digits. Each candidate, base or not, is hashed,
and the hashes are aggregated over the corpus by distinct repositories and
owners: what many owners or many repositories carry is a copied example, what
one owner alone carries, in few repositories, is taken for a live credential, and
what lies between is shared. Live tokens are added to the spans; base spans stay
whatever their frequency. Both counts are returned.

An owner is a ``source``; a repository is a source with a language.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm import spans
from rolloom.llm.common import session, stage

KINDS = ["assign", "access", "hex", "token"]
BASE = 3
# Owners, or repositories, from which on a value is an example copied around.
COPIED = 3
# Bits for each character that a proposed token must have at least.
ENTROPY = 3.0

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

CANDIDATES = "array<struct<start:int,kind:int,end:int,h:long>>"


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the three patterns."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return out


def proposed_tokens(text: str, taken: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Long mixed tokens that touch no base span."""
    covered = sorted((s[0], s[2]) for s in taken)
    out, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if any(s < end and e > start for s, e in covered[at : at + 8]):
            continue
        value = m.group()
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and entropy(value) >= ENTROPY:
            out.append((start, 3, end, value))
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h", pa.int64())]))
    for batch in batches:
        found = []
        for text in batch.column(4).to_pylist():
            base = base_spans(text)
            every = base + proposed_tokens(text, base)
            found.append([{"start": s, "kind": k, "end": e, "h": _hash(v)} for s, k, e, v in every])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, kind)], ["rid", "doc_id", "owner", "repository", "found"])


def secrets(docs: DataFrame, copied: int = COPIED) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, the
    numbers of its candidates by verdict, ``n_live, n_shared, n_copied``, and the
    most ``owners`` and ``repositories`` that any of them has (0 without any).

    A value is copied from ``copied`` owners or ``copied`` repositories on, live
    if it is not and has one owner, else shared.

    A null text is empty and has no spans; rows with a null id are returned
    too, and rows that repeat count each. A null source or language is a name of
    its own. Values are compared without regard to case. Other columns are
    ignored; an empty table gives an empty result.
    """
    session(docs)
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner")
    named = docs.withColumns({"_llm_owner": owner, "_llm_repo": F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit("")))})
    rows = spans.numbered(named, "_llm_owner", "_llm_repo")
    found = stage(rows.mapInArrow(_scan, f"rid long, doc_id long, owner string, repository string, found {CANDIDATES}"), "scanned")
    each = found.select("rid", "owner", "repository", F.explode("found").alias("s"))
    pairs = each.select("s.h", "owner", "repository").distinct()
    spread = pairs.groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories"))
    judged = each.select("rid", "s.*").join(spread, "h")
    many = (F.col("owners") >= copied) | (F.col("repositories") >= copied)
    live = ~many & (F.col("owners") == 1)
    added = judged.groupBy("rid").agg(
        F.collect_list(F.when(live & (F.col("kind") >= BASE), F.struct("start", "kind", "end"))).alias("added"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(~many & ~live, 1)).alias("n_shared"),
        F.count(F.when(many, 1)).alias("n_copied"),
        F.max("owners").alias("owners"),
        F.max("repositories").alias("repositories"),
    )
    own = F.filter("found", lambda s: s["kind"] < BASE)
    base = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_shared", "n_copied", "owners", "repositories")]
    return spans.report(found.select("rid", "doc_id", base.alias("base")), added, KINDS, BASE, *more)
