"""Secret scans: pattern spans in every whole text, then ownership of every candidate value over the corpus.

Base spans come from three patterns. Further candidates are long mixed runs of high entropy. Every candidate value
(by hash, never in clear) is counted over the whole corpus by distinct repositories and distinct owners: a value
of one owner is owner-specific and looks live however many of its repositories hold it, one of few owners does
unless many repositories hold it, one that many owners hold is a widely copied example. Further candidates
that look live are added as spans of kind `live`; base spans always stay and are only marked.

Plan: one pass over the texts writes the few spans; counting and marking work on those rows alone, with partial
distinct counts, so a value copied everywhere costs one row per owner and repository before the last sum.

Defined cases: null and empty texts have no spans; repeated rows have equal spans and count as one repository,
as do exact copies of a text that one owner holds under several ids;
a null owner is an owner of its own; offsets are code points; equal starts are ordered by kind as listed.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, spread, text_buffer, written

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # a run is taken whole, so shorter runs fail and longer ones match
_MIXED = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a further candidate needs at least.
MIN_ENTROPY = 3.5
SPAN = "array<struct<kind:int,start:long,end:long,value:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _live_looking(run: bytes) -> bool:
    kinds = (re.search(rb"[a-z]", run) is not None) + (re.search(rb"[A-Z]", run) is not None) + (re.search(rb"[0-9]", run) is not None)
    if kinds < 3:
        return False
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values()) >= MIN_ENTROPY


def spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, secret value) of one UTF-8 text in bytes, in order."""
    out = [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in out)
    reach = list(itertools.accumulate((e for _, e in taken), max))
    for m in _MIXED.finditer(text):
        before = bisect.bisect_left(taken, (m.end(), 0))  # base spans that begin before its end
        if _live_looking(m[0]) and not (before and reach[before - 1] > m.start()):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _hash(value: bytes) -> str:
    return hashlib.blake2b(value, digest_size=16).hexdigest()


def scan(docs: DataFrame, id_col: str, owner_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, owner, copy, spans): all candidates of each text, offsets in code points, values hashed, and
    a hash of the text where it has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN.value_type]
        for b in batches:
            data, offs = text_buffer(b.column(2))
            view, rows, copies = memoryview(np.ascontiguousarray(data)), [], []
            for i in range(b.num_rows):
                text = bytes(view[offs[i] : offs[i + 1]])
                found = spans(text)
                copies.append(_hash(text) if found else None)
                if found and not text.isascii():
                    lead = np.zeros(len(text) + 1, np.int64)
                    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=lead[1:])
                    found = [(k, int(lead[s]), int(lead[e]), v) for k, s, e, v in found]
                rows.append([dict(zip(names, (k, s, e, _hash(v)), strict=True)) for k, s, e, v in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(copies, pa.string()), pa.array(rows, _SPAN)], names=["id", "owner", "copy", "spans"])

    df = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(text_col).cast("string").alias("t")))
    return df.mapInArrow(run, f"id long, owner string, copy string, spans {SPAN}").withColumn("row", F.monotonically_increasing_id())


def ownership(scanned: DataFrame) -> DataFrame:
    """Rows (value, repositories, owners) of every candidate value in the corpus."""
    held = scanned.select("id", "owner", "copy", F.explode("spans").alias("s")).select("id", "owner", "copy", F.col("s.value").alias("value"))
    by_id = held.groupBy("value", "owner", "id").agg(F.min("copy").alias("copy"))
    by_copy = by_id.groupBy("value", "owner", "copy").agg(F.lit(1).alias("one"))
    by_owner = by_copy.groupBy("value", "owner").agg(F.count("one").alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", max_owners: int = 2, max_repositories: int = 50
) -> DataFrame:
    """Per row: id and marked: its spans (kind, start, end, repositories, owners, live), candidates of kind live
    only where they look live: with one owner, or with at most max_owners and max_repositories. A repository is a
    document (exact copies of one owner are one), its owner is owner_col."""
    prepare(docs.sparkSession)
    scanned = written(scan(docs, id_col, owner_col, text_col), "spans")
    counts = written(ownership(scanned), "owners")  # a table, so that Spark splits the rows of a widely copied value in the join
    cand = scanned.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    live = (F.col("owners") <= F.least(F.lit(max_owners), F.lit(1))) | ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    marked = cand.join(counts, "value").withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    marked = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "repositories", "owners", "live"))).alias("marked"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,repositories:bigint,owners:bigint,live:boolean>>")
    return scanned.join(marked, "row", "left").select(F.col("id").alias(id_col), F.coalesce("marked", none).alias("marked"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base kinds, a digest of the base spans, all spans as text, and how many look live."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("marked", lambda s: s["kind"] < 3)
    of_kind = lambda k: F.size(F.filter("marked", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    n = [of_kind(k) for k in range(3)]
    lives = F.size(F.filter("marked", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select(id_col, *n, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("marked")).alias("spans"), lives)
