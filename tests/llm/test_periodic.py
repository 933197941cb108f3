"""Runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.periodic import find_runs, lag_matches, runs_of
from plumbline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1 if len(w) >= 8 else 2):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_pieces(pieces):
    ids = [x for unit, times in pieces for x in unit * times]
    assert runs_of(np.array(ids, np.int64)) == plain_runs(ids)


def test_long_periods():
    """Periods over the step of the first scan, nested repetition, many frequent words."""
    rng = random.Random(5)
    unit = [rng.randrange(9) for _ in range(37)]
    for ids in (
        [1, 2, 3] + unit * 5 + [7], (unit * 4 + [1] * 9) * 5, [0] * 3000, [0, 1] * 1500, (([0, 1] * 5 + [2]) * 6 + [3]) * 5,
        [rng.randrange(2) for _ in range(2500)], [rng.randrange(400) for _ in range(50)] * 12 + [5], unit[:36] * 4 + unit[:35],
    ):
        assert runs_of(np.array(ids, np.int64)) == plain_runs(ids)


def test_lag_matches():
    """Frequent words (by FFT) and rare ones (by differences) together."""
    rng = np.random.default_rng(3)
    for n, words in ((7, 2), (900, 3), (4000, 60), (1000, 900)):
        ids = rng.zipf(1.3, n) % words
        want = [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 4 + 1)]
        assert lag_matches(ids, n // 4).tolist() == want


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        assert got[doc_id] == plain(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = QUERIES["op11_periodic_runs"](spark, f"{tmp_path}/{name}").collect()
        want = [plain(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    named = odd_docs.withColumn("_runs", odd_docs["doc_id"]).withColumn("N_Words", odd_docs["lang"])
    out = find_runs(named)
    assert out.columns == [*named.columns, "_n_words", "_runs_", "_collapsed"]
    assert {r["doc_id"]: r["_n_words"] for r in out.collect()}[5] == 30_000
