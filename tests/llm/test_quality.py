"""Counts of texts against plain counting, estimation against a plain one and against known accuracies."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm.quality import RULES, Model, estimate, judge_quality, posterior, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile("[A-Za-zÀ-\U0010ffff]")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines),
        sum(WORD.findall(x)[-1][-1] in ".!?\"')" for x in lines), len(LETTER.findall(t)), len(re.findall("[A-Z]", t)), sum(bool(LETTER.search(x)) for x in w),
        max(Counter(w).values(), default=0),
    )


TEXTS = [
    "a b c d e f g h a b c d e f g h", "a b c d e f g h i j a b c d e f g h", "one\ntwo\n\n one\none\n \t\none \n", "x " * 100, "\n\nend.\nEnd!\x0b\nno end\n", "# * $ % & | < > ü Ü \U0001F600 12 3",
    "", None, "\n", "word", "a\nb\na\nb\n" * 5, "q r s t u v w x\nq r s t u v w x", "ÄÖÜ äöü ñ ñ", "1 2 3 4 5 6 7 8 9 " * 3, "\x0cq\x0d", "Und " * 9000,
]


def test_counts(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    for rows in (df.coalesce(1), df.repartition(5)):  # texts together in a batch, and apart
        got = {r["id"]: tuple(r["_counts"]) for r in text_counts(rows).collect()}
        assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r["_counts"]) for r in text_counts(docs, keep=("doc_id",)).collect()} == want


def plain_em(patterns, m, steps):
    prior, a, b = 0.8, [0.9] * m, [0.5] * m
    for _ in range(steps):
        good, total = {}, sum(patterns.values())
        for v, n in patterns.items():
            p, q = prior, 1 - prior
            for i, x in enumerate(v):
                if x:
                    p *= a[i] if x > 0 else 1 - a[i]
                    q *= 1 - b[i] if x > 0 else b[i]
            good[v] = n * p / (p + q)
        prior = (sum(good.values()) + 8) / (total + 10)
        bad = {v: n - good[v] for v, n in patterns.items()}
        share = lambda of, i, s, x, y: (x + sum(z for v, z in of.items() if v[i] == s)) / (y + sum(z for v, z in of.items() if v[i]))
        a = [min(max(share(good, i, 1, 8, 10), 0.6), 0.999) for i in range(m)]
        b = [min(max(share(bad, i, -1, 2, 4), 1 - a[i]), 0.999) for i in range(m)]
    return prior, a, b


def test_estimate():
    rng = random.Random(1)
    right, patterns, truth = [0.95, 0.9, 0.85, 0.75, 0.65], Counter(), []
    for _ in range(20_000):
        good = rng.random() < 0.7
        v = tuple(0 if rng.random() < 0.3 else (1 if good == (rng.random() < r) else -1) for r in right)
        patterns[v] += 1
        truth.append((v, good))
    model = estimate(list(patterns.items()), 5)
    prior, a, b = plain_em(patterns, 5, 60)
    assert np.allclose([model.prior, *model.on_good, *model.on_bad], [prior, *a, *b], rtol=1e-9)
    assert abs(model.prior - 0.7) < 0.03 and np.allclose(model.on_good, right, atol=0.04) and np.allclose(model.on_bad, right, atol=0.06)
    up, down = [math.log(x / (1 - y)) for x, y in zip(a, b)], [math.log((1 - x) / y) for x, y in zip(a, b)]
    odds = lambda v: math.log(prior / (1 - prior)) + sum(up[i] if x > 0 else down[i] if x < 0 else 0 for i, x in enumerate(v))
    assert sum((odds(v) > 0) == good for v, good in truth) > 0.9 * len(truth)
    assert estimate([], 3) == Model(0.8, (0.8,) * 3, (0.5,) * 3)


def test_posterior_column(spark):
    from pyspark.sql import functions as F

    model = Model(0.7, (0.9, 0.8), (0.7, 0.6))
    df = spark.createDataFrame([(1, -1), (0, 0), (-1, -1)], "x int, y int")
    got = [r[0] for r in df.select(posterior([F.col("x"), F.col("y")], model)).collect()]
    assert np.allclose(got, [0.7 * 0.9 * 0.2 / (0.7 * 0.9 * 0.2 + 0.3 * 0.3 * 0.6), 0.7, 0.7 * 0.1 * 0.2 / (0.7 * 0.1 * 0.2 + 0.3 * 0.7 * 0.6)])


def test_against_labels(spark, sf_dir):
    """Good documents stay and bad ones go, though no label was seen."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = judge_quality(docs, keep=("doc_id",)).join(labels, "doc_id").select("quality", "_base_failed", "_kept").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["_base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["_kept"] for r in good) >= 0.98 * len(good) and sum(r["_kept"] for r in bad) <= 0.1 * len(bad)
    assert not any(r["_kept"] for r in rows if r["_base_failed"])


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumn("_kept", odd_docs["doc_id"]).withColumn("_COUNTS", odd_docs["lang"])
    out = judge_quality(named)
    assert out.columns == [*named.columns, "_counts_", "_votes", "_posterior", "_base_failed", "_kept_"]
    rows = out.collect()
    assert len(rows) == 9 and all(len(r["_votes"]) == len(RULES) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["_base_failed"] and by_id[5]["_counts_"]["n_repeat_words"] == 30_000 and not by_id[5]["_kept_"]
    assert by_id[2]["_counts_"] == by_id[3]["_counts_"] and by_id[2]["_counts_"]["n_words"] == 0
    assert judge_quality(no_docs).collect() == []
    with pytest.raises(ValueError):
        judge_quality(no_docs, rules={})
