"""Bounds of what fits gather, items that share an id, vectors of any size."""

import random

import numpy as np
import pytest

from plumbline.llm import langid, mih, toxicity
from plumbline.llm.decontam import matches


def test_toxicity_learns_from_at_most_max_rows(spark, monkeypatch):
    """One labelled id with most of the rows."""
    rows = [(7, f"nice text number {i}", "en") for i in range(5000)] + [(i, f"bad awful word {i}", "en") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 0)] + [(i, 1) for i in range(100, 160)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda t, y, lang: seen.append((t, y)))
    toxicity.fit(docs, labels, max_rows=200, holdout=None)
    texts, y = seen[0]
    assert sum(x == 0 for x in y) == 200 and sum(x == 1 for x in y) == 60 and len(set(texts)) == 260


def test_language_id_draws_rows(spark, monkeypatch):
    """3,000 English rows share an id, a language has one text many times, another has very long texts."""
    rows = [(1, f"the text {i}", "en") for i in range(3000)] + [(2, "le texte", "fr")] * 900 + [(i, "der text " * 5000, "de") for i in range(50)] + [(5, None, "es"), (6, "nada", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda t, lang, order: seen.append((t, lang)))
    langid.fit(docs, max_docs=40, max_total=120_000, holdout=None)
    texts, langs = seen[0]
    count = {x: langs.count(x) for x in set(langs)}
    assert 20 <= count["en"] <= 40 and count["fr"] == 1 and 20 <= count["de"] <= 40
    assert max(map(len, texts)) == 1000 and sum(map(len, texts)) <= 120_000
    assert len({t for t, x in zip(texts, langs, strict=True) if x == "en"}) == count["en"]


@pytest.mark.parametrize("most", [1, 2, 20_000])
def test_items_that_share_an_id(spark, most):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (12, 12, 20, 20, 35, 50)]
    bench = spark.createDataFrame([(9, t) for t in texts] + [(9, texts[0]), (None, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(1, " and ".join(texts)), (2, texts[3])], "doc_id long, text string")
    got = {r["doc_id"]: [(m["item_id"], m["start_word"], m["n_words"]) for m in r["_matches"]] for r in matches(docs, bench, max_items=most).collect()}
    assert got[2] == [(9, 0, 20)]
    assert got[1] == [(9, 0, 12), (9, 0, 12), (9, 13, 12), (9, 26, 20), (9, 47, 20), (9, 68, 35), (9, 104, 50)]


@pytest.mark.parametrize("size", [1e-200, 5e-324, 1e200, 1e308])
def test_vectors_of_any_size(spark, size):
    r = np.random.default_rng(2)
    x = r.standard_normal((120, 16))
    x[::3] *= size
    x = np.clip(x, -1.7e308, 1.7e308)
    keep = [i for i in range(120) if (x[i] != 0).any()]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    got = {}
    for g in mih.search(df, lambda i: i % 20 == 0, k=200).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert set(got) == {i for i in keep if i % 20 == 0}
    with np.errstate(all="ignore"):
        for q, rows in got.items():
            want = [(i, float((x[i] * x[q]).sum())) for i in keep if i != q]
            want.sort(key=lambda t: (np.inf if np.isnan(t[1]) else -t[1], t[0]))
            assert [i for i, _ in rows] == [i for i, _ in want]
            assert all(a == b or np.isnan(a) and np.isnan(b) for (_, a), (_, b) in zip(rows, want, strict=True))
