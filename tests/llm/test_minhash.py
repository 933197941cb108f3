"""Near-duplicate components against all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import minhash as M
from plumbline.llm.graph import components
from plumbline.llm.shingles import shingle_hashes


def all_pairs(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in sets}


def shingled(text, k):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_texts():
    r = random.Random(2)
    out = []
    for g in range(6):
        base = [f"w{g}_{r.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3, 6, 9, 12])):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            out.append(" ".join(copy))
    return out + ["", None, "one", "one", "two words", "  "] + [" ".join(f"z{r.randrange(10**6)}" for _ in range(50)) for _ in range(30)]


@pytest.mark.parametrize(("words", "block"), [(2, None), (5, None), (2, 8)])
def test_components(spark, monkeypatch, words, block):
    if block:
        monkeypatch.setattr(M, "SIG_BLOCK", block)
        monkeypatch.setattr(M, "SET_BLOCK", block)
    rows = [(i * 3 + 1, t) for i, t in enumerate(near_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in M.near_duplicates(df, words=words).collect()}
    sets = {i: shingled(t, words) for i, t in rows}
    want = all_pairs(sets, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    kept = M.without_near_duplicates(df, words=words)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = r.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = pool[:600], pool[100:700]
        errors.append((M.signature(a) == M.signature(b)).mean() - 500 / 700)
    assert abs(np.mean(errors)) < 0.02


def test_shingles_are_ordered():
    w = np.array([1, 2, 3], np.uint64)
    assert len(shingle_hashes(w, 2)) == 2 and len(shingle_hashes(w, 5)) == 1 and len(shingle_hashes(w[:0], 2)) == 0
    assert shingle_hashes(w, 3)[0] != shingle_hashes(w[::-1], 3)[0]


def test_chains(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (300, 300)], "u long, v long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def test_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in M.near_duplicates(odd_docs, words=2).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
    assert got[2]["n_shingles"] == 0 and got[2]["kept"] and got[None]["component_id"] is None and got[5]["n_shingles"] == 1
    assert M.near_duplicates(no_docs).count() == 0
    assert M.without_near_duplicates(odd_docs).columns == odd_docs.columns


def test_rows_without_or_with_one_id(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (5, "one two three"), (5, "one two four"), (5, "one two three"), (6, "one two four"), (7, "x y"), (9, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(df, words=2).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [5, 5] and all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] == 5} == {(2, 5, True)}  # one document, whichever text counts
    kept = M.without_near_duplicates(df, words=2).collect()
    assert sorted(r["doc_id"] or 0 for r in kept)[:3] == [0, 0, 5] and sum(r["doc_id"] == 5 for r in kept) == 1 and sum(r["doc_id"] == 9 for r in kept) == 1


def test_long_words_that_a_polynomial_confuses(spark):
    x = ""
    for i in range(4096):
        x += "ab"[bin(i).count("1") % 2]
    y = x.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048, 4096):
        got = M.near_duplicates(spark.createDataFrame([(1, x[:n]), (2, y[:n])], "doc_id long, text string"), words=2).collect()
        assert all(r["kept"] for r in got)


def test_stars_of_a_long_path_and_a_hub(spark):
    n = 500
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {10_000 + i: 10_000 for i in range(300)} | {0: 0, 7: 0}
