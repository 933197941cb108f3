"""Exact normalisation of the models, held-out accuracy and odd inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np

from plumbline.llm import langid as L
from plumbline.llm.queries import op4_language_id


def model():
    return L.train(["the cat sat on the mat and then left"] * 6 + ["der hund und die katze sind im haus"] * 6, ["en"] * 6 + ["de"] * 6)


def test_probabilities_sum_to_one():
    m = model()
    n = len(set(m.symbols[m.symbols > 0].tolist()) - {L.OTHER})
    symbols = np.array([0, *range(1, n + 1), L.OTHER], np.uint64)
    for context in (0, 0x010203, 0x050000, 0xFFFFFF):
        p = np.exp(L.log_probs(m, (np.uint64(context) << np.uint64(8)) | symbols).astype(float)).sum(axis=0)
        assert np.all(np.abs(p - 1) < 1e-5), p


def test_batches_do_not_matter():
    import pyarrow as pa

    m, texts = model(), ["the house", "", "die katze ist da", "12", "Straße"]
    whole, _ = L.cross_entropies(m, *L._lower(pa.array(texts)))
    for i, t in enumerate(texts):
        one, _ = L.cross_entropies(m, *L._lower(pa.array([t])))
        assert np.allclose(one[0], whole[i], atol=1e-6)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.05
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd_docs, no_docs):
    m = L.fit(odd_docs)
    got = L.identify(odd_docs, m, keep=tuple(odd_docs.columns), prefix="_lid_").collect()
    assert len(got) == 9
    for r in got:
        if r["doc_id"] in (2, 3, 4):
            assert (r["_lid_lang_pred"], r["_lid_score"], r["_lid_rejected"]) == ("und", 0.0, True)
    assert L.identify(no_docs, m).count() == 0
    nothing = L.fit(no_docs)
    assert {r["lang_pred"] for r in L.identify(odd_docs, nothing).collect()} == {"und"}


def direct_kneser_ney(texts, order, n_symbols):
    """P(symbol after context) by the textbook recursion; texts are lists of symbols."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = [0] * (order - 1) + t
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / n_symbols
        ones, twos = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
        after = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return (max(counts[k][gram] - d, 0) + d * len(after) * p(gram[1:])) / sum(after)

    return p


def test_tables_against_the_recursion():
    r, order, n = random.Random(5), 3, 6
    texts = {lang: [[r.choice(own) for _ in range(r.randint(0, 30))] for _ in range(6)] for lang, own in (("aa", [0, 1, 2, 3]), ("bb", [0, 2, 3, 4, 4, 4]))}
    samples = {lang: (np.array(sum(ts, []), np.uint8), np.cumsum([0, *map(len, ts)])) for lang, ts in texts.items()}
    langs, grams, logp, contexts, loggamma, floor = L.estimate(samples, order, n)
    m = L.Model(langs, np.zeros(0), order, grams, logp, contexts, loggamma, floor, np.zeros(2), 1.0)
    every = list(itertools.product(range(n), repeat=order))
    got = L.log_probs(m, np.array([sum(x << (L.BITS * (order - 1 - i)) for i, x in enumerate(g)) for g in every], np.uint64))
    for j, lang in enumerate(langs):
        p = direct_kneser_ney(texts[lang], order, n)
        assert np.allclose(got[:, j], [math.log(p(g)) for g in every], atol=1e-4)


def test_languages_of_long_texts_are_learned(spark):
    rows = [(i, "the cat sat on the mat and then left the house " * 4, "en") for i in range(40)]
    rows += [(100 + i, "der hund und die katze sind im haus und schlafen " * 30, "de") for i in range(40)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_chars=300)
    assert m.langs == ["de", "en"]
    few = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_chars=300, max_rows=0)
    assert few.langs == []
