"""The classifier: gradients, whole texts, held-out quality and odd inputs."""

import numpy as np
import pyarrow as pa

from plumbline.llm import toxicity as X
from plumbline.llm.queries import op3_toxicity


def data():
    r = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choice(words, 40)) for _ in range(200)]
    labels = [i % 4 == 0 for i in range(200)]
    texts = [t + " nastyform" + "abcdef"[i % 6] if y else t for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    return texts, [int(y) for y in labels]


def test_learns_a_stem():
    texts, labels = data()
    m = X.train(texts, labels, ["en"] * 200)
    s = X.scores(m, pa.array(["word1 word2 nastyformz word3", "word1 word2 word3", "word5"]))
    assert s[0] >= 0.7 > s[1] and s[2] < 0.7


def test_whole_texts_in_any_batch(monkeypatch):
    texts, labels = data()
    m = X.train(texts, labels, ["en"] * 200, epochs=3)
    long = "word1 " * 5000 + "nastyforma " + "word2 " * 5000
    odd = [long, "", None, "a", *texts[:5]]
    whole = X.scores(m, pa.array(odd))
    one = [X.scores(m, pa.array([t], pa.string()))[0] for t in odd]
    monkeypatch.setattr(X, "BLOCK", 50)
    small = X.scores(m, pa.array(odd))
    assert np.allclose(whole, one, atol=1e-5) and np.allclose(whole, small, atol=1e-5)
    assert whole[1] == whole[2]


def test_one_class():
    assert X.scores(X.train([], [], []), pa.array(["a"]))[0] == 0.0
    assert X.scores(X.train(["a"] * 12, [1] * 12, ["en"] * 12), pa.array(["b", None])).tolist() == [1.0, 1.0]


def test_query(spark, sf_dir):
    rows = op3_toxicity(spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    m = X.fit(odd_docs, labels)
    assert X.score(odd_docs, m, lang_col="lang").count() == 9 and X.score(no_docs, m).count() == 0


def tiny():
    import numpy as np

    from plumbline.llm import toxicity as T

    r = np.random.default_rng(1)
    m = T.Model(r.standard_normal((T.BUCKETS, T.DIM)), [r.standard_normal((w, T.DIM, T.FILTERS)) for w in T.WIDTHS], [r.standard_normal(T.FILTERS) for _ in T.WIDTHS], r.standard_normal(T.FILTERS * len(T.WIDTHS)), 0.2)
    for x in (m.embed, *m.conv, *m.bias, m.out):
        x *= 0.3  # far from where the sigmoid is flat
    m.embed[0] = 0
    ids = r.integers(1, 40, (30, 1 + len(T.STEMS))).astype(np.int32)
    return T, m, ids, np.array([[0, 12], [12, 13], [13, 30]]), np.array([1.0, 0.0, 1.0])


def test_forward_by_brute_force():
    import numpy as np

    T, m, ids, spans, _ = tiny()
    got = T.pooled(m, ids, np.array([0, 12, 13, 30]))
    for row, (a, z) in zip(got, spans, strict=True):
        vec = [m.embed[list(x)].sum(axis=0) for x in ids[a:z]] + [np.zeros(T.DIM)] * 3
        want = []
        for w, bias, width in zip(m.conv, m.bias, T.WIDTHS, strict=True):
            sums = [sum(vec[i + j] @ w[j] for j in range(width)) for i in range(max(z - a - width + 1, 1))]
            want += list(np.maximum(np.max(sums, axis=0) + bias, 0))
        assert np.allclose(row, want, atol=1e-4)


def test_gradients_by_differences():
    import numpy as np

    T, m, ids, spans, y = tiny()

    def loss():
        p = T.sigmoid(T._logits(m, ids, np.array([0, 12, 13, 30])).astype(np.float64))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    params = [m.embed, *m.conv, *m.bias, m.out]
    grads = T._gradients(m, ids, spans, y)
    r, eps = np.random.default_rng(2), 1e-3
    for p, (rows, g) in zip(params, grads[:-1], strict=True):
        whole = np.zeros(p.shape)
        whole[rows] = g
        places = [int(r.integers(p.size)) for _ in range(6)] if p is not m.embed else [int(r.choice(rows[rows > 0])) * T.DIM + k for k in range(6)]
        for k in places:
            at = np.unravel_index(k, p.shape)
            old = p[at]
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - whole[at]) < 2e-3


def test_cuts_of_all_rows(spark):
    """The distributed cut is that of the whole table, by language and over all."""
    r = np.random.default_rng(5)
    z, y, lang = np.round(r.standard_normal(3000) * 3, 6), r.random(3000) < 0.2, r.choice(["en", "de"], 3000)
    z += y * 2
    rows = spark.createDataFrame([(str(a), float(b), int(c)) for a, b, c in zip(lang, z, y, strict=True)], "lang string, z double, y int")
    got = {x["lang"]: x for x in X.best_cuts(rows.unionByName(rows.withColumn("lang", X.F.lit(None).cast("string")))).collect()}
    for k, use in (("en", lang == "en"), ("de", lang == "de"), (None, lang != "")):
        assert np.isclose(got[k]["cut"], X._best_cut(z[use], y[use].astype(float))) and (got[k]["n"], got[k]["hits"]) == (use.sum(), y[use].sum())


def test_thresholds_see_rows_beyond_the_sample(spark):
    """All held-back rows calibrate, also those over max_rows and max_chars."""
    texts, labels = data()
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    seen = []
    whole = X.best_cuts
    X.best_cuts = lambda rows: seen.append(rows.count()) or whole(rows)
    try:
        X.fit(docs, marks, max_rows=20, holdout=None)
    finally:
        X.best_cuts = whole
    held = docs.where(X.F.pmod(X.F.xxhash64("doc_id", X.F.lit("held")), X.F.lit(5)) == 4).count()
    assert seen == [held, held] and held > 20
