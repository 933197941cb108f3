"""Katz backoff against a direct computation; exact normalisation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import katz as K


def spectrum(c):
    f = Counter(min(v, 7) for v in c.values())
    return [len(c)] + [f[r] for r in range(1, 7)]


class Plain:
    def __init__(self, texts):
        self.u, self.b = Counter(), Counter()
        for t in texts:
            self.u.update(t)
            self.b.update(zip([0, *t], t, strict=False))
        self.n, self.v, self.texts = sum(self.u.values()), len(self.u), len(texts)
        d1, d2 = (K.discounts(spectrum(c), least) for c, least in ((self.u, 1), (self.b, 2)))
        cut = lambda c, d: c * (d[c] if c <= 5 else 1)
        mass = sum(cut(c, d1) for c in self.u.values())
        z = max(self.n, mass + 0.5)
        self.unknown = 1 - mass / z
        self.p1 = lambda w: cut(self.u[w], d1) / z if w in self.u else self.unknown
        seen, below = defaultdict(float), defaultdict(float)
        for (h, w), c in self.b.items():
            if c >= 2:
                seen[h] += cut(c, d2)
                below[h] += self.p1(w)
        count = lambda h: self.texts if h == 0 else self.u[h]
        self.total = {h: max(count(h), seen[h] + 0.5) for h in seen}
        self.alpha = {h: (1 - seen[h] / self.total[h]) / (1 - below[h]) for h in seen}
        self.p = lambda h, w: cut(self.b[h, w], d2) / self.total[h] if self.b.get((h, w), 0) >= 2 else self.alpha.get(h, 1) * self.p1(w)


def texts():
    r = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(200)], k=r.randrange(0, 60)))) for i in range(300)]
    return [*rows, (1000, None), (1001, ""), (1002, " The THE the\tthe"), (1003, "never seen words here"), (None, "w0 w1 w2")]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_direct_computation(spark, parts):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    low = {i: [*(t or "").lower().split(), 1] for i, t in rows}
    plain = Plain([low[i] for i in low if i is None or zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r["doc_id"]: r for r in K.score_texts(df).collect()}
    assert set(got) == set(low)
    for i, t in low.items():
        r = got[i]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(w in plain.u for w in t) and r["train_tokens"] == plain.n
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.u[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(plain.p(h, w)) for h, w in zip([0, *t], t, strict=False)))
    for h in [0, "w0", "w1", "w150", "nowhere"]:
        assert sum(plain.p(h, w) for w in plain.u) + plain.p(h, "unknown") == pytest.approx(1)


def test_odd_rows(odd_docs, no_docs):
    rows = K.score_texts(odd_docs).collect()
    assert len(rows) == 9 and all(r["score"] < 0 for r in rows)
    assert K.score_texts(no_docs).count() == 0


def test_empty_training_set(spark):
    df = spark.createDataFrame([(4, "a b")], "doc_id long, text string")
    held = zlib.crc32(b"4") % 5
    r = K.score_texts(df, holdout=(5, held)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)


def test_packed_columns():
    import numpy as np

    a, b = np.array([1, 70_000, 3]), np.array([1 << 63], np.uint64)
    x, y, z = K.unpack(K.pack(a, b, np.array([0.5])))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and z.tolist() == [0.5]
