"""The registered Katz query keeps bigrams seen once: against a direct computation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import katz as K
from plumbline.llm.queries import op8_katz


def spectrum(c):
    f = Counter(min(v, 7) for v in c.values())
    return [len(c)] + [f[r] for r in range(1, 7)]


def test_bigrams_seen_once_count(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(200)], k=r.randrange(0, 60)))) for i in range(200)]
    spark.createDataFrame([*rows, (1000, None), (1001, "never seen words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    low = {i: [*t.lower().split(), 1] for i, t in [*rows, (1000, ""), (1001, "never seen words")]}
    train = [t for i, t in low.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    u, b = Counter(), Counter()
    for t in train:
        u.update(t)
        b.update(zip([0, *t], t, strict=False))
    assert sum(c == 1 for c in b.values()) > len(b) / 4
    d1, d2 = K.discounts(spectrum(u), 1), K.discounts(spectrum(b), 1)
    assert 0 < d2[1] < 1
    cut = lambda c, d: c * (d[c] if c <= 5 else 1)
    mass = sum(cut(c, d1) for c in u.values())
    z = max(sum(u.values()), mass + 0.5)
    p1 = lambda w: cut(u[w], d1) / z if w in u else 1 - mass / z
    seen, below = defaultdict(float), defaultdict(float)
    for (h, w), c in b.items():
        seen[h] += cut(c, d2)
        below[h] += p1(w)
    total = {h: max(u[h] if h else len(train), seen[h] + 0.5) for h in seen}
    p = lambda h, w: cut(b[h, w], d2) / total[h] if (h, w) in b else (1 - seen[h] / total[h]) / (1 - below[h]) * p1(w) if h in seen else p1(w)
    for h in [0, "w0", "w150", "nowhere"]:
        assert sum(p(h, w) for w in u) + p(h, "unknown") == pytest.approx(1)
    got = {x["doc_id"]: x["score"] for x in op8_katz(spark, str(tmp_path)).collect()}
    assert set(got) == set(low)
    for i, t in low.items():
        assert got[i] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([0, *t], t, strict=False)))
