"""Collocations against plain counting."""

import re
from collections import Counter

import pytest

from plumbline.llm.phrases import collocations, frequent_phrases

TEXTS = [
    ("en", "New York is big. new york, New\tYork! the the the the the\nnew york is"), ("en", "The city: new york is big; is big is big"), ("en", None),
    ("en", ""), (None, "new york new york"), (None, "\x0bnew york\x0cnew york. ü é ü é ü é"), ("fr", "la ville de paris, la ville de paris; la ville"), ("fr", " .,;:!? "),
    ("en", "x" * 5000 + " " + "new york " * 300), ("de", "Österreich ÖSTERREICH österreich"), ("en", "the the the the the"), ("en", "the the the the the"),
]


def plain(rows, most, least, percent, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    often = {k: v for k, v in counts.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in often.items():
        if any(lg == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), b in often.items()):
            continue
        score, _, le, r = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), le, r))
    return sorted((lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("most,least,percent,top,buckets", [(5, 2, 100, 2000, 1 << 22), (5, 2, 100, 3, 2), (3, 1, 60, 2000, 1 << 16), (2, 3, 100, 5, 1 << 15), (4, 10_000, 100, 5, 1 << 15)])
def test_plain(spark, most, least, percent, top, buckets):
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    got = sorted(map(tuple, collocations(df, most=most, least=least, percent=percent, top=top, buckets=buckets, slots=3).collect()))
    assert got == plain(TEXTS, most, least, percent, top)


def test_buckets_spare_counts_only(spark):
    """One bucket for all phrases, or many: the same rows."""
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    rows = [sorted(map(tuple, frequent_phrases(df, least=2, buckets=b)[0].collect())) for b in (2, 1 << 12, 1 << 20)]
    assert rows[0] == rows[1] == rows[2] and len({r[2] for r in rows[0]}) == 5
    with pytest.raises(ValueError):
        frequent_phrases(df, buckets=1000)


def test_large_products(spark):
    """Counts whose products pass 64 bits are divided exactly."""
    from pyspark.sql import functions as F

    from plumbline.llm.phrases import _score

    a, n, left, right = 7 * 10**11 + 3, 9 * 10**15 + 7, 10**12 + 39, 3 * 10**12 + 1
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(_score(*[F.col(c) for c in "anlr"])).first()[0] == 1000 * a * n // (left * right)


def test_odd_rows(odd_docs, no_docs):
    found = {(r["lang"], r["phrase"]): r["a"] for r in collocations(odd_docs, least=2).collect()}
    assert found["en", "word word"] == 29_999 and ("en", "again and") not in found  # the latter only occurs within longer phrases
    assert collocations(odd_docs, least=30_000).count() == 0
    assert collocations(no_docs).count() == 0
    assert collocations(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
