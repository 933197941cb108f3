"""Decontamination against every window of every item."""

import random
from collections import Counter

from plumbline.llm.decontam import matches


def shingles(words, k=5):
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def plain(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, t in items:
            iw = (t or "").lower().split()
            k = min(5, len(iw))
            if not iw or len(w) < k:
                continue
            want, s = Counter(shingles(iw, k)), shingles(w, k)
            size = min(len(iw), len(w)) - k + 1
            sims = [(sum((c & want).values()) / sum((c | want).values()), -p) for p in range(len(s) - size + 1) for c in [Counter(s[p : p + size])]]
            best = max(sims)
            if best[0] >= 0.8:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def test_against_all_windows(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 8, 8, 20, 30, 30, 41, 60])] + [(50, None), (51, ""), (52, "same same same same same same same")]
    docs = []
    for d in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 150))]
        i, text = r.choice(items[:9])
        leak = text.split()
        if d % 3 and len(leak) > 10:
            leak[r.randrange(len(leak))] = "changed"
        if d % 4 == 3:
            leak = leak[: int(len(leak) * 0.9)]
        at = r.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + leak + words[at:])))
    docs += [(100, None), (101, ""), (102, "Same SAME same same same same same"), (103, items[5][1]), (104, items[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert len(want) > 30
    for most in (20_000, 3):
        rows = matches(frame, bench, max_items=most).collect()
        got = {(r["doc_id"], m["item_id"]): (round(m["similarity"], 9), m["start_word"]) for r in rows for m in r["_matches"]}
        assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (None, "x"), (2, None)], "item_id long, text string")
    rows = matches(odd_docs, bench).collect()
    assert len(rows) == 9 and sum(len(r["_matches"]) for r in rows) == 2
    assert matches(no_docs, bench).count() == 0
    assert sum(len(r["_matches"]) for r in matches(odd_docs, bench.where("1 = 0")).collect()) == 0
