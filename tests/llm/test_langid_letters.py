"""Languages of a large script that differ in their rarer letters only."""

import random

import pyarrow as pa

from plumbline.llm import langid as L


def test_every_letter_of_the_sample_counts():
    r = random.Random(3)
    common, rare = [chr(0x4E00 + i) for i in range(260)], {"aa": [chr(0x6000 + i) for i in range(60)], "bb": [chr(0x7000 + i) for i in range(60)]}
    text = lambda lang: "".join(r.choice(common) if r.random() < 0.9 else r.choice(rare[lang]) for _ in range(400))
    labels = ["aa", "bb"] * 60
    m = L.train([text(x) for x in labels], labels)
    held = ["aa", "bb"] * 20
    ce, _ = L.cross_entropies(m, *L._lower(pa.array([text(x) for x in held], pa.large_string())))
    assert [m.langs[j] for j in ce.argmin(axis=1)] == held
    assert len(set(m.symbols[[ord(c) for x in rare.values() for c in x]])) == 120
