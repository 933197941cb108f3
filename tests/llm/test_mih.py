"""Nearest neighbours: recall, the radius guarantee, ties and odd vectors."""

import numpy as np
import pytest

from plumbline.llm import mih as M


def brute(ids, x, q, k):
    return [(int(ids[j]), s) for j, s in sorted(((j, float((x[j] * x[q]).sum())) for j in range(len(ids)) if ids[j] != ids[q]), key=lambda t: (-t[1], ids[t[0]]))[:k]]


def test_probe_finds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 64))
    m = M.learn(x)
    block = M.Block(m, np.arange(3000), x)
    for q in range(0, 3000, 300):
        code = m.codes(x[q : q + 1])[0]
        want = np.flatnonzero(np.unpackbits(block.codes ^ code, axis=1).sum(axis=1) <= m.radius)
        assert np.array_equal(block.probe(code), want)


@pytest.mark.parametrize("block", [None, 100])
def test_recall(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(M, "ROW_BLOCK", block)
        monkeypatch.setattr(M, "QUERY_BLOCK", 7)
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((6, 48))[r.integers(0, 6, 500)] + r.standard_normal((500, 48)) * 0.5, np.tile(r.standard_normal(48), (40, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = M.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for g in rows:
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert set(got) == set(range(0, 540, 20)) and all(len(v) == 20 for v in got.values())
    found = total = 0
    for q, have in got.items():
        want = brute(np.arange(540), x, q, 20)
        found += len({i for i, _ in want} & {i for i, _ in have})
        total += 20
        assert have == sorted(have, key=lambda t: (-t[1], t[0]))
    assert found / total >= 0.9
    assert [i for i, _ in got[500]] == [i for i in range(501, 521)]  # equal vectors: the smallest ids


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in M.search(df, lambda i: i == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 0.0)]
    assert M.search(df.where("vec_id = 2"), lambda i: i == 0).count() == 0


def test_layout_copies_small_tables_only():
    assert M.layout(1000, 50, 64) == (1, 1)
    assert M.layout(10**6, 50_000, 64) == (31, 9)
    for n in (10**6, 10**7, 10**8, 10**10):
        for dim in (1, 64, 1024, 1 << 24):
            blocks, parts = M.layout(n, n // 20, dim)
            rows = -(-n // blocks)
            assert rows == 1 or rows * dim <= M.BLOCK_VALUES
            assert parts <= -(-M.TASKS // blocks)
    assert M.layout(10**8, 5 * 10**6, 64)[1] == 1


@pytest.mark.parametrize("rows, block, part", [(700, 90, 3), (700, 10_000, 2), (3, 1, 1)])
def test_whatever_the_layout_answers_are_exact_within_a_full_radius(spark, monkeypatch, rows, block, part):
    monkeypatch.setattr(M, "ROW_BLOCK", block)
    monkeypatch.setattr(M, "QUERY_BLOCK", part)
    full = M.learn
    monkeypatch.setattr(M, "learn", lambda *a: M.Model(full(*a).rotation, M.BITS))
    x = np.random.default_rng(11).integers(-3, 4, (rows, 16)).astype(float)
    x[:, 0] = 1.0  # none is zero
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in M.search(df, lambda i: i % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: brute(np.arange(rows), x, q, 5) for q in range(0, rows, 20)}
