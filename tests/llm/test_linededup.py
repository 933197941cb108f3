"""Site-relative line dedup against a plain count."""

from collections import defaultdict

import pytest

from plumbline.llm.linededup import BUCKET, buckets, drop_lines


def plain(rows, ratio, least):
    pages, held = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        if text is not None:
            pages[host].add(text)
            for line in text.split("\n"):
                if line.strip(" \t\r\f\x0b"):
                    held[host, line.strip(" \t\r\f\x0b")].add(text)
    bad = {k for k, v in held.items() if len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r\f\x0b")) not in bad) for i, t, h in rows}


@pytest.mark.parametrize("few", [200_000, 0])
def test_against_plain_count(spark, few):
    rows = [(i, f"Menu\nown line {i}\n\n  Menu \nfoot {i % 3}\n", f"h{i % 2}" if i % 7 else None) for i in range(40)]
    rows += [(100, "", "h0"), (101, None, "h0"), (102, "Menu", "other"), (103, "Menu\nown line 3\n\n  Menu \nfoot 0\n", "h1")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumnsRenamed({})
    got = {r["doc_id"]: r for r in drop_lines(df, ratio=0.4, min_pages=3, broadcast_lines=few).collect()}
    want = plain(rows, 0.4, 3)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[102]["_n_dropped"] == 0 and got[101]["_n_lines"] == 0 and got[1]["_n_dropped"] == 2


def test_odd_rows(odd_docs, no_docs):
    assert drop_lines(odd_docs, min_pages=1, ratio=0.0).count() == 9
    assert drop_lines(no_docs).count() == 0
    assert drop_lines(odd_docs).columns[:6] == odd_docs.columns


def test_buckets_hold_each_key_once(spark):
    rows = [("a", k * 7919 - 40_000) for k in range(900)] + [("b", -1), ("c", 5), ("c", -9_223_372_036_854_775_808)]
    got = {r["h"]: r["d"] for r in buckets(spark.createDataFrame(rows, "host string, key long"), "h", "d").collect()}
    assert {h: sorted(k for b in d for k in b) for h, d in got.items()} == {h: sorted(k for g, k in rows if g == h) for h in "abc"}
    assert all(k % len(d) == i for d in got.values() for i, b in enumerate(d) for k in b)
    assert len(got["a"]) == -(-900 // BUCKET) and max(map(len, got["a"])) < 100


@pytest.mark.parametrize("few", [200_000, 0])
def test_long_lists_of_a_host(spark, few):
    menu = [f"entry {j} of the menu" for j in range(400)]
    rows = [(i, "\n".join([*menu[i % 3 :], f"own line {i}", "", *menu[:5]]), "h") for i in range(12)] + [(50, "entry 7 of the menu", "other")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["text"] for r in drop_lines(df, ratio=0.5, min_pages=5, broadcast_lines=few).collect()}
    assert got == plain(rows, 0.5, 5)
