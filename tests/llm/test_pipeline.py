"""The pipeline's stages and its whole against plain counterparts on a small fixture."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from plumbline.llm.bpe import load_ranks
from plumbline.llm.queries import ORACLE_SQL, QUERIES


def fixture(spark, path):
    r = random.Random(8)
    en = "the of and to in that with river house mountain they were going through water under bridge".split()
    de = "der die und das mit haus berg nicht durch wasser unter brücke fluss gehen wir sind".split()
    rows = []
    for i in range(60):
        words = en if i % 2 else de
        lines = [" ".join(r.choices(words, k=12)) for _ in range(4)]
        rows.append((i, "\n".join([*lines, "Subscribe to our letter"] if i % 3 else lines), "en" if i % 2 else "de", f"s{i % 3}", 0))
    item = " ".join(r.choices(en, k=30))
    rows += [(100, rows[5][1], "en", "s1", 0), (101, rows[7][1] + " end", "en", "s1", 0), (102, f"before it {item} and after it", "en", "s2", 0), (103, None, "en", "s0", 0), (104, "12 34", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    d = str(tmp_path)
    fixture(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns
    lid, lines, near, clean, out = seen.values()
    assert set(lid) == set(range(60)) | {100, 101, 102}
    assert all((i == 101 or "Subscribe" not in r["text"]) and r["n_chars"] == len(r["text"]) for i, r in lines.items()) and set(lines) == set(lid)
    assert set(near) == set(lines) - {100, 101} and set(clean) == set(near) - {102}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: r["ids"] for i, r in out.items()} == {i: encoding.encode_ordinary(r["text"]) for i, r in clean.items()}
    assert {r["doc_id"]: r["ids"] for r in P.run(spark, d).collect()} == {i: r["ids"] for i, r in out.items()}


def test_registry():
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_line_dedup_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op5_line_dedup"])
    at = want.columns
    got = QUERIES["op5_line_dedup"](spark, sf_dir).select(*at).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
