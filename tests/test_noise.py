"""Generated passages of odd texts: the parser, and its queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows_of

from plumbline.functions import extract as E
from plumbline.plans.queries import ORACLE_SQL, QUERIES

TEXTS = ["plain", "", "x", None, " \n\t", "two  ends ", "  a: b", " ", "y", "z ", "tab\x0bbed", "w", "a "]  # prompts 0 to 4; the last has one document


@pytest.fixture
def odd_dir(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def check(spark, odd_dir, name, kinds):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{odd_dir}/{t}.parquet/*.parquet'")
    df, want = QUERIES[name](spark, odd_dir), con.sql(ORACLE_SQL[name])
    got = df.collect()
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())
    assert len(got) == 10 * kinds
    assert {(r["prompt"], r["content"]) for r in got} >= {(0, "Passage 2:"), (1, "Passage 1:"), (1, "Passage 2:"), (2, " a: b"), (2, "Passage 2:"), (3, "z"), (3, "tab bed"), (4, "a"), (4, "Passage 2:")}


def test_empty_passages(spark, odd_dir):
    check(spark, odd_dir, "parse_noise_passages", 1)


def test_line_without_text(spark):
    got = spark.range(1).select(E.generated_passages(F.lit("Passage 1: \nTopic 1: t\nPassage 2\nTopic 2:\nPassage 3: p"), "irrelevant").alias("p")).first()["p"]
    assert [(r["content"], r["partner"]) for r in got] == [("Passage 1:", "t"), ("Passage 2", "Topic 2:")]


def test_empty_passages_of_all_kinds(spark, odd_dir):
    check(spark, odd_dir, "parse_noise_kinds", 3)
