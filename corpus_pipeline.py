"""A corpus pipeline over `documents`: five stages, each calling one operator of plumbline.llm.

Each stage is a function of (spark, docs, sf_dir); what one returns is written as Parquet and is the next one's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, langid, linededup, minhash
from plumbline.llm.common import drop, fresh_prefix, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others carry the language identified."""
    found = langid.identify(docs, langid.fit(docs), keep=tuple(docs.columns), prefix=(prefix := fresh_prefix(docs))).where(~F.col(f"{prefix}rejected"))
    return found.select(*[F.col(f"{prefix}lang_pred").alias("lang") if c == "lang" else c for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, and documents that consist of nothing else but white space."""
    cleaned = linededup.drop_lines(docs, "source", "text", ratio=0.1, min_pages=5)
    cleaned = cleaned.where((F.col(cleaned.columns[-1]) == 0) | F.col("text").rlike(r"\S"))
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.matches(docs, benchmark)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the text decoded from them."""
    small = {"keep_codec": False, "cache_words": 50_000, "group_chars": 300_000}  # the workers of all stages share their memory
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, **small)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the language models or the tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            drop(before)
    return docs
