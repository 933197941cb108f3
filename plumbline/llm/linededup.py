"""Line dedup by site-relative frequency.

A line is boilerplate of its host when the share of the host's pages that hold it exceeds `ratio` and at least
`min_pages` pages hold it. A page is a distinct whole
text: of copies one counts, else the copies of one page would make all its lines boilerplate.
Lines are compared by a 64-bit hash after trimming blanks; blank lines are neither counted nor dropped.

Plan: lines are exploded as hashes only, never as text; counts are partial sums; of each host at most
(lines a page / ratio) lines can exceed the ratio, so a host's list is no longer than some of its pages and the table
to drop is small beside the input. It is
written, its size checked, and broadcast only under `broadcast_lines`; beyond that a salted join takes over.
A host's list travels as buckets by the hash's remainder, so a line looks at one bucket of about `BUCKET` hashes,
however many lines its host drops.

Defined cases: null text stays null and has no lines; a null host is a host of its own; repeated rows are
cleaned alike; empty tables give empty results; extra columns pass through, whatever their names: a count column
whose name docs has already gets underscores behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, written

_BLANKS = " \t\r\f\x0b"
#: Hashes in a bucket of a host's list, on average.
BUCKET = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) == ""


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """Rows (host, key, pages, total): the lines to drop."""
    pages = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("t")
    )
    total = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: ~_blank(x)), _key))
    held = pages.select("host", "page", F.explode(keys).alias("key")).groupBy("host", "key", "page").agg(F.lit(1).alias("one"))
    held = held.groupBy("host", "key").agg(F.count("one").alias("pages")).where(F.col("pages") >= min_pages)
    return held.join(total, "host").where(F.col("pages") > F.lit(float(ratio)) * F.col("total"))


def buckets(found: DataFrame, host: str, drop: str) -> DataFrame:
    """Rows (host, drop) of found: the keys of a host, in the bucket of their remainder by the number of buckets."""
    size = found.groupBy("host").agg(F.ceil(F.count("key") / BUCKET).cast("int").alias("size"))
    empty = size.select("host", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"), F.lit(None).cast("long").alias("key"))
    full = found.join(size, "host").select("host", F.pmod("key", F.col("size")).cast("int").alias("at"), "key")
    filled = empty.unionByName(full).groupBy("host", "at").agg(F.collect_set("key").alias("keys"))
    rows = filled.groupBy(F.col("host").alias(host)).agg(F.sort_array(F.collect_list(F.struct("at", "keys"))).alias("all"))
    return rows.select(host, F.col("all")["keys"].alias(drop))


def _within(drop: Column, key: Column) -> Column:
    held = lambda k: F.array_contains(F.get(drop, F.pmod(k, F.size(drop)).cast("int")), k)
    return F.exists(F.array(key), held)  # the line is hashed once


def drop_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5,
    broadcast_lines: int = 200_000, salts: int = 64,
) -> DataFrame:
    """docs with text_col cleaned, and behind them the columns _n_lines and _n_dropped."""
    prepare(docs.sparkSession)
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages), "lines")
    host, drop, salt, kept = (fresh(docs, c) for c in ("_host", "_drop", "_salt", "_kept"))
    by_host = buckets(found, host, drop)
    rows = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    if found.count() <= broadcast_lines:
        rows = rows.join(F.broadcast(by_host), host, "left")
    else:
        salted = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn(salt, (F.monotonically_increasing_id() % salts).cast("int")).join(salted, [host, salt], "left")
    lines = _lines(F.col(text_col))
    left = F.filter(lines, lambda x: _blank(x) | ~_within(F.col(drop), _key(x)))
    rows = rows.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(left))
    none = F.lit(0).cast("long")
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n")).alias(text_col)
    counts = {"_n_lines": F.coalesce(F.size(lines).cast("long"), none), "_n_dropped": F.coalesce((F.size(lines) - F.size(kept)).cast("long"), none)}
    return rows.select(*[text if c == text_col else F.col(c) for c in docs.columns], *[v.alias(fresh(docs, c)) for c, v in counts.items()])
