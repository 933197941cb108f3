"""Phrase collocations by hashed counting of the next length (PCY, DHP) under Apriori pruning.

Pass k over the texts counts phrases of k words exactly, but only those that can be frequent: both parts of k - 1 words
hit the bitmap of frequent ones, and the phrase's own bucket, counted during the pass before, is heavy. While it does
so, the pass counts the buckets of the phrases of k + 1 words whose two parts passed. Bitmaps have `buckets` bits
(2^22: 512 KB) whatever the corpus, and are all that is broadcast; a bit may be set for want of buckets, so they only
spare work and the exact counts decide. Nothing is lost: a frequent phrase has frequent parts and a heavy bucket.

Counts are exact: within a batch words and phrases get numbers by dictionary, never by hash; a task sends each phrase
of a batch and each bucket once, and Spark sums them by key with partial sums before the shuffle. Scores are
decimals of 38 digits. The best rows of a language are ranked within slots of the phrase's hash before they meet, so
no task sees all candidates of a language.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count each time;
pieces end at a row's end; ties of a score go to the larger count, then to the phrase in byte order, ties of a cut to the
earliest; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, drop, mix, numbered_words, prepare, spread, text_buffer, written

#: What parts words, and what parts pieces besides.
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANG = "und"
BUCKETS = 1 << 22
#: Bytes of text that are numbered together.
GROUP_BYTES = 2 << 20
_SENT_ROWS = 1 << 17
#: Rows a bitmap of Spark's bitmap functions covers.
_BITMAP = 1 << 15
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
COUNTS = "lang string, phrase string, bucket long, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
#: Bucket of the rows that hold a language's number of words.
_TOTAL = -1


class _Words:
    """The words of some rows, numbered: which follow each other in a piece, and hashes of the phrases that start at each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: pa.Array):
        self.ids, self.vocab, starts, _ = numbered_words(data, offs, _KIND > 0, lower=True)
        self.n = len(starts)
        row = np.searchsorted(offs, starts, "right") - 1
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        breaks = np.cumsum(_KIND[data] == 2, dtype=np.int32)[starts] if self.n else np.zeros(0, np.int32)
        self.joined = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        chars, cuts = text_buffer(self.vocab)
        hashes = SpanHasher(chars)(cuts[:-1], cuts[1:])
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()]
        self._word = hashes[self.ids] if self.n else np.zeros(0, np.uint64)
        self._hash = mix(self._word + np.array(seeds, np.uint64)[self.lang]) if self.n else self._word
        self.size, self.whole = 1, np.ones(self.n, bool)

    def longer(self) -> None:
        """From phrases of `size` words to those of one more; `whole`: the phrase that starts here lies in one piece."""
        m = max(self.n - self.size, 0)
        self._hash = mix(self._hash[:m] * _CHAIN + self._word[self.size : self.size + m])
        self.whole = self.whole[:m] & self.joined[self.size - 1 : self.size - 1 + m]
        self.size += 1

    def buckets(self, at: np.ndarray, bits: int) -> np.ndarray:
        return (self._hash[at] >> np.uint64(64 - bits)).astype(np.int64)

    def counts(self, at: np.ndarray, bits: int) -> pa.RecordBatch:
        """Rows of COUNTS of the distinct phrases that start at some words."""
        code = self.lang[at]
        for j in range(self.size):  # dense numbers below len(at), so no product passes 63 bits
            _, first, code, n = np.unique(code * len(self.vocab) + self.ids[at + j], return_index=True, return_inverse=True, return_counts=True)
        at = at[first]
        phrase = pc.binary_join_element_wise(*[self.vocab.take(pa.array(self.ids[at + j])) for j in range(self.size)], " ")
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[at])), phrase, pa.array(self.buckets(at, bits)), pa.array(n)], schema=_COUNTS)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    held: list[pa.RecordBatch] = []

    def numbered() -> Iterator[_Words]:
        table = pa.Table.from_batches(held)
        data, offs = text_buffer(table.column("text"))
        langs = table.column("lang").combine_chunks()
        for lo, hi in chunks(offs, GROUP_BYTES):
            yield _Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], langs.slice(lo, hi - lo))

    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GROUP_BYTES:
            yield from numbered()
            held.clear()
    if held:
        yield from numbered()


def _set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 > 0


def _pass(docs: DataFrame, size: int, last: bool, bits: int, frequent: np.ndarray | None, heavy: np.ndarray | None) -> DataFrame:
    """Rows of COUNTS: possible phrases of `size` words, and by bucket alone those of one more whose parts are possible."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, heavy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, heavy = sent.value
        filled = None if last else np.zeros(1 << bits, np.int64)
        for words in _grouped(batches):
            may = words.whole
            for _ in range(size - 1):
                if words.size == size - 1:
                    part = np.zeros(words.n, bool)
                    at = np.flatnonzero(words.whole)
                    part[at] = _set(frequent, words.buckets(at, bits))
                words.longer()
            if size > 1:
                may = words.whole & part[: len(words.whole)] & part[1 : len(words.whole) + 1]
                at = np.flatnonzero(may)
                may = np.zeros(len(words.whole), bool)
                may[at] = _set(heavy, words.buckets(at, bits))
            at = np.flatnonzero(may)
            if len(at):
                yield words.counts(at, bits)
            if size == 1:
                n = np.bincount(words.lang, minlength=len(words.langs))
                none = pa.nulls(len(n), pa.string())
                yield pa.RecordBatch.from_arrays([words.langs, none, pa.array(np.full(len(n), _TOTAL)), pa.array(n)], schema=_COUNTS)
            if filled is not None:
                words.longer()
                m = len(words.whole)
                np.add.at(filled, words.buckets(np.flatnonzero(words.whole & may[:m] & may[1 : m + 1]), bits), 1)
        if filled is not None:
            used = np.flatnonzero(filled)
            for lo in range(0, len(used), _SENT_ROWS):
                b = used[lo : lo + _SENT_ROWS]
                none = pa.nulls(len(b), pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(b), pa.array(filled[b])], schema=_COUNTS)

    return docs.mapInArrow(count, COUNTS)


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The buckets of some rows as bits: at most 2^bits / 32,768 pieces of 4 KB reach the driver, whatever the rows."""
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    at = F.col("bucket") + 1
    for number, piece in rows.groupBy(F.bitmap_bucket_number(at).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("piece")).collect():
        lo = (number - 1) * (_BITMAP >> 3)
        out[lo : lo + len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, least: int = 100, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, size, n) of all phrases of 1 to `most` words with n >= least, and rows (lang, n) of all words; both written.

    buckets: a power of two.
    """
    if buckets & (buckets - 1) or buckets < 2:
        raise ValueError("buckets must be a power of two")
    if most < 1 or least < 1:
        raise ValueError("most and least must be positive")
    prepare(docs.sparkSession)
    bits = buckets.bit_length() - 1
    rows = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    frequent = heavy = totals = None
    found: list[DataFrame] = []
    levels: list[DataFrame] = []
    for size in range(1, most + 1):
        counted = _pass(rows, size, size == most, bits, frequent, heavy).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        level = written(counted.where((F.col("n") >= least) | (F.col("bucket") == _TOTAL)), f"phrases{size}")
        levels.append(level)
        if size == 1:
            totals = written(level.where(F.col("bucket") == _TOTAL).select("lang", "n"), "words")
        exact = level.where("phrase is not null")
        found.append(exact.select("lang", "phrase", F.lit(size).alias("size"), "n"))
        if size < most:
            frequent = _bitmap(exact, bits)
            heavy = _bitmap(level.where(f"phrase is null and bucket <> {_TOTAL}"), bits)
            if not heavy.any():  # no longer phrase can be frequent
                break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = written(out, "phrases")
    drop(*levels)
    return out, totals


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    big = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", big(a) * F.lit(1000).cast("decimal(38,0)") * big(n), big(left) * big(right))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, least: int = 100, percent: int = 100, top: int = 2000,
    buckets: int = BUCKETS, slots: int = 64,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `most` words.

    A phrase's score is that of its weakest cut, floor(1000 a n / (l r)). A phrase within a longer candidate that has
    at least `percent` hundredths of its occurrences goes.
    """
    counts, totals = frequent_phrases(docs, text_col, lang_col, most, least, buckets)
    words = F.split("phrase", " ")
    longer = counts.where("size >= 2").withColumn("w", words)
    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = longer.select("lang", "phrase", "size", "w", F.col("n").alias("a"), at)
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = counts.select("lang", "phrase", "n")
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = cuts.select("lang", "phrase", F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "a", "l", "r", "n").alias("cut"), F.lit(None).cast("long").alias("within"))
    inner = longer.where("size >= 3").select("lang", "w", "size", "n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "w", "m", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", _part(F.col("w"), F.col("s"), F.col("m")).alias("phrase"), F.lit(None).cast(scored.schema["cut"].dataType).alias("cut"), F.col("n").alias("within"))
    best = scored.unionByName(inner).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("within").alias("within")).where("cut is not null")
    best = best.where(F.coalesce(100 * F.col("within") < percent * F.col("cut.a"), F.lit(True))).select("lang", "phrase", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slot = F.pmod(F.xxhash64("phrase"), F.lit(slots)).alias("slot")
    first = best.select("*", slot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
