"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

`fit` learns from a bounded sample of labelled rows (`max_docs` a language, `max_rows` in all); `identify` scores every whole text
in its own partition, without a shuffle. The language with the lowest cross-entropy per character wins, and a
text whose cross-entropy is above the calibrated limit of the winner is marked `rejected`.

Text is lower-cased; every run of characters other than letters is one space. Letters that the sample has not
shown share one symbol. Defined cases: null texts and texts without a letter give `und`, score 0, rejected;
repeated rows give repeated results; ties go to the alphabetically first language; a sample without any
labelled row gives `und` for all; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_mod, drop, prepare, release_memory, spread, text_buffer, written

#: Bits of a symbol in an n-gram's code, and with more letters than they tell apart: four such symbols fill 64 bits.
BITS, WIDE_BITS = 8, 16
#: Symbol 0 is space; the last one, OTHER or that of the wide codes, any letter not in the sample.
OTHER = (1 << BITS) - 1
#: Bytes of text scored together.
SCORE_BYTES = 1 << 18
#: Below so many letters only texts without any letter are rejected: their cross-entropy says too little.
SURE_LETTERS = 40
#: The limit is this quantile of the cross-entropy of calibration texts of the language, times SLACK.
LIMIT_QUANTILE, SLACK = 0.995, 1.4


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # code point -> symbol
    order: int
    grams: list[np.ndarray]  # sorted codes seen by any language, by order
    logp: list[np.ndarray]  # their natural log probabilities, one column a language
    contexts: list[np.ndarray]  # sorted codes of contexts, by order
    loggamma: list[np.ndarray]  # log weight of the lower order after the context, one column a language
    floor: float  # log probability of a symbol that no language has seen
    limits: np.ndarray
    sharpness: float
    bits: int = BITS


def letters_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbol_runs(data: np.ndarray, offs: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lower-cased UTF-8 texts, their row offsets, and letters by row."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = lead[offs]
    sym = symbols[np.minimum(cps, 0x10FFFF)]
    blank = np.empty(len(sym), bool)
    if len(sym):
        blank[0] = True
        blank[1:] = sym[:-1] == 0
        blank[at[:-1][at[:-1] < len(sym)]] = True
    keep = (sym != 0) | ~blank
    kept = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(sym != 0, out=letters[1:])
    return sym[keep], kept[at], letters[at[1:]] - letters[at[:-1]]


def codes(sym: np.ndarray, offs: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """For each symbol the code of it and the order - 1 before it; before a text's start stand spaces."""
    out = sym.astype(np.uint64)
    for k in range(1, order):
        back = np.zeros(len(sym), np.uint64)
        back[k:] = sym[: len(sym) - k]
        for j in range(k):
            first = offs[:-1] + j
            back[first[first < offs[1:]]] = 0
        out |= back << np.uint64(bits * k)
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted array, and whether the key is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def estimate(samples: dict[str, tuple[np.ndarray, np.ndarray]], order: int, n_symbols: int, bits: int = BITS) -> tuple:
    """Kneser-Ney tables of all languages over the union of their n-grams. samples: symbols and offsets."""
    langs = sorted(samples)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        sym, offs = samples[lang]
        top, n = np.unique(codes(sym, offs, order, bits), return_counts=True)
        own = [(top, n.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left extensions
            top, n = np.unique(own[0][0] & np.uint64((1 << (bits * k)) - 1), return_counts=True)
            own.insert(0, (top, n.astype(np.float64)))
        counts.append(own)
    grams = [np.unique(np.concatenate([c[k][0] for c in counts])) for k in range(order)]
    contexts = [np.unique(g >> np.uint64(bits)) for g in grams]
    floor = -np.log(float(n_symbols))  # the space, the letters seen and the symbol of the others share the rest alike
    logp, loggamma = [], []
    for k in range(order):
        p = np.empty((len(grams[k]), len(langs)), np.float64)
        g = np.zeros((len(contexts[k]), len(langs)), np.float64)
        ctx = np.searchsorted(contexts[k], grams[k] >> np.uint64(bits))
        below = np.searchsorted(grams[k - 1], grams[k] & np.uint64((1 << (bits * k)) - 1)) if k else None
        for j, own in enumerate(counts):
            code, n = own[k]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
            c = np.zeros(len(grams[k]))
            c[np.searchsorted(grams[k], code)] = n
            total = np.bincount(ctx, c, len(contexts[k]))
            kinds = np.bincount(ctx, c > 0, len(contexts[k]))
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(logp[k - 1][below, j]) if k else np.exp(floor)
            p[:, j] = np.log(np.maximum(c - d, 0) / np.maximum(total, 1)[ctx] + gamma[ctx] * lower)
            g[:, j] = np.log(gamma)
        logp.append(p)
        loggamma.append(g)
    return langs, grams, [p.astype(np.float32) for p in logp], contexts, [g.astype(np.float32) for g in loggamma], floor


def log_probs(m: Model, code: np.ndarray) -> np.ndarray:
    """Natural log probability of each coded symbol after its context, one column a language."""
    at, hit = find(m.grams[-1], code)
    if not len(m.grams[-1]):
        return np.zeros((len(code), len(m.langs)), np.float32)
    out = m.logp[-1][at]
    rest = np.flatnonzero(~hit)
    if len(rest):
        left = code[rest]
        total = np.zeros((len(rest), len(m.langs)), np.float32)
        open_ = np.arange(len(rest))
        for k in range(m.order - 1, -1, -1):
            c = left[open_] & np.uint64((1 << (m.bits * (k + 1))) - 1)
            at, hit = find(m.grams[k], c)
            total[open_[hit]] += m.logp[k][at[hit]]
            open_, c = open_[~hit], c[~hit]
            at, hit = find(m.contexts[k], c >> np.uint64(m.bits))
            total[open_[hit]] += m.loggamma[k][at[hit]]
        total[open_] += np.float32(m.floor)
        out[rest] = total
    return out


def cross_entropies(m: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol of each text under each language, and letters by text."""
    sym, at, letters = symbol_runs(data, offs, m.symbols)
    lp = log_probs(m, codes(sym, at, m.order, m.bits))
    cs = np.zeros((len(sym) + 1, len(m.langs)))
    np.cumsum(lp, axis=0, out=cs[1:])
    n = np.maximum(at[1:] - at[:-1], 1)
    return -(cs[at[1:]] - cs[at[:-1]]) / n[:, None], letters


def _lower(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(col.cast(pa.large_string())))


def train(texts: list[str], labels: list[str], order: int = 4) -> Model:
    """A model from texts in memory: four of five estimate the tables, the fifth calibrates."""
    table = letters_table()
    data, offs = _lower(pa.array(texts, pa.large_string()))
    cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    seen, n = np.unique(cps[table[cps]], return_counts=True)
    bits = BITS if len(seen) < OTHER else WIDE_BITS
    other = (1 << bits) - 1
    seen = np.sort(seen[np.argsort(-n, kind="stable")][: other - 1])
    symbols = np.where(table, other, 0).astype(np.uint8 if bits == BITS else np.uint16)
    symbols[seen] = np.arange(1, len(seen) + 1)
    labels_ = np.array(labels, object)
    fold = np.zeros(len(texts), int)
    for lang in sorted(set(labels)):
        own = np.flatnonzero(labels_ == lang)
        fold[own] = np.arange(len(own)) % 5 if len(own) >= 5 else 0
    samples = {}
    for lang in sorted(set(labels)):
        own = _lower(pa.array([t for t, x, f in zip(texts, labels, fold, strict=True) if x == lang and f < 4], pa.large_string()))
        sym, at, _ = symbol_runs(*own, symbols)
        if len(sym):
            samples[lang] = (sym, at)
    m = Model([], symbols, order, [np.zeros(0, np.uint64)], [np.zeros((0, 0), np.float32)], [], [], 0.0, np.zeros(0), 1.0, bits)
    if not samples:
        return m
    m = Model(sorted(samples), symbols, order, *estimate(samples, order, len(seen) + 2, bits)[1:], np.full(len(samples), np.inf), 1.0, bits)
    held = [i for i in range(len(texts)) if fold[i] == 4 and labels[i] in samples] or [i for i in range(len(texts)) if labels[i] in samples]
    ce, letters = cross_entropies(m, *_lower(pa.array([texts[i] for i in held], pa.large_string())))
    own = np.array([m.langs.index(labels[i]) for i in held])
    for j in range(len(m.langs)):
        x = ce[(own == j) & (letters >= SURE_LETTERS), j]
        if len(x):
            m.limits[j] = np.quantile(x, LIMIT_QUANTILE) * SLACK
    grid = [2.0**k for k in range(-2, 9)]
    like = [np.mean(np.log(np.maximum(softmax(-ce * s)[np.arange(len(own)), own], 1e-9))) for s in grid]
    m.sharpness = grid[int(np.argmax(like))]
    return m


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_docs: int = 400, max_chars: int = 50_000, max_rows: int = 20_000, max_total: int = 64_000_000, order: int = 4, holdout: tuple[int, int] | None = (3, 1),
) -> Model:
    """Learn from at most max_docs texts a language and about max_rows in all, drawn by a hash of id and text; equal rows
    are drawn once, and every language has one at least. Of a longer text max_chars characters are learned, or fewer where all
    together would pass max_total, from a place drawn by that hash, so that a language of long texts is learned too.

    holdout (n, r): rows whose crc32(id as text) mod n is r are not learned from.
    """
    prepare(docs.sparkSession)
    digest = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 62))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull())
    if holdout:
        rows = rows.where(F.coalesce(crc_mod("i", holdout[0]), F.lit(0)) != holdout[1])
    sizes = written(rows.groupBy("l").agg(F.count("*").alias("count"), F.min(digest).alias("first")), "languages")
    n = max(sizes.count(), 1)
    share = min(float(max_docs), max_rows / n)
    if share <= 0:
        return train([], [], order)
    rate = sizes.select("l", "first", (F.lit(share) / F.col("count")).alias("rate"))
    rate = F.broadcast(rate) if n <= max_rows else rate
    chars = max(1, min(max_chars, int(max_total / (n * share))))
    beyond = F.length("t") - F.lit(chars)
    start = F.when(beyond > 0, F.pmod(F.xxhash64("i", F.lit("place")), beyond.cast("long") + 1)).otherwise(F.lit(0)) + 1
    piece = F.substring(F.col("t"), start.cast("int"), F.lit(chars))
    drawn = rows.withColumn("d", digest).join(rate, "l").where((F.col("d") / F.lit(float(1 << 62)) < F.col("rate")) | (F.col("d") == F.col("first")))
    drawn = drawn.select(piece.alias("t"), "l", "i", "d").dropDuplicates(["l", "d"])  # about max_docs rows a language are left
    place = F.row_number().over(Window.partitionBy("l").orderBy("d"))
    got = drawn.withColumn("n", place).where(F.col("n") <= max(1, min(max_docs, math.ceil(share)))).select("t", "l", "i").orderBy("l", "i", "t").toArrow()
    drop(sizes)
    return train(got.column("t").to_pylist(), got.column("l").to_pylist(), order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per row: id, the columns in keep, and lang_pred, score (0 to 1), cross_entropy (nats a symbol), rejected,
    whose names begin with prefix."""
    prepare(docs.sparkSession)
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = _lower(b.column(at))
            n = b.num_rows
            pred, score, best, out = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            for lo, hi in chunks(offs, SCORE_BYTES) if m.langs else ():
                ce, letters = cross_entropies(m, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                j = ce.argmin(axis=1)
                p = softmax(-ce * m.sharpness)
                row = np.arange(len(j))
                some = letters > 0
                pred[lo:hi][some] = np.array(m.langs, object)[j[some]]
                score[lo:hi][some] = p[row, j][some]
                best[lo:hi][some] = ce[row, j][some]
                out[lo:hi] = ~some | ((ce[row, j] > m.limits[j]) & (letters >= SURE_LETTERS))
            cols = [pa.array(pred, pa.string()), pa.array(score), pa.array(best, from_pandas=True), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *cols], names=names)
            release_memory()

    columns = list(dict.fromkeys([id_col, *keep]))
    kept, at = len(columns), columns.index(text_col) if text_col in columns else len(columns)
    df = spread(docs.select(*columns, *[text_col] * (at == kept)))  # the text travels once
    fields = df.schema.fields[:kept]
    schema = T.StructType(fields)
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())):
        schema = schema.add(prefix + name, kind)
    names = schema.names
    return df.mapInArrow(run, schema)
