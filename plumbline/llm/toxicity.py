"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (of letters and digits, A-Z lower-cased) are hashed into BUCKETS rows of an embedding table; a word's vector
is the sum of its own row and those of its first 4, 5 and 6 bytes, so that inflected forms share what is learned of
their stem. Filters of widths 1, 2 and 3 slide over the whole text, the maximum of each filter over all positions feeds one logistic output.
Filters run in bounded blocks of positions with a running maximum, so a text of any length is scored whole.

`fit` trains the network on a bounded sample of labelled rows; `score` runs in the documents' own partitions without a
shuffle. Inputs of a score are the words alone. The language column is used only to calibrate one decision
threshold per language; scores themselves are made so that 0.7 is a good threshold. Scale and thresholds come from
every labelled row that is held back (a fifth of the ids, whole texts), counted on the executors (`calibrate`).

Defined cases: null and empty texts score as a text without any word; unlabelled rows are scored only; without
both classes in the sample every score is the label's rate over all labelled rows (0 if there is none); repeated rows have
equal scores; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SpanHasher, chunks, crc_mod, drop, mix, prepare, spread, text_buffer, written

BUCKETS, DIM, FILTERS, WIDTHS, STEMS = 1 << 16, 8, 8, (1, 2, 3), (4, 5, 6)
#: Texts of a training step.
STEP = 16
#: Share of clean training texts that are cut to a short piece, so that short texts are not taken for toxic ones.
CLIP = 0.3
#: Positions that filters see at a time.
BLOCK = 1 << 16
#: The score of a calibrated probability at the best threshold is moved to this value.
DECISION = 0.7
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (from 1; 0 is padding) of the words and their stems, a column each, and row offsets of the words."""
    if not len(data):
        return np.zeros((0, 1 + len(STEMS)), np.int32), np.zeros(len(offs), np.int64)
    w = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(w & (np.concatenate(([True], ~w[:-1])) | edge[:-1]))
    ends = np.flatnonzero(w & (np.concatenate((~w[1:], [True])) | edge[1:])) + 1
    hashed = SpanHasher(LOWER[data])
    ids = np.zeros((len(starts), 1 + len(STEMS)), np.int32)
    ids[:, 0] = hashed(starts, ends) % np.uint64(BUCKETS - 1) + np.uint64(1)
    for j, n in enumerate(STEMS, 1):
        long = np.flatnonzero(ends - starts >= n)
        ids[long, j] = mix(hashed(starts[long], starts[long] + n)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return ids, np.searchsorted(starts, offs)


@dataclass
class Model:
    embed: np.ndarray
    conv: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        e = self.embed[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            e += self.embed[ids[:, j]]
        return e

    def filters(self) -> np.ndarray:
        """All filters side by side: (DIM, sum of widths * FILTERS)."""
        return np.concatenate([w[j] for w in self.conv for j in range(len(w))], axis=1)


def pooled(m: Model, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Maxima of all filters of each text; a text shorter than a filter is padded."""
    n = at[1:] - at[:-1]
    pad = max(WIDTHS)
    flat = np.zeros((len(ids) + pad * len(n), ids.shape[1]), np.int32)
    first = at[:-1] + pad * np.arange(len(n))
    flat[np.arange(len(ids)) + np.repeat(pad * np.arange(len(n)), n)] = ids
    weights = m.filters()
    best = [np.full((len(n), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    for lo, hi, (i, j) in _blocks(first, n + pad):
        act = m.vectors(flat[lo:hi]) @ weights
        column = 0
        for k, width in enumerate(WIDTHS):
            spans = np.maximum(n[i:j] - width + 1, 1)
            total = act[: hi - lo - width + 1, column : column + FILTERS].copy()
            for q in range(1, width):
                total += act[q : hi - lo - width + 1 + q, column + q * FILTERS : column + (q + 1) * FILTERS]
            column += width * FILTERS
            start = np.maximum(first[i:j], lo) - lo
            stop = np.minimum(first[i:j] + spans - lo, len(total))
            live = start < stop
            if not live.any():
                continue
            cut = np.stack([start[live], stop[live]], axis=1).ravel()
            got = np.maximum.reduceat(total, cut[:-1] if cut[-1] >= len(total) else cut, axis=0)[::2]
            rows = np.arange(i, j)[live]
            best[k][rows] = np.maximum(best[k][rows], got)
    return np.concatenate([np.maximum(b + bias, 0) for b, bias in zip(best, m.bias, strict=True)], axis=1)


def _blocks(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Position ranges of bounded size with the texts in each; ranges of one long text overlap by the widest filter."""
    i = 0
    while i < len(first):
        end = first + size
        j = max(i + 1, int(np.searchsorted(end, first[i] + BLOCK, "right")))
        lo, stop = int(first[i]), int(end[j - 1])
        while True:
            hi = min(stop, lo + BLOCK)
            yield lo, hi, (i, j)
            if hi == stop:
                break
            lo = hi - max(WIDTHS) + 1
        i = j


def _logits(m: Model, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return pooled(m, ids, at) @ m.out + m.out_bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logits(m: Model, col: pa.Array) -> np.ndarray:
    data, offs = text_buffer(col)
    out = [np.zeros(0)]
    for lo, hi in chunks(offs):
        out.append(_logits(m, *word_ids(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])))
    return np.concatenate(out)


def scores(m: Model, col: pa.Array) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(col), m.constant)
    return sigmoid(logits(m, col) * m.scale[0] + m.scale[1])


def train(texts: list[str], labels: list[int], langs: list[str] | None, epochs: int = 12, seed: int = 7) -> Model:
    """Adam over the convolutional classifier, of embeddings only over those in a step; every fifth text is held back for
    calibration. Without langs all texts are learned from and nothing is calibrated."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    m = Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0,
    )
    if len(y) < 10 or y.min() == y.max():
        m.constant = float(y.mean()) if len(y) else 0.0
        return m
    m.embed[0] = 0
    data, offs = text_buffer(pa.array(texts, pa.large_string()))
    ids, at = word_ids(data, offs)
    held = (np.arange(len(y)) % 5 == 4) & (langs is not None)
    rows = np.flatnonzero(~held)
    params = [m.embed, *m.conv, *m.bias, m.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), STEP):
            step += 1
            few = rows[lo : lo + STEP]
            spans = np.stack([at[few], at[few + 1]], axis=1)
            for k in np.flatnonzero((y[few] == 0) & (rng.random(len(few)) < CLIP)):  # a piece of a clean text is clean
                a, z = spans[k]
                n = min(z - a, int(rng.integers(1, 40)))
                spans[k] = (a0 := int(rng.integers(a, z - n + 1))), a0 + n
            grads = _gradients(m, ids, spans, y[few])
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            m.out_bias -= rate * grads.pop()
            for p, (at_rows, g), (a, b) in zip(params, grads, moments, strict=True):
                a[at_rows] = 0.9 * a[at_rows] + 0.1 * g
                b[at_rows] = 0.99 * b[at_rows] + 0.01 * g * g
                p[at_rows] -= rate * (a[at_rows] / (1 - 0.9**step)) / (np.sqrt(b[at_rows] / (1 - 0.99**step)) + 1e-6)
            m.embed[0] = 0
    if langs is None:
        return m
    z = _logits(m, ids, at)
    _calibrate(m, z, y, np.asarray(langs, object), held)
    return m


def _gradients(m: Model, ids: np.ndarray, spans: np.ndarray, y: np.ndarray) -> list:
    """Of each parameter but the last the rows that have a gradient, and it; of the output's bias the gradient."""
    pad = max(WIDTHS)
    rows, steps = [np.zeros(0, np.int32)], [np.zeros((0, m.embed.shape[1]), np.float32)]
    g_conv, g_bias, g_out, g_b = [np.zeros_like(w) for w in m.conv], [np.zeros_like(b) for b in m.bias], np.zeros_like(m.out), 0.0
    for (a, z), label in zip(spans, y, strict=True):
        own = np.concatenate([ids[a:z], np.zeros((pad, ids.shape[1]), np.int32)])
        e = m.vectors(own)
        peaks, feats = [], []
        for w, bias, width in zip(m.conv, m.bias, WIDTHS, strict=True):
            n = max(len(own) - pad - width + 1, 1)
            act = sum(e[j : j + n] @ w[j] for j in range(width))
            top = act.argmax(axis=0)
            peaks.append(top)
            feats.append(np.maximum(act[top, np.arange(FILTERS)] + bias, 0))
        f = np.concatenate(feats)
        d = float(sigmoid(f @ m.out + m.out_bias) - label) / len(y)
        g_out += d * f
        g_b += d
        back = d * m.out * (f > 0)
        for k, (w, width) in enumerate(zip(m.conv, WIDTHS, strict=True)):
            b = back[k * FILTERS : (k + 1) * FILTERS]
            g_bias[k] += b
            for j in range(width):
                at_j = peaks[k] + j
                g_conv[k][j] += e[at_j].T * b
                rows.append(own[at_j].ravel())
                steps.append(np.repeat((w[j] * b).T, own.shape[1], axis=0))
    seen, inv = np.unique(np.concatenate(rows), return_inverse=True)
    g_embed = np.zeros((len(seen), m.embed.shape[1]), np.float32)
    np.add.at(g_embed, inv, np.concatenate(steps))
    return [(seen, g_embed), *[(slice(None), g) for g in (*g_conv, *g_bias, g_out)], g_b]


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates best by F1, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def _calibrate(m: Model, z: np.ndarray, y: np.ndarray, langs: np.ndarray, held: np.ndarray) -> None:
    """A scale that puts the best cut of the held-back rows at DECISION, and a threshold for each language."""
    use = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    cut = _best_cut(z[use], y[use])
    spread = max(float(np.std(z[use])), 1e-3)
    m.scale = (2 / spread, float(np.log(DECISION / (1 - DECISION)) - 2 / spread * cut))
    for lang in sorted({x for x in langs if x is not None}):
        own = use & (langs == lang)
        if 5 <= y[own].sum() < own.sum():
            m.thresholds[lang] = float(sigmoid(np.array(_best_cut(z[own], y[own]) * m.scale[0] + m.scale[1])))


def best_cuts(rows: DataFrame) -> DataFrame:
    """Of each lang (also null) the cut of `_best_cut`: rows (lang, z, y) -> (lang, n, hits, cut).

    Sums of ranges of z (a 64th wide) are added up first, then equal z within a range: no task sees all rows of a language.
    """
    same = rows.groupBy("lang", F.floor(F.col("z") * 64).alias("at"), "z").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    down = Window.partitionBy("lang").orderBy(F.desc("at"))
    ranges = same.groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    ranges = ranges.select(
        F.col("lang").alias("l"), F.col("at").alias("a"), (F.sum("n").over(down) - F.col("n")).alias("n0"), (F.sum("hits").over(down) - F.col("hits")).alias("h0"),
        F.sum("hits").over(Window.partitionBy("lang")).alias("all"),
    )
    within = Window.partitionBy("lang", "at").orderBy(F.desc("z"))
    both = same.join(ranges, same["lang"].eqNullSafe(ranges["l"]) & (same["at"] == ranges["a"]))
    f1 = 2 * (F.col("h0") + F.sum("hits").over(within)) / (F.col("n0") + F.sum("n").over(within) + F.col("all"))
    best = both.select("lang", "z", "n", "hits", f1.alias("f1")).groupBy("lang").agg(
        F.max(F.struct("f1", "z"))["z"].alias("top"), F.sum("n").alias("n"), F.sum("hits").alias("hits")
    ).select(F.col("lang").alias("l"), "top", F.col("n").alias("_n"), F.col("hits").alias("_hits"))
    beside = same.join(F.broadcast(best), same["lang"].eqNullSafe(best["l"]))  # a row a language
    below = F.max(F.when(F.col("z") < F.col("top"), F.col("z")))
    return beside.groupBy("lang", "top", "_n", "_hits").agg(((F.col("top") + F.coalesce(below, "top")) / 2).alias("cut")).select("lang", F.col("_n").alias("n"), F.col("_hits").alias("hits"), "cut")


def calibrate(model: Model, labelled: DataFrame, held: Column) -> None:
    """`_calibrate` over all labelled rows (i, y, t, l) that are held back, or all, where those lack a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(logits(model, b.column(2)), pa.float64())], names=["lang", "y", "z"])

    for rows in (labelled.where(held), labelled):
        found = written(rows.select(F.col("l").cast("string").alias("lang"), "y", F.col("t").cast("string").alias("t")).mapInArrow(run, "lang string, y int, z double"), "logits")
        n, hits, sd = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.stddev_pop("z")).first()
        if 0 < hits < n or rows is labelled:
            break
        drop(found)
    cut = best_cuts(found.select(F.lit(None).cast("string").alias("lang"), "z", "y")).first()["cut"]
    slope = 2 / max(sd, 1e-3)
    model.scale = (slope, float(np.log(DECISION / (1 - DECISION)) - slope * cut))
    for r in best_cuts(found.where("lang is not null")).where("hits >= 5 and hits < n").collect():  # languages: a few
        model.thresholds[r["lang"]] = float(sigmoid(np.array(r["cut"] * slope + model.scale[1])))
    drop(found)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
    max_rows: int = 2000, max_chars: int = 20_000, holdout: tuple[int, int] | None = (3, 1),
) -> Model:
    """Train on at most max_rows labelled rows of each class (texts of up to max_chars; ids, then rows, drawn by a hash) that
    are not held back for calibration, and calibrate on all that are.

    holdout (n, r): rows whose crc32(id as text) mod n is r are not learned from.
    """
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    marks = marks.groupBy("i").agg(F.max("y").alias("y"))  # an id with both labels counts as 1
    if holdout:
        marks = marks.where(crc_mod("i", holdout[0]) != holdout[1])
    held = F.pmod(F.xxhash64("i", F.lit("held")), F.lit(5)) == 4
    learned = marks.where(~held)
    rate = learned.groupBy("y").count().select("y", (F.lit(float(max_rows)) / F.col("count")).alias("rate"))
    drawn = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = learned.join(F.broadcast(rate), "y").where(drawn < F.col("rate")).select("i", "y")  # at most about 2 * max_rows ids
    every = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("t").isNotNull())
    labelled = every.where(F.length("t") <= max_chars).join(F.broadcast(few), "i")
    each = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("i", "t"), "i", "t").limit(max_rows) for y in (0, 1)]  # an id may have any number of rows
    got = each[0].unionByName(each[1]).orderBy("i", "t").toArrow()
    model = train(got.column("t").to_pylist(), got.column("y").to_pylist(), None)
    whole = every.join(marks, "i")
    if model.constant is None:
        calibrate(model, whole, held)
    else:
        model.constant = whole.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Per row: id, score (0 to 1); with lang_col also lang and flagged: score at least the language's threshold
    (DECISION where the language has none). The score itself never sees the language."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(model, b.column(2))
            cut = np.array([model.thresholds.get(x, DECISION) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(s >= cut, pa.bool_())], names=["id", "lang", "score", "flagged"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    df = spread(docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("t")))
    out = df.mapInArrow(run, "id long, lang string, score double, flagged boolean").withColumnRenamed("id", id_col)
    return out if lang_col else out.select(id_col, "score")
