"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that can hold a run.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
max(6, 4 q) that no neighbouring word extends. Its words match those q further on at max(6 - q, 3 q) places in a row or
more. So for each lag up to a quarter of the text all matches are counted: of rare words by the differences of their
places, of frequent ones (over about the root of n log n places) by an autocorrelation with FFT, whose values are whole
numbers far over the rounding error. Lags with too few matches hold no run. The others, from the shortest on, are
scanned for islands of matches; matches within runs already found are taken off their multiples first, since two
runs of periods d and q, d a divisor of q, share fewer than q words. A scan looks at every (q / 8)-th place before it
looks at all, so all scans of a text together take time of the order n log n.

Words are numbered by a dictionary, not by hash. A task holds one batch of texts; a text's work needs memory in
proportion to its length.

Defined cases: null and empty texts have no words and no runs and collapse to an empty text; repeated rows have equal
results; ties of the best run go to the smallest start, then the smallest period; extra columns pass through, whatever
their names: a result column whose name docs has already gets underscores behind it; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import chunks, fresh, numbered_words, prepare, spread, text_buffer

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: A scan looks at so many places a period first.
_ANCHORS = 8


def _matches_needed(period: int) -> int:
    return max(MIN_WORDS, MIN_PERIODS * period) - period


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to `most` the number of places i with ids[i] == ids[i + lag] (0 for lag 0)."""
    n = len(ids)
    out = np.zeros(most + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True])))
    often = np.diff(cuts)
    heavy = often > max(16, int(math.sqrt(n * math.log2(n + 1))))
    light = ~np.repeat(heavy, often)
    place, word = order[light], found[light]
    left = np.arange(len(place))  # places that have a j-th next one of the same word within `most`
    j = 1
    while len(left := left[left + j < len(place)]):
        left = left[word[left + j] == word[left]]
        gap = place[left + j] - place[left]
        near = gap <= most
        left = left[near]
        out += np.bincount(gap[near], minlength=most + 1)
        j += 1
    if heavy.any():
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for k in np.flatnonzero(heavy):
            here = np.zeros(size)
            here[order[cuts[k] : cuts[k + 1]]] = 1.0
            f = np.fft.rfft(here)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    out[0] = 0
    return out


def _islands(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the stretches of at least `least` true values."""
    if len(equal) < least:
        return
    ends = np.flatnonzero(np.concatenate(([True], ~equal, [True])))
    gaps = np.diff(ends) - 1
    for k in np.flatnonzero(gaps >= least):
        yield int(ends[k]), int(gaps[k])


def _scan(ids: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """Start and number of matches of the islands of one lag that are long enough."""
    here, there = ids[:-period], ids[period:]
    least = _matches_needed(period)
    step = max(1, period // _ANCHORS)
    if step == 1:
        yield from _islands(here == there, least)
        return
    for first, n in _islands(here[::step] == there[::step], least // step):
        lo = max(0, (first - 1) * step + 1)
        hi = min(len(here), (first + n) * step)
        for start, matches in _islands(here[lo:hi] == there[lo:hi], least):
            yield lo + start, matches


def _primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of the period is a period of the run too."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = period // factor
            if np.array_equal(ids[start : start + period], ids[start + d : start + d + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    most = max(1, n // MIN_PERIODS)
    count = lag_matches(ids, most)
    need = np.maximum(MIN_WORDS, MIN_PERIODS * np.arange(most + 1)) - np.arange(most + 1)
    out = []
    for q in np.flatnonzero(count >= need)[0:].tolist():
        if q == 0 or count[q] < need[q]:  # matches of shorter runs have gone meanwhile
            continue
        for start, matches in _scan(ids, q):
            if _primitive(ids, start, q):
                length = matches + q
                out.append((start, length, q))
                times = np.arange(q, min(length, most + 1), q)
                count[times] -= length - times
    return sorted(out, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given), and behind them _n_words, _runs and _collapsed (kept words joined by one space)."""
    prepare(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else keep
    rows = spread(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in chunks(offs):
                at = offs[lo : hi + 1] - offs[lo]
                ids, vocab, starts, _ = numbered_words(data[offs[lo] : offs[hi]], at)
                cuts = np.searchsorted(starts, at)
                runs = [runs_of(ids[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                stay = np.concatenate([_kept(j - i, r) for i, j, r in zip(cuts[:-1], cuts[1:], runs, strict=True)])
                left = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(stay)))[cuts], pa.int32()), vocab.take(pa.array(ids[stay])))
                rows = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, hi - lo).columns[:-1], pa.array(np.diff(cuts)), found, pc.binary_join(left, " ")], names=[*b.schema.names[:-1], "n_words", "runs", "collapsed"]
                )

    kinds = ", ".join([*(f"`c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "n_words long", f"runs {RUNS}", "collapsed string"])
    out = rows.mapInArrow(work, kinds)
    return out.toDF(*keep, *[fresh(docs, c) for c in ("_n_words", "_runs", "_collapsed")])


def best_run(runs: Column) -> Column:
    """The run of the greatest length / period, compared without division; of equal ones the first; null without runs."""
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(better(b, r), r).otherwise(b))


def runs_digest(runs: Column) -> Column:
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(runs, line), ""), 256)


def tiled(text: Column, key: Column) -> Column:
    """A tenth of the texts, chosen by crc32 of the key as text, with the words from one on repeated periodically."""

    def tile(x: Column) -> Column:
        w, n, g = x["w"], F.size(x["w"]), x["g"]
        at = let((g % n).cast("int"), lambda a: F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"), w.alias("w")))
        words = let(at, lambda y: F.concat(F.slice(y["w"], F.lit(1), y["a"]), F.transform(F.sequence(y["a"], n - 1), lambda i: F.get(y["w"], y["a"] + (i - y["a"]) % y["p"]))))
        return F.array_join(words, " ")

    h = F.crc32(key.cast("string").cast("binary"))
    split = F.struct(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.rlike(r"[^\x20\x09-\x0D]"), let(split, tile)).otherwise(text)
