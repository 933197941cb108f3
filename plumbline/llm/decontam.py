"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

Each benchmark item has a 64-bit SimHash over its word shingles, weighted by how often they occur. A document is
read in windows of the items' own sizes. A window's fingerprint finds, by 8 blocks of 8 bits, every item within
RADIUS = 23 bits: by the pigeonhole principle such an item agrees within 2 bits in at least one block, and all 37
values within 2 bits are indexed. Candidates are then decided by the exact weighted Jaccard similarity.

Windows that cannot reach the threshold are not fingerprinted: with similarity s, at least s * size of a window's
shingles occur in the benchmark, so a running count of such shingles bounds the windows without loss. Two multisets
of similarity 0.8 differ in 9.2 of 64 bits on average, so RADIUS is over four standard deviations away, and
neighbouring windows are tried too.

The benchmark is used in slices of about `max_items` items and `max_bytes` bytes, each a pass of its own over the
documents that writes its matches only, so what the driver and an executor hold is bounded however large the benchmark
is. With one slice documents are never shuffled; with several the few matches are joined to their rows at the end.

Defined cases: null texts and texts without words match nothing; items without words or without an id (a whole number) are
left out; rows of the benchmark that share an id are items of their own, each with its matches; an item with
fewer words than a shingle is one shingle; a document shorter than an item is one window; repeated items and
documents each have their own matches; of equally similar windows the first counts; empty tables give no match.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop, fresh, prepare, release_memory, spread, text_buffer, word_hashes, written
from .shingles import shingle_hashes

RADIUS, BLOCKS = 23, 8
_NEAR = [np.array([v for v in range(256) if bin(v).count("1") <= RADIUS // BLOCKS], np.uint8)][0]
MATCH = "array<struct<item_id:long,start_word:long,n_words:long,similarity:double,distance:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32())]))


def _bits(shingles: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, one column a bit."""
    return np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as 8 bytes each."""
    return np.packbits(sums > 0, axis=1)


class Group:
    """The items of one size with an index from block values to items."""

    def __init__(self, size: int, k: int):
        self.size, self.k, self.ids, self.sets, prints = size, k, [], [], []
        self._prints = prints

    def add(self, item_id: int, shingles: np.ndarray) -> None:
        self.ids.append(item_id)
        self.sets.append(np.unique(shingles, return_counts=True))
        self._prints.append(_pack(_bits(shingles).sum(axis=0)[None, :])[0])

    def build(self) -> Group:
        self.prints = np.stack(self._prints)
        self.first, self.items = [], []
        for b in range(BLOCKS):
            values = (self.prints[:, b][:, None] ^ _NEAR[None, :]).ravel()
            owner = np.repeat(np.arange(len(self.ids)), len(_NEAR))
            order = np.argsort(values, kind="stable")
            self.first.append(np.searchsorted(values[order], np.arange(257)))
            self.items.append(owner[order])
        return self

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) for every item within RADIUS of a window's fingerprint."""
        found = []
        for b in range(BLOCKS):
            lo, hi = self.first[b][prints[:, b]], self.first[b][prints[:, b].astype(int) + 1]
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(window * len(self.ids) + self.items[b][at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        d = np.unpackbits(prints[window] ^ self.prints[item], axis=1).sum(axis=1)
        ok = d <= RADIUS
        return window[ok], item[ok], d[ok]


class Index:
    """A slice of the benchmark: its groups by size and its shingles by length."""

    def __init__(self, items: list[tuple[int, str]], words: int, threshold: float):
        self.threshold = threshold
        groups: dict[int, Group] = {}
        known: dict[int, list[np.ndarray]] = {}
        data, offs = text_buffer(pa.array([t for _, t in items], pa.large_string()))
        hashes, at = word_hashes(data, offs)
        for i, (item_id, _) in enumerate(items):
            own = hashes[at[i] : at[i + 1]]
            if len(own):
                k = min(words, len(own))
                s = shingle_hashes(own, k)
                groups.setdefault(len(own), Group(len(own), k)).add(item_id, s)
                known.setdefault(k, []).append(s)
        self.groups = [groups[m].build() for m in sorted(groups)]
        self.known, self.maps = {k: np.unique(np.concatenate(v)) for k, v in known.items()}, {}
        for k, v in self.known.items():
            self.maps[k] = np.zeros(1 << 20, bool)
            self.maps[k][(v & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, k: int, s: np.ndarray) -> np.ndarray:
        """Which shingles occur in the benchmark."""
        out = self.maps[k][(s & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        known = self.known[k]
        out[at] = known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]
        return out

    def search(self, by_k: dict[int, tuple[np.ndarray, np.ndarray]], n_words: int) -> list[tuple]:
        """Matches of one document; by_k: its shingles and which are hits, by shingle length."""
        best: dict[tuple[int, int], tuple] = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (s, hit) in by_k.items():
            count = np.zeros(len(s) + 1, np.int64)
            np.cumsum(hit, out=count[1:])
            if count[-1]:
                sums[k] = (count, s)
        for g in self.groups:
            if g.k not in sums:
                continue
            count, s = sums[g.k]
            size = min(g.size, n_words) - g.k + 1
            if size < 1:
                continue
            starts = np.flatnonzero(count[size:] - count[:-size] >= self.threshold * (g.size - g.k + 1) - 1e-9)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1) if len(starts) else ():
                for lo in range(0, len(run), 4096):
                    self._windows(g, s, run[lo : lo + 4096], size, best)
        return sorted(best.values())

    def _windows(self, g: Group, s: np.ndarray, starts: np.ndarray, size: int, best: dict) -> None:
        a, z = starts[0], starts[-1] + size
        cs = np.zeros((z - a + 1, 64), np.int32)
        np.cumsum(_bits(s[a:z]), axis=0, out=cs[1:])
        window, item, dist = g.candidates(_pack(cs[starts - a + size] - cs[starts - a]))
        for w, i, d in zip(window, item, dist, strict=True):
            p = int(starts[w])
            sim = weighted_jaccard(np.unique(s[p : p + size], return_counts=True), g.sets[i])
            old = best.get(at := (g.size, int(i)))  # an item is a row of the benchmark, whatever its id
            if sim >= self.threshold and (old is None or (-sim, p) < (-old[3], old[1])):
                best[at] = (g.ids[i], p, size + g.k - 1, sim, int(d))

    def search_all(self, col: pa.Array) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        data, offs = text_buffer(col)
        for lo, hi in chunks(offs):
            words, at = word_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            rows: list[list[tuple]] = [[] for _ in range(hi - lo)]
            live, by_k = set(), {}
            for k in self.known:
                s = shingle_hashes(words, k) if len(words) >= k else words[:0]
                hit = self.hits(k, s)
                by_k[k] = (s, hit)
                live.update((np.searchsorted(at, np.flatnonzero(hit), "right") - 1).tolist())
            for d in sorted(live):
                n = int(at[d + 1] - at[d])
                own = {k: (s[at[d] : max(at[d], at[d + 1] - k + 1)], hit[at[d] : max(at[d], at[d + 1] - k + 1)]) for k, (s, hit) in by_k.items()}
                rows[d] = self.search(own, n)
            out += rows
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two multisets given as (sorted values, counts)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.where(a[0][at] == b[0], np.minimum(a[1][at], b[1]), 0).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _slices(benchmark: DataFrame, id_col: str, text_col: str, max_items: int, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(-(-count // max_items), -(-size // max_bytes))
    if n > 1:
        n *= 2  # slices by hash are not exactly equal
        items = written(items, "items")
    for j in range(max(n, 1)):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1))) == j).orderBy("i", "t").collect()]


def matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    words: int = 5, threshold: float = 0.8, max_items: int = 20_000, max_bytes: int = 64 << 20, out_col: str = "_matches",
) -> DataFrame:
    """docs with one array more, out_col (with underscores behind if docs has that name): of each matched item its id,
    the best window and its similarity, by item id."""
    prepare(docs.sparkSession)
    out_col = fresh(docs, out_col)
    slices = _slices(benchmark, item_id_col, item_text_col, max_items, max_bytes)
    first, second = next(slices), next(slices, None)
    docs = spread(docs)
    if second is None:
        index = Index(first, words, threshold)
        none = docs.withColumn(out_col, F.array().cast(MATCH))
        return _scan(none, index, text_col, True) if index.groups else none
    row = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = []
    for part in itertools.chain([first, second], slices):
        index = Index(part, words, threshold)
        if index.groups:
            hits = _scan(rows.select(row, text_col).withColumn(out_col, F.array().cast(MATCH)), index, text_col, False)
            found.append(written(hits.select(row, out_col), "matches"))
    if not found:
        return rows.drop(row).withColumn(out_col, F.array().cast(MATCH))
    every = functools.reduce(DataFrame.unionByName, found).groupBy(row).agg(F.flatten(F.collect_list(out_col)).alias(out_col))
    every = written(every.withColumn(out_col, F.array_sort(out_col)), "matches")
    drop(*found)
    return rows.join(every, row, "left").withColumn(out_col, F.coalesce(out_col, F.array().cast(MATCH))).drop(row)


def _scan(docs: DataFrame, index: Index, text_col: str, all_rows: bool) -> DataFrame:
    """docs with what the index finds in its last column; without all_rows only rows where it finds something."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _MATCH.value_type]
        for b in batches:
            found = index.search_all(b.column(at).cast(pa.large_string()))
            new = pa.array([[dict(zip(names, m, strict=True)) for m in f] for f in found], _MATCH)
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], new], names=b.schema.names)
            yield out if all_rows else out.filter(pa.array([bool(f) for f in found], pa.bool_()))
            release_memory()

    return docs.mapInArrow(run, docs.schema)
