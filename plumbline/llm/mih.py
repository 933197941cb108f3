"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

`fit` learns a rotation (principal axes, then iterative quantisation) from a bounded sample and calibrates the
Hamming radius that holds the sample's true neighbours at `target` recall. `search` cuts rows into blocks by a hash
of the id; in each block every code's substrings are indexed, and a query probes all substring values within
radius // parts bits: by the pigeonhole principle this reaches every code within the radius. What is found is
ranked by the exact inner product in double precision.

Rows are shuffled to their block, queries to every block, and sorted so that a task reads a block's rows first: it
indexes them once and streams all queries past the index, an Arrow batch at a time. A task holds one block, whose size
is bounded; only where blocks are fewer than `TASKS` is each copied, for parts of the queries, to keep the cores busy.
Equal vectors are spread over the blocks like any others, so no vector or code makes a hot task. The number of
results is queries times k.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite values take no
part; rows without an id take no part; rows that share an id count once, with the smallest vector; a block with
fewer than k codes within the radius is ranked whole; ties go to the smaller id; products beyond the range of doubles are
infinite, those below it zero, and a sum of both infinities (NaN) ranks as the lower one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

BITS, PARTS = 64, 8
WIDTH = BITS // PARTS
#: A block has at least so many rows, of larger tables a part in TASKS, and never more numbers than BLOCK_VALUES (64 MB).
ROW_BLOCK, BLOCK_VALUES = 32_768, 1 << 23
#: TASKS blocks or more are not copied; fewer are copied once for every QUERY_BLOCK queries, up to TASKS copies in all.
TASKS, QUERY_BLOCK = 256, 2_048
_ONES = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint8))


@dataclass
class Model:
    rotation: np.ndarray  # (dim, BITS)
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, PARTS) substrings of WIDTH bits."""
        return np.packbits(scaled(x) @ self.rotation > 0, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by its largest component, so that squares and sums neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64)[:, 0] ^ code.view(np.uint64)[0])


def learn(x: np.ndarray, k: int = 20, target: float = 0.95, rounds: int = 30, seed: int = 5) -> Model:
    """Rotation by iterative quantisation, radius by the true neighbours of up to 256 rows within the sample."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if len(x) else 1
    if len(x) < 2:
        return Model(rng.standard_normal((dim, BITS)), BITS)
    y = scaled(x)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    take = min(dim, BITS)
    _, axes = np.linalg.eigh(y.T @ y)
    axes = axes[:, ::-1][:, :take]
    v = y @ axes
    r = np.linalg.qr(rng.standard_normal((take, take)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    rotation = axes @ r
    if take < BITS:  # further random directions for short vectors
        rotation = np.concatenate([rotation, rng.standard_normal((dim, BITS - take))], axis=1)
    m = Model(rotation, BITS)
    codes = m.codes(x)
    seen, most = [], x / np.abs(x).max()  # nearest stay nearest when all are divided by one number
    for q in rng.permutation(len(x))[:256]:
        score = most @ most[q]
        score[q] = -np.inf
        near = np.argpartition(-score, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        seen.append(distances(codes[near], codes[q]))
    m.radius = int(np.quantile(np.concatenate(seen), target, method="higher"))
    return m


class Block:
    """The codes of one block of rows, indexed by the value of each substring."""

    def __init__(self, m: Model, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.m, self.ids, self.x = m, ids[order], x[order]
        self.codes = np.ascontiguousarray(m.codes(self.x))
        self.rows, self.first = [], []
        for j in range(PARTS):
            o = np.argsort(self.codes[:, j], kind="stable")
            self.rows.append(o.astype(np.int32))
            self.first.append(np.searchsorted(self.codes[o, j], np.arange((1 << WIDTH) + 1)).tolist())
        self.masks = np.flatnonzero(_ONES <= m.radius // PARTS).astype(np.uint8)

    def probe(self, code: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius."""
        seen = np.zeros(len(self.ids), bool)
        for j in range(PARTS):
            first, rows = self.first[j], self.rows[j]
            values = (self.masks ^ code[j]).tolist()
            seen[np.concatenate([rows[first[v] : first[v + 1]] for v in values])] = True
        found = np.flatnonzero(seen)
        return found[distances(self.codes[found], code) <= self.m.radius]

    def nearest(self, query_id: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.probe(code)
        found = found[self.ids[found] != query_id]
        if len(found) < k:
            found = np.flatnonzero(self.ids != query_id)
        with np.errstate(over="ignore", invalid="ignore"):
            score = self.x[found] @ q
        if len(found) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k] if np.isfinite(score).all() else -np.inf
            found = found[score >= kth - 1e-9 * max(1.0, abs(kth))] if np.isfinite(kth) else found
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.x[found] * q).sum(axis=1)  # the same order of addition for every row, so ties are ties
        best = np.lexsort((self.ids[found], -np.where(np.isnan(score), -np.inf, score)))[:k]
        return self.ids[found[best]], score[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v) that take part; v as array<double>."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def layout(n: int, queries: int, dim: int) -> tuple[int, int]:
    """Blocks of rows, and parts of the queries for each of which all blocks are copied: one from `TASKS` blocks on."""
    rows = min(max(ROW_BLOCK, -(-n // TASKS)), max(1, BLOCK_VALUES // dim))
    blocks = max(1, -(-n // rows))
    return blocks, max(1, min(-(-TASKS // blocks), -(-queries // QUERY_BLOCK)))


def search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample_rows: int = 20_000, target: float = 0.95
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each row where is_query(id column) holds its k nearest others."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    model = learn(_matrix(rows.where(drawn < sample_rows / n).orderBy("id").select("v").toArrow().column(0), dim), k, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "part", "query")]).astype(np.int64)
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if (marks[0, lo], marks[1, lo]) != here:
                    here, held, block = (marks[0, lo], marks[1, lo]), [], None
                ids, x = batch.column("id")[lo:hi].to_numpy(), _matrix(batch.column("v")[lo:hi], dim)
                if not marks[2, lo]:
                    held.append((ids, x))
                elif held:
                    if block is None:
                        block = Block(model, np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                        held = [None]  # the index has its own copy
                    yield answers(block, ids, x)

    def answers(block: Block, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        found = [block.nearest(i, q, code, k) for i, q, code in zip(ids.tolist(), x, model.codes(x), strict=True)]
        score = np.concatenate([s for _, s in found])
        columns = {"query_id": np.repeat(ids, [len(s) for _, s in found]), "vec_id": np.concatenate([r for r, _ in found]), "score": score}
        return pa.RecordBatch.from_pydict({**columns, "order": np.where(np.isnan(score), -np.inf, score)})

    queries = rows.where(is_query(F.col("id")))
    blocks, parts = layout(n, queries.count(), dim)
    slot = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("id", "v", slot(blocks).alias("b"), each(parts).alias("part"), F.lit(0).alias("query"))
    right = queries.select("id", "v", slot(parts).alias("part"), each(blocks).alias("b"), F.lit(1).alias("query"))
    tasks = left.unionByName(right).repartition(blocks * parts, "b", "part").sortWithinPartitions("b", "part", "query")
    found = tasks.mapInArrow(run, "query_id long, vec_id long, score double, order double")
    order = Window.partitionBy("query_id").orderBy(F.desc("order"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
