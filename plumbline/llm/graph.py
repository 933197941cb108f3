"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: Edges that a task contracts at a time.
CONTRACT_EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these edges as (node, least node of its component), without the least nodes themselves."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while len(u):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge a node and CONTRACT_EDGES edges: a map-side combine, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            pairs = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*pairs)], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= CONTRACT_EDGES:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (id, root) for every node of the edges (u, v) between two nodes; root is the smallest id reachable."""
    found = forest(edges, max_rounds)
    ends = edges.where(F.col("u") != F.col("v")).select(F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("id")).distinct()
    return ends.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (id, root) for every node of the edges (u, v) but the roots; root is the smallest id reachable.

    The number of rounds grows with the logarithm of the longest path. What a join looks up (one row a node) is a
    written table, so the join is a broadcast where that table is small; beyond that the edges of a hub, which are
    on the other side, are split by Spark's handling of skewed joins.
    """
    e = written(contracted(edges), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = F.col("v") < F.col("u")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max(F.when(up, F.col("v"))).alias("up"), F.max(~up).alias("down"))
        least = written(least.select("u", F.least("u", "m").alias("m"), ((F.col("up") != F.col("m")) | (F.col("up").isNotNull() & F.col("down"))).alias("open")), "least")
        if least.where("open").isEmpty():  # every node is a root or has one edge, to a root
            drop(least)
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).distinct()
        large = written(contracted(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        drop(e, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(contracted(small.distinct()), "edges")
        drop(large, least)
    raise RuntimeError(f"components not found in {max_rounds} rounds")
