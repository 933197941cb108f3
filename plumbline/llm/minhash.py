"""MinHash near-dedup with circulant signatures.

A first permutation (a 64-bit bijection, then 32 bits of it) scatters a document's shingles; a second one, shifted
circularly by 0..K-1, gives all K coordinates. Rows of R coordinates make a band; documents that share a band
are candidates, and exact Jaccard similarity on the full shingle sets decides.

No pairs are emitted within a group. (1) Equal sets are one class with one representative. (2) In each bucket every
representative's signature is compared with the smallest one's; what is still apart within a bucket is compared in
pairs of blocks, of which only a spanning forest is kept. This gives components of near signatures. (3) The same
two steps with exact similarity: first the near pairs with a bucket's smallest, then what is still apart within a
near component, in pairs of blocks that keep a spanning forest of exact links. So every candidate link between
components is decided, rows stay in proportion to documents and blocks, and no task holds a whole group.

The chance to miss a link of similarity 0.8 is (1 - 0.8^4)^24 < 4e-6; the signature filter's is below 1e-7.

Defined cases: null or empty texts and texts without words have an empty set, no links, and their own id as
component; rows that share an id are one document, whose set is that of the least digest among theirs, and each of
them is returned; rows without an id are returned with a null component and kept; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fresh, mix, prepare, release_memory, spread, written
from .graph import forest
from .shingles import distinct_shingles

BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Standard errors of the signature's estimate below the threshold at which a pair is still verified.
SLACK = 5.5
#: Documents on either side of a task that compares signatures, or whole sets.
SIG_BLOCK, SET_BLOCK = 1024, 1024
#: Candidate ids are broadcast up to this many (8 bytes each), joined by a shuffle beyond.
BROADCAST_IDS = 400_000
_SHIFT = np.arange(K, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """K coordinates of a non-empty set: minima of one permutation under K circular shifts."""
    x = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    best = np.full(K, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        y = x[None, lo : lo + 2048] + _SHIFT
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        y ^= y >> np.uint32(16)
        np.minimum(best, y.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key ^ rows[:, j]) + np.uint64(j)
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, n, setkey, bands, sig) of every row; sig has the low byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, setkey, bands, sig = [], [], [], []
            for s in distinct_shingles(b.column(1), words):
                n.append(len(s))
                if len(s):
                    x = signature(s)
                    setkey.append(set_key(s))
                    bands.append(band_keys(x))
                    sig.append((x & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    setkey.append(None), bands.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(setkey, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["id", "n", "setkey", "bands", "sig"],
            )
            release_memory()

    df = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")))
    return df.mapInArrow(run, "id long, n long, setkey binary, bands array<long>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, set): sorted shingle hashes of the documents in ids (id, setkey)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(distinct_shingles(b.column(1), words))
            own = pa.array([set_key(s) == k for s, k in zip(sets, b.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"]).filter(own)

    few = ids.count() <= BROADCAST_IDS
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    df = df.join(F.broadcast(ids) if few else ids, "id")
    return df.select("id", "t", "setkey").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sizes and signatures leave the threshold possible."""
    least = _least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (2, 3))
                ok = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    a, c = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}")) for x in ("a", "b"))
    rows = pairs.join(c, "b").join(a, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return rows.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _least_matches(percent: int) -> int:
    p = percent / 100
    return int(np.floor(K * (p - SLACK * np.sqrt(p * (1 - p) / K))))


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (u, v): those distinct pairs (a, b) of reps (id, setkey) with 100 * intersection >= percent * union on full sets.

    The many partners of one document are dealt out by a salt; its set is copied once for each salt in use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.searchsorted(x, y)
                both = int((x[np.minimum(both, len(x) - 1)] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    pairs = written(pairs.distinct(), "pairs")
    asked = written(reps.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), "asked")
    sets = written(_sets(docs, asked, id_col, text_col, words), "sets")
    salts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts")), "salts")
    rows = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    rows = rows.select("a", "b", "salt").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    left = salts.join(sets, salts.a == sets.id).select("a", F.col("set").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    links = written(rows.join(left, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "u long, v long"), "links")
    drop(pairs, asked, sets, salts)
    return links


class Forest:
    """Labels of documents in a task; edges are kept only where they join two labels."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.edges = left.copy(), right.copy(), []

    def join(self, i: int, ys: np.ndarray, ids: np.ndarray, x: int) -> None:
        """Document x, the i-th on the left, is linked with the documents ys on the right."""
        if len(ys):
            labels, first = np.unique(self.right[ys], return_index=True)
            for label, y in zip(labels, ys[first], strict=True):
                if label != self.left[i]:
                    self.edges.append((x, int(ids[y])))
                    mine = self.left[i]
                    self.left[self.left == label] = mine
                    self.right[self.right == label] = mine

    def table(self) -> pa.Table:
        u, v = (pa.array([e[k] for e in self.edges], pa.int64()) for k in (0, 1))
        return pa.table({"u": u, "v": v})


def _within(rows: DataFrame, groups: DataFrame, percent: int, block: int, exact: bool) -> DataFrame:
    """Edges (u, v) that join different labels `comp` within a group `grp`: of near signatures, or of exact links.

    Rows (grp, id, comp, n, sig, lead, set): documents that lead are compared with all of their group, in pairs of
    blocks of about `block` documents; groups (grp, members, leads) is a written table. A task keeps a spanning forest, so it never returns more edges than it has
    documents, however many pairs it looks at.
    """
    least = _least_matches(percent)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lead = rows.column("lead").to_numpy(zero_copy_only=False).astype(bool)
        if lead.all() or not lead.any():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        ids, comp, n = (rows.column(c).to_numpy() for c in ("id", "comp", "n"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, K)
        left, right = np.flatnonzero(lead), np.flatnonzero(~lead)
        r_sig, r_n, r_ids = np.ascontiguousarray(sig[right]), n[right], ids[right]
        forest = Forest(comp[left], comp[right])
        if exact:
            raw = rows.column("set").to_pylist()
            known, flat = np.unique(np.frombuffer(b"".join(raw[k] for k in right), np.uint64), return_inverse=True)
            first = np.concatenate(([0], np.cumsum(r_n)))
            mark = np.zeros(len(known) + 1, bool)
        for i, x in enumerate(left):
            ys = np.flatnonzero((forest.right != forest.left[i]) & (100 * np.minimum(r_n, n[x]) >= percent * np.maximum(r_n, n[x])))
            if len(ys):
                ys = ys[(r_sig[ys] == sig[x]).sum(axis=1) >= least]
            if exact and len(ys):
                own = np.frombuffer(raw[x], np.uint64)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at = at[known[at] == own]
                mark[at] = True
                size = r_n[ys]
                begin = np.cumsum(size) - size
                span = np.arange(size.sum()) + np.repeat(first[ys] - begin, size)
                both = np.add.reduceat(mark[flat[span]].astype(np.int64), begin)
                mark[at] = False
                ys = ys[100 * both >= percent * (n[x] + size - both)]
            forest.join(i, ys, r_ids, int(ids[x]))
        return forest.table()

    rows = rows.join(groups.select("grp", F.ceil(F.col("members") / block).cast("int").alias("nr"), F.ceil(F.col("leads") / block).cast("int").alias("nl")), "grp")
    part = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    cols = ["id", "comp", "n", "sig"] + ["set"] * exact
    right = rows.withColumn("j", part("nr")).select("grp", F.explode(every("nl")).alias("i"), "j", F.lit(False).alias("lead"), *cols)
    left = rows.where("lead").withColumn("i", part("nl")).select("grp", "i", F.explode(every("nr")).alias("j"), F.lit(True).alias("lead"), *cols)
    return left.unionByName(right).groupBy("grp", "i", "j").applyInArrow(run, "u long, v long")


def _stragglers(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (grp, id, comp) those groups that hold several labels, with lead: not of the label that most have; and
    those groups (grp, comp, members, leads). Both are written, so that no stage gathers a group."""
    share = placed.groupBy("grp", "comp").agg(F.count("*").alias("k"))
    torn = share.groupBy("grp").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("labels"), F.sum("k").alias("members")).where("labels > 1")
    torn = written(torn.select("grp", F.col("top.comp").alias("most"), "members", (F.col("members") - F.col("top.k")).alias("leads")), "torn")
    return written(placed.join(torn, "grp").select("grp", "id", "comp", (F.col("comp") != F.col("most")).alias("lead")), "apart"), torn


def _labelled(rows: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """rows with the column label: the root of id, or id itself."""
    return rows.join(roots.withColumnRenamed("root", "_root"), "id", "left").withColumn(label, F.coalesce("_root", "id")).drop("_root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of docs: kept marks the document of a group that stays."""
    prepare(docs.sparkSession)
    signed = written(sign(docs, id_col, text_col, words), "signed")
    chosen = signed.where(F.col("id").isNotNull() & F.col("setkey").isNotNull()).groupBy("id").agg(F.min(F.struct("setkey", "n")).alias("s"))
    chosen = written(chosen.select("id", "s.setkey", "s.n"), "chosen")
    same = written(chosen.groupBy("setkey").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "same")
    classes = written(chosen.join(same, "setkey", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "setkey"), "classes")
    leaders = classes.where("id = rep").select("id", "setkey")
    reps = written(signed.join(leaders, ["id", "setkey"], "left_semi").dropDuplicates(["id", "setkey"]), "reps")
    drop(chosen, same)
    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("center"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    buckets = buckets.where("c > 1").groupBy("center", "c", "who").agg(F.min("key").alias("key"))  # buckets with the same members count once
    buckets = written(buckets.select("key", "center"), "buckets")
    members = written(banded.join(buckets, "key"), "members")
    light, keys = reps.select("id", "n", "sig"), reps.select("id", "setkey")
    # 1. near signatures: every member of a bucket with its center, then what is still apart within a bucket
    first = written(_near(members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), light, percent), "near")
    stars = forest(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    apart, torn = _stragglers(_labelled(members.select(F.col("key").alias("grp"), "id"), stars, "comp"))
    more = written(_within(apart.join(light, "id"), torn, percent, SIG_BLOCK, False), "near")
    near = _merged(stars, more)
    drop(buckets, members, apart, torn)
    # 2. exact links: every near pair with a center, then what is still apart within a near component
    roots = forest(verify(first, keys, docs, id_col, text_col, words, percent))
    placed = near.select("id", F.col("root").alias("grp")).unionByName(near.select(F.col("root").alias("id"), F.col("root").alias("grp")).distinct())
    apart, torn = _stragglers(_labelled(placed, roots, "comp"))
    sets = _sets(docs, keys.join(apart.select("id"), "id", "left_semi"), id_col, text_col, words)
    links = written(_within(apart.join(light, "id").join(sets, "id"), torn, percent, SET_BLOCK, True), "links")
    roots = _merged(roots, links)
    drop(first, more, apart, torn, reps)
    known = classes.select(F.col("id").alias("_id"), F.col("n").alias("_n"), "rep").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    known = written(known.select("_id", "_n", F.coalesce("root", "rep").alias("_comp")), "known")
    drop(classes)
    out = signed.select("id", "n").join(known, F.col("id") == F.col("_id"), "left")
    comp = F.coalesce("_comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("_n", "n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Components of a graph whose components are roots when the edges more are added."""
    return roots if more.isEmpty() else forest(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates does not keep, and with one of the rows of an id (the least text
    stays; rows without an id all stay). What goes is broadcast only if it is bounded."""
    found = near_duplicates(docs, id_col, text_col, words, percent).where(F.col(id_col).isNotNull())
    gone = written(found.where(~F.col("kept")).select(id_col).distinct(), "gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(*docs.columns)
    count, nth = fresh(docs, "_count"), fresh(docs, "_nth")
    many = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(count)).where(F.col(count) > 1)
    many = written(many.select(id_col), "repeated")
    if many.isEmpty():
        return left
    others = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    order = Window.partitionBy(id_col).orderBy(*[F.col(c) for c in [text_col, *others]])
    one = left.join(many, id_col, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return left.join(many, id_col, "left_anti").select(*docs.columns).unionByName(one)


