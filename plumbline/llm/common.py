"""Shared pieces: the checkpoint folder, Arrow text buffers and a vectorised word hasher."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds at a time are bounded by bytes, not by row count, so long texts are safe.
BATCH_BYTES = 2 << 20
#: Bytes of text that the vectorised kernels look at together (whole texts; one text may be longer).
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; without a checkpoint folder set one where driver and executors are one machine."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    prepare(spark)
    own = spark.conf.get("spark.checkpoint.dir", None)
    return own or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_to"] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.__dict__.get("_written_to")
        if path:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished work now: it does so when the driver collects its garbage."""
    import gc
    import time

    for _ in range(2):  # plans that listeners hold go with the second collection
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def release_memory() -> None:
    """Give freed memory back to the system: workers are reused by stages with other needs."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Tables of fewer files than cores are dealt out anew up to so many bytes a core.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small table lies in fewer files than there are cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores and size < SPREAD_BYTES * cores else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_prefix(df: DataFrame) -> str:
    """A prefix with which no column of df begins."""
    prefix = "_found_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n (never negative)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = n + 4096
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ (or without the bytes of another table); a word never crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    prev = np.empty_like(w)
    prev[0] = False
    prev[1:] = w[:-1]
    starts = np.flatnonzero(w & (~prev | edge[:-1]))
    nxt = np.empty_like(w)
    nxt[-1] = False
    nxt[:-1] = w[1:]
    ends = np.flatnonzero(w & (~nxt | edge[1:])) + 1
    return starts, ends


class SpanHasher:
    """64-bit hashes of byte spans of one buffer: differences of one prefix polynomial, then mixed."""

    def __init__(self, data: np.ndarray):
        fwd, self.inv = _powers(len(data) + 1)
        self.cs = np.empty(len(data) + 1, np.uint64)
        self.cs[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * fwd[: len(data)], out=self.cs[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.cs[ends] - self.cs[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))


#: Longer words are hashed by BLAKE2b: a polynomial modulo 2^64 has known collisions of some hundred bytes.
POLYNOMIAL_BYTES = 32


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and word offsets by row (n + 1)."""
    starts, ends = word_spans(data, offs)
    low = LOWER[data]
    out = SpanHasher(low)(starts, ends)
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, offs)


def numbered_words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Numbers of the words by a dictionary (no hashes), the dictionary, and the words' byte starts and ends."""
    starts, ends = word_spans(data, offs, space)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    chars = data[~space[data]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[chars] if lower else chars)).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string()), starts, ends
