"""Byte-level BPE by recursive queries: token-position rows join a merge table until a fixpoint.

Each Python worker holds one small in-process DuckDB with the merge table (bounded by the vocabulary file) and
a bounded cache of words already encoded, so a word is contracted once for many occurrences. Texts stay in
their partition: there is no shuffle.

Defined cases: null text counts as empty and gives no ids; white space only is encoded like any text;
repeated rows give repeated results; an empty table gives an empty result; words of any length are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release_memory, spread

#: Distinct words in one generation of the cache; two generations are kept.
CACHE_WORDS = 350_000
#: Characters of text that are split at a time (whole texts; one text may be longer).
GROUP_CHARS = 14_000_000
#: Bounds what a contracting query holds: the sum of squares of its words' bytes (each step keeps a word's rows).
QUERY_ROWS = 8_000_000
#: Tokens that a decoding query puts in order.
DECODE_TOKENS = 500_000
#: Longer words contract every safe occurrence of their pair in a step, so that steps do not grow with the length.
SHORT = 64

#: One step contracts the leftmost pair of least rank of every word that still has a pair.
CONTRACT = """
with recursive s as (
  select (w::bigint << 16) | p as k, t, 0 as it from base
  union all
  (with n as (select k, t, lead(t) over x as nt, lead(k) over x as nk from s window x as (order by k)),
   c as (
     select n.k >> 16 as w, min((m.m::bigint << 32) | ((n.k & 65535) << 16) | (n.nk & 65535)) as b
     from n join merges m on n.t = m.l and n.nt = m.r where n.k >> 16 = n.nk >> 16 group by 1)
   select s.k, (case when s.k & 65535 = (c.b >> 16) & 65535 then c.b >> 32 else s.t end)::int as t, s.it + 1 as it
   from s join c on s.k >> 16 = c.w where s.k & 65535 <> c.b & 65535)
)
select s.k >> 16 as w, string_agg(t::varchar, ' ' order by k) as ids
from s join (select k >> 16 as w, max(it) as it from s group by 1) e on s.k >> 16 = e.w and s.it = e.it group by 1
"""

#: The same for long words, with rows kept by position: a step contracts the occurrences of the least-rank pair, left
#: to right without overlap, as far as none makes a neighbouring pair of still lower rank. That is what one leftmost
#: contraction at a time would do. A position that was contracted away gets the token -1.
CONTRACT_LONG = """
with recursive s(w, p, t) using key (w, p) as (
  select w, p, t from base
  union
  (with n as (
     select w, p, t, lead(t) over x as nt, lead(p) over x as np, lead(t, 2) over x as nnt, lead(p, 2) over x as nnp, lag(t) over x as pt
     from (select r.w, r.p, r.t from recurring.s r where r.t >= 0 and r.w in (select w from s)) window x as (partition by w order by p)),
   k as (select n.*, m.m, min(m.m) over (partition by n.w) as mm from n join merges m on n.t = m.l and n.nt = m.r),
   o as (select *, lag(np) over (partition by w order by p) as before from k where m = mm),
   i as (select *, sum((before is distinct from p)::int) over (partition by w order by p) as isle from o),
   c as (select * from (select *, row_number() over (partition by w, isle order by p) as nth from i) where nth % 2 = 1),
   l as (select *, case when lag(nnp) over (partition by w order by p) = p then mm else pt end as left_t from c),
   u as (
     select l.*, coalesce(a.m < mm, false) or coalesce(b.m < mm, false) as unsafe
     from l left join merges a on l.left_t = a.l and l.mm = a.r left join merges b on l.mm = b.l and l.nnt = b.r),
   d as (select *, min(case when unsafe then p end) over (partition by w) as stop from u),
   e as (select w, p, np, mm from d where stop is null or p <= stop)
   select w, p, mm from e union all select w, np, -1 from e)
)
select w, string_agg(t::varchar, ' ' order by p) as ids from s where t >= 0 group by w
"""

#: Positions with their tokens' bytes, put together in order.
DECODE = "select d, list(b order by p) as parts from sequence join vocab using (t) group by d order by d"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS, group_chars: int = GROUP_CHARS):
        import duckdb
        import regex

        self.cache_words, self.group_chars = cache_words, group_chars
        self.find = regex.compile(pattern).findall
        self.ranks = ranks = load_ranks(path)
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})
        left, right, merged = map(list, zip(*rows)) if rows else ([], [], [])
        self._table("merges", {"l": left, "r": right, "m": merged})
        self.db.register("v", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "b": pa.array(list(ranks), pa.binary())}))
        self.db.execute("create table vocab as select * from v")
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def _table(self, name: str, cols: dict) -> None:
        self.db.register("_rows", pa.table({k: pa.array(v, pa.int32()) for k, v in cols.items()}))
        self.db.execute(f"create or replace temp table {name} as select * from _rows")
        self.db.unregister("_rows")

    def _rows(self, words: list[bytes]) -> dict:
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n) - n
        data = np.frombuffer(b"".join(words), np.uint8)
        return {
            "w": np.repeat(np.arange(len(words), dtype=np.int32), n),
            "p": (np.arange(len(data)) - np.repeat(first, n)).astype(np.int32),
            "t": np.asarray(self.byte_ids, np.int32)[data],
        }

    def contract(self, words: list[bytes]) -> dict[bytes, str]:
        """Words to their ids, joined by spaces; a word that is itself a token is its id."""
        out = {w: str(self.ranks[w]) for w in words if w in self.ranks}
        rest = [w for w in words if w not in out]
        for few, query in (([w for w in rest if len(w) <= SHORT], CONTRACT), ([w for w in rest if len(w) > SHORT], CONTRACT_LONG)):
            held: list[bytes] = []
            size = 0
            for w in few:
                cost = len(w) * min(len(w), SHORT)
                if held and size + cost > QUERY_ROWS:
                    out.update((held[k], ids) for k, ids in self._contracted(held, query))
                    held, size = [], 0
                held.append(w)
                size += cost
            if held:
                out.update((held[k], ids) for k, ids in self._contracted(held, query))
        return out

    def _contracted(self, words: list[bytes], query: str) -> list[tuple[int, str]]:
        self._table("base", self._rows(words))
        return self.db.execute(query).fetchall()

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Id sequences to bytes: position rows join the vocabulary and an ordered aggregation puts them together."""
        out = [[] for _ in sequences]
        size = np.array([len(s) for s in sequences], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *sequences])
        which = np.repeat(np.arange(len(size), dtype=np.int32), size)
        for lo in range(0, len(ids), DECODE_TOKENS):  # a long sequence goes through several queries
            some = slice(lo, lo + DECODE_TOKENS)
            part = pa.table({"d": which[some], "p": np.arange(len(ids[some]), dtype=np.int32), "t": ids[some]})
            self.db.register("sequence", part)
            got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            self.db.unregister("sequence")
            for d, parts in zip(got.column("d").to_pylist(), _lists(got.column("parts")), strict=True):
                out[d].append(parts)
        return [b"".join(x) for x in out]

    def learn(self, words: set[str]) -> dict[str, tuple[str, bytes]]:
        """Ids of these words, as decimals and as 32-bit numbers, from the cache or by the queries."""
        out = {}
        for w in words:
            hit = self.young.get(w)
            if hit is None and (hit := self.old.get(w)):
                self.young[w] = hit  # what is still in use survives the next change of generations
            if hit:
                out[w] = hit
        new = [w for w in words if w not in out]
        if new:
            raw = [w.encode() for w in new]
            ids = self.contract(raw)
            out.update((w, (ids[b], np.array(ids[b].split(), np.int32).tobytes())) for w, b in zip(new, raw, strict=True))
        if len(self.young) + len(new) > self.cache_words:
            self.old, self.young = self.young, {}
        self.young.update((w, out[w]) for w in new[: self.cache_words])
        return out

    def groups(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about group_chars characters together."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= self.group_chars):
                size += len(texts[hi])
                hi += 1
            yield lo, hi
            lo = hi

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """Of each text its ids, as decimals joined by spaces and as numbers."""
        split = [self.find(t) for t in texts]
        known, out = self.learn(set().union(*split)), []
        for ws in split:
            pairs = [known[w] for w in ws]
            out.append((" ".join([a for a, _ in pairs]), np.frombuffer(b"".join([b for _, b in pairs]), np.int32)))
        return out


    def coded(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, bytes]]:
        """Of each text its ids, as decimals and as numbers, and the bytes that these ids decode to."""
        for lo, hi in self.groups(texts):
            found = self.encode(texts[lo:hi])
            for (line, ids), raw in zip(found, self.decode([ids for _, ids in found]), strict=True):
                yield line, ids, raw

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Of each text: ids joined by spaces, their number, and the bytes decoded from them."""
        for line, ids, raw in self.coded(texts):
            yield line, len(ids), raw


def _lists(col: pa.ChunkedArray) -> Iterator[bytes]:
    """The joined bytes of each list of byte strings: they lie side by side."""
    for x in col.chunks:
        values = x.values
        wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
        at = np.frombuffer(values.buffers()[1], wide)[values.offset :]
        data = memoryview(values.buffers()[2] or b"")
        ends = at[np.asarray(x.offsets)]
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield bytes(data[a:z])


_codecs: dict[tuple, Codec] = {}


def codec(*key) -> Codec:
    """One codec per worker process and settings; workers are reused over tasks."""
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to about size bytes: more texts share a word's contraction."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def forget(*key) -> None:
    import gc

    old = _codecs.pop(key, None)
    if old:
        old.db.close()
        old.young, old.old = {}, {}
    del old
    gc.collect()
    release_memory()


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False,
    keep_codec: bool = True, cache_words: int = CACHE_WORDS, group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with ids also the ids, with decoded also the text decoded.

    keep_codec: workers keep tables and cache for their next task; without it they give the memory back, for jobs
    whose other stages need it. Smaller cache_words and group_chars cost time and save memory.
    """
    prepare(docs.sparkSession)
    key = (path, pattern, cache_words, group_chars)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*key)
        for b in gathered(batches, group_chars):
            n, ids_sha, text_sha, numbers, back = [], [], [], [np.zeros(0, np.int32)], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for line, own, raw in c.coded(texts):
                n.append(len(own))
                ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                text_sha.append(hashlib.sha256(raw).hexdigest())
                if ids:
                    numbers.append(own)
                if decoded:
                    back.append(raw.decode("utf-8", "replace"))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(numbers))))
            if decoded:
                cols.append(pa.array(back, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)
            release_memory()
        if not keep_codec:
            del c
            forget(*key)

    df = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return df.mapInArrow(run, schema).withColumnRenamed("id", id_col)
