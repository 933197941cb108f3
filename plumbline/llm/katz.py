"""LM scoring by a word bigram model with Katz backoff.

Counts are Good-Turing discounted, and every backoff weight is normalised exactly:

    P(w | h) = d(c) c(h, w) / D(h)   where c(h, w) >= least
             = alpha(h) P(w)         otherwise,  alpha(h) = (1 - sum seen P(. | h)) / (1 - sum seen P(.))

With least = 1 every bigram seen counts (the registered query); with 2, those seen once only feed the backoff mass
(Katz's own economy). P(w) is discounted too, what is left is the unknown word's. D(h) is c(h), or half a count more than the discounted
mass where nothing would be left. A text is its words, then one end; its first history is a start.

Scores are evaluated by tables, partitioned by hash, never held whole anywhere:

    log P(text) = sum of log P(w) + sum of log alpha(h) + sum over seen bigrams of log P(w | h) / (alpha(h) P(w))

1. A pass over the training texts counts words and bigrams in chunks (map-side), partitions sum them.
2. Partitions of bigrams ask partitions of words for counts and weights; only distinct words of a partition travel.
3. SLICES passes, each over its share of all texts, send each distinct word and bigram of a chunk once, with the
   documents that hold it, to the partition that has its weight; sums by document come back and are written. So no
   more than a share of the postings is on disk at a time. Bigrams travel as pairs of words, not as hashes of pairs.
Words and bigrams that are more than a share of all tokens (heavy() of them at most: in step with the partitions, up
to HEAVY_MOST) are scored where the text is, so that no partition gathers a row from every document for one word.

Defined cases: null and empty texts are one end token; repeated rows have equal scores; with an empty training set
every word is unknown with probability 1; an empty table gives an empty result; null ids are kept and count as
training rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, drop, mix, prepare, release_memory, release_shuffles, spread, text_buffer, word_hashes, written

END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Tokens of a chunk; characters of text for each partition of the tables.
CHUNK_TOKENS, PART_CHARS = 1_600_000, 18_000_000
#: Words that travel as numbers, found in a sample of so many characters of text. This changes no result.
COMMON_WORDS, COMMON_CHARS = 65_536, 20_000_000
#: Bytes of payload in one Arrow batch.
OUT_BYTES = 1 << 20
#: Good-Turing discounts apply to counts up to this.
MAX_DISCOUNTED = 5
HEAVY_LEAST, HEAVY_MOST = 2_000, 200_000
#: Passes of the last phase, each over its share of the documents.
SLICES = 2
_MIXER = np.uint64(0xD1342543DE82EF95)


def heavy(parts: int) -> int:
    """How many words (and ten times as many bigrams, up to HEAVY_MOST) may be scored where the text is."""
    return min(HEAVY_MOST, max(HEAVY_LEAST, 4 * parts))


# --- packed columns -------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in the smallest types that hold them, compressed; sorted 64-bit hashes as gaps, byte by byte."""
    import struct

    import zstandard

    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        kind, raw = a.dtype.str.encode().ljust(4), a.tobytes
        if a.dtype == np.uint64 and len(a) > 1 and np.all(a[1:] >= a[:-1]):
            kind, raw = b"gaps", np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes
        out.append(struct.pack("<4sQ", kind, len(a)) + raw())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes) -> list[np.ndarray]:
    import struct

    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,), at, out = struct.unpack_from("<H", raw), 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, at)
        if kind == b"gaps":
            planes = np.frombuffer(raw, np.uint8, 8 * size, at + 12).reshape(8, -1)
            out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64))
            at += 12 + 8 * size
            continue
        kind = np.dtype(kind.decode().strip())
        out.append(np.frombuffer(raw, kind, size, at + 12))
        at += 12 + size * kind.itemsize
    return out


def fold(common: np.ndarray, words: np.ndarray, *arrays: np.ndarray) -> bytes:
    """pack of sorted words and further arrays; words in the sorted array common go as their positions in it."""
    at = np.minimum(np.searchsorted(common, words), max(len(common) - 1, 0))
    hit = common[at] == words if len(common) else np.zeros(len(words), bool)
    return pack(at[hit].astype(np.uint64), words[~hit], *arrays)


def unfold(common: np.ndarray, raw: bytes) -> list[np.ndarray]:
    at, rest, *arrays = unpack(raw)
    return [np.sort(np.concatenate([common[at.astype(np.int64)], rest])), *arrays]


def joined(words: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sorted bigrams over these words as one ascending number each, which pack stores as gaps."""
    return (h.astype(np.int64) * len(words) + w).astype(np.uint64)


def split(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(pairs.astype(np.int64), max(len(words), 1))


# --- tokens of a chunk ----------------------------------------------------------------------------------------


class Chunk:
    """Distinct words and bigrams of some texts, with the documents they occur in."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray):
        n_docs = len(ends)
        sizes = np.diff(ends, prepend=0)
        self.sizes = sizes
        self.doc = np.repeat(np.arange(n_docs, dtype=np.int32), sizes)
        self.words, idx = np.unique(np.concatenate([tokens, np.array([START])]), return_inverse=True)
        idx = idx.astype(np.int32)
        self.tok, start = idx[:-1], idx[-1]
        hist = np.empty_like(self.tok)
        hist[1:] = self.tok[:-1]
        hist[ends - sizes] = start
        n = len(self.words)
        pairs, pair_of = np.unique(hist.astype(np.int64) * n + self.tok, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        self.h, self.w = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)

    def word_parts(self, parts: int) -> np.ndarray:
        return part_of(self.words, parts)

    def pair_parts(self, parts: int) -> np.ndarray:
        return part_of(mix(self.words[self.h] * _MIXER + self.words[self.w]), parts)

    def refs(self, key: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, doc, count): for each key the documents that hold it, as slices first[k]:first[k + 1]."""
        n_docs = max(len(self.sizes), 1)
        code, count = np.unique(key.astype(np.int64) * n_docs + self.doc, return_counts=True)
        return np.searchsorted(code, np.arange(n_keys + 1) * n_docs), (code % n_docs).astype(np.int32), count.astype(np.int32)


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the payload, in Arrow batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
    release_memory()


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def by_part(parts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the positions that belong to it, in order."""
    order = np.argsort(parts, kind="stable")
    first = np.searchsorted(parts[order], np.arange(n + 1))
    for p in range(n):
        if first[p] < first[p + 1]:
            yield p, order[first[p] : first[p + 1]]


def positions(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the slices first to first + size, one slice after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def local(words: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that these bigrams use, and the bigrams over them."""
    used = np.zeros(len(words), bool)
    used[h] = used[w] = True
    at = np.cumsum(used) - 1
    return words[used], at[h], at[w]


def token_chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(tokens, ends by document, first column's values) of about CHUNK_TOKENS tokens each."""
    toks, sizes, ids, total = [], [], [], 0
    for b in batches:
        data, offs = text_buffer(b.column(text_at))
        names = b.column(0).to_pylist()
        for lo, hi in chunks(offs):
            words, at = word_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            n = np.diff(at)
            tok = np.full(len(words) + len(n), END, np.uint64)
            tok[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
            toks.append(tok)
            sizes.append(n + 1)
            ids += names[lo:hi]
            total += len(tok)
            if total >= CHUNK_TOKENS:
                yield np.concatenate(toks), np.cumsum(np.concatenate(sizes)), ids
                toks, sizes, ids, total = [], [], [], 0
    if toks:
        yield np.concatenate(toks), np.cumsum(np.concatenate(sizes)), ids


# --- discounts ------------------------------------------------------------------------------------------------


def discounts(n: list[int], least: int) -> np.ndarray:
    """Good-Turing factors d[c] for c up to MAX_DISCOUNTED, 0 below least; beyond it is 1. n[r]: types seen r times."""
    k = MAX_DISCOUNTED
    d = np.ones(k + 1)
    d[:least] = 0
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for r in range(least, k + 1):
        if n[r] and n[r + 1] and tail < 1:
            x = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail)
            d[r] = x if 0.05 < x < 1 else 1 - 0.5 / r
        else:
            d[r] = 1 - 0.5 / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= MAX_DISCOUNTED, d[np.minimum(c, MAX_DISCOUNTED).astype(np.int64)], 1.0)


class Stats:
    """Sums over all partitions: what discounts and base scores need."""

    def __init__(self, rows: list, least: int):
        zero = [0] * 9
        words, pairs = (list(next((r["s"] for r in rows if r["kind"] == k), None) or zero) for k in (0, 1))
        self.tokens, self.types, self.texts = words[7], words[0], words[8]
        self.d1, self.d2 = discounts(words, 1), discounts(pairs, least)
        mass = words[7] - sum((1 - self.d1[r]) * r * words[r] for r in range(1, MAX_DISCOUNTED + 1))
        self.scale = max(self.tokens, mass + 0.5)
        self.unknown = np.log10(1 - mass / self.scale)

    def log_p1(self, c: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10(discounted(c, self.d1) / self.scale), self.unknown)

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def spectrum(c: np.ndarray) -> list[int]:
    """[types, n_1 .. n_6, total] of counts."""
    n = np.bincount(np.minimum(c, MAX_DISCOUNTED + 2).astype(np.int64), minlength=MAX_DISCOUNTED + 3)
    return [len(c), *map(int, n[1 : MAX_DISCOUNTED + 2]), int(c.sum())]


# --- the three phases -----------------------------------------------------------------------------------------


def _common(train: DataFrame, chars: int) -> np.ndarray:
    """Up to COMMON_WORDS frequent words of a bounded sample, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _, _ in token_chunks(batches, 1):
            words, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    drawn = F.pmod(F.xxhash64("id", F.octet_length("t")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = train.where(drawn < COMMON_CHARS / max(chars, COMMON_CHARS)).select("id", "t").mapInArrow(run, "w long, n long")
    top = some.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON_WORDS).select("w").toArrow()
    return np.sort(top.column("w").to_numpy().astype(np.int64).view(np.uint64))


def _count(train: DataFrame, common: np.ndarray, parts: int, least: int) -> DataFrame:
    """Rows (part, kind, payload, stats): of kind 0 words and counts, of kind 1 bigrams seen at least `least` times."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, ends, _ in token_chunks(batches, 1):
            yield from in_batches(counted_rows(Chunk(tokens, ends)), pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]))

    def counted_rows(c: Chunk) -> Iterator[tuple]:
        n = np.bincount(c.tok, minlength=len(c.words))
        for p, at in by_part(c.word_parts(parts), parts):
            at = at[n[at] > 0]
            yield p, 0, fold(common, c.words[at], n[at])
        n = np.bincount(c.pair_of, minlength=len(c.h))
        for p, at in by_part(c.pair_parts(parts), parts):
            words, h, w = local(c.words, c.h[at], c.w[at])
            yield p, 1, fold(common, words, joined(words, h, w), n[at])

    def summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        got = [unfold(common, x) for x in rows.column("payload").to_pylist()]
        if key[1].as_py() == 0:
            words, inv = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
            out, stats = pack(words, n), [*spectrum(n), int(n[words == END].sum())]
        else:
            words = np.unique(np.concatenate([g[0] for g in got]))
            code = []
            for g in got:
                at, (h, w) = np.searchsorted(words, g[0]), split(*g[:2])
                code.append(at[h] * len(words) + at[w])
            code, inv = np.unique(np.concatenate(code), return_inverse=True)
            n = np.bincount(inv, np.concatenate([g[2] for g in got]), len(code)).astype(np.int64)
            stats = [*spectrum(n), 0]
            code, n = code[n >= least], n[n >= least]
            words, h, w = local(words, code // len(words), code % len(words))
            out = pack(words, joined(words, h, w), n)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([out], pa.binary()), "stats": pa.array([stats], pa.list_(pa.int64()))})

    blocks = train.select("id", "t").mapInArrow(chunked, "part int, kind int, payload binary")
    return blocks.groupBy("part", "kind").applyInArrow(summed, "part int, kind int, payload binary, stats array<long>")


def _table(part: list, to: list, payload: list) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int32()), "asks": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary())})


_ASK = "part int, asks int, payload binary"


def _weights(counted: DataFrame, st: Stats, parts: int) -> tuple[DataFrame, DataFrame]:
    """Word rows (part, payload: words, counts, log alpha) and bigram rows (part, payload: words, h and w, c, and by
    word what gains() needs: its count, and as a history -log(total) - log alpha)."""
    words, pairs = (counted.where(F.col("kind") == k).select("part", "payload") for k in (0, 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, asks, payload = [], [], []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = unpack(raw)[0]
                for q, at in by_part(part_of(own, parts), parts):
                    part.append(q), asks.append(p), payload.append(pack(own[at]))
            yield from _table(part, asks, payload).combine_chunks().to_batches()

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        own, n = unpack(left.column("payload")[0].as_py()) if left.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out = []
        for raw in right.column("payload").to_pylist():
            asked = unpack(raw)[0]
            out.append(pack(asked, lookup(own, n, asked, 0)))
        return _table(right.column("asks").to_pylist(), right.column("part").to_pylist(), out)

    counts = written(words.groupBy("part").cogroup(pairs.mapInArrow(ask, _ASK).groupBy("part")).applyInArrow(reply, _ASK), "counts")
    release_shuffles(counted.sparkSession)

    def masses(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each history in this partition of bigrams: discounted mass and P(.) of the words seen after it."""
        if not left.num_rows:
            return _table([], [], [])
        own, h, w, c = _bigrams(left)
        p1 = 10.0 ** st.log_p1(_gather(own, right))
        a = np.bincount(h, discounted(c, st.d2), len(own))
        s = np.bincount(h, p1[w], len(own))
        some = np.flatnonzero(a > 0)
        out = [(q, pack(own[some[at]], a[some[at]], s[some[at]])) for q, at in by_part(part_of(own[some], parts), parts)]
        return _table([q for q, _ in out], [left.column("part")[0].as_py()] * len(out), [x for _, x in out])

    sums = pairs.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(masses, _ASK)

    def alphas(left: pa.Table, right: pa.Table) -> pa.Table:
        """Backoff weights of the words of this partition, whole and for each partition that asked."""
        own, n = unpack(left.column("payload")[0].as_py()) if left.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        got = [unpack(x) for x in right.column("payload").to_pylist()]
        hist, inv = np.unique(np.concatenate([np.zeros(0, np.uint64), *[g[0] for g in got]]), return_inverse=True)
        a = np.bincount(inv, np.concatenate([np.zeros(0), *[g[1] for g in got]]), len(hist))
        s = np.bincount(inv, np.concatenate([np.zeros(0), *[g[2] for g in got]]), len(hist))
        c = np.where(hist == START, st.texts, lookup(own, n, hist, 0))
        total = np.maximum(c, a + 0.5)
        log_a = np.log10((1 - a / total) / np.maximum(1 - s, 1e-300))
        part, asks, out = [], [], []
        for p, g in zip(right.column("asks").to_pylist(), got, strict=True):
            at = np.searchsorted(hist, g[0])
            part.append(p), asks.append(-1), out.append(pack(g[0], -np.log10(total[at]) - log_a[at]))
        q = left.column("part")[0].as_py() if left.num_rows else right.column("part")[0].as_py()
        every = np.union1d(own, hist)
        part.append(q), asks.append(-2), out.append(pack(every, lookup(own, n, every, 0), lookup(hist, log_a, every, 0.0)))
        return _table(part, asks, out)

    weights = written(words.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(alphas, _ASK), "weights")
    release_shuffles(counted.sparkSession)

    def histories(left: pa.Table, right: pa.Table) -> pa.Table:
        """Bigrams with what their words have: by word, as that is far less than a gain for each bigram."""
        if not left.num_rows:
            return _table([], [], [])
        own, pair, c = unpack(left.column("payload")[0].as_py())
        kind = np.array(right.column("asks").to_pylist())
        n = _gather(own, right.filter(pa.array(kind >= 0)))
        back = right.filter(pa.array(kind < 0))
        return _table([left.column("part")[0].as_py()], [0], [pack(own, pair, c, n, _gather(own, back, 0.0))])

    right = counts.unionByName(weights.where("asks = -1")).groupBy("part")
    pair_rows = written(pairs.groupBy("part").cogroup(right).applyInArrow(histories, _ASK).select("part", "payload"), "gains")
    word_rows = written(weights.where("asks = -2").select("part", "payload"), "words")
    drop(counts, weights)
    return word_rows, pair_rows


def lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, none) -> np.ndarray:
    """values at asked in sorted keys, none where there is no such key."""
    if not len(keys):
        return np.full(len(asked), none)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], none)


def _bigrams(rows: pa.Table) -> tuple[np.ndarray, ...]:
    own, pair, c = unpack(rows.column("payload")[0].as_py())
    return own, *split(own, pair), c


def gains(g: list[np.ndarray], st: Stats) -> tuple[np.ndarray, ...]:
    """(history, word, count, gain) of the bigrams of one row: what a seen bigram's log probability has over its backoff."""
    own, pair, c, n, over = g
    h, w = split(own, pair)
    return own[h], own[w], c, np.log10(discounted(c, st.d2)) + over[h] - st.log_p1(n)[w]


def _gather(own: np.ndarray, rows: pa.Table, none=0, column: int = 1) -> np.ndarray:
    """One column of all replies, in the order of own words."""
    got = [unpack(x) for x in rows.column("payload").to_pylist()]
    if not got:
        return np.full(len(own), none)
    keys = np.concatenate([g[0] for g in got])
    order = np.argsort(keys)
    return lookup(keys[order], np.concatenate([g[column] for g in got])[order], own, none)


def _heavy(rows: DataFrame, least: float, st: Stats | None = None) -> list[np.ndarray]:
    """Entries of the tables (of bigrams, if there are stats) counted at least `least` times: at most tokens / least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(0).to_pylist():
                g = unpack(raw)
                if st:
                    h, w, c, gain = gains(g, st)
                    keep = c >= least
                    out.append(pack(h[keep], w[keep], gain[keep]))
                else:
                    keep = (g[1] >= least) | (g[0] == START)
                    out.append(pack(g[0][keep], g[1][keep], g[2][keep]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["payload"])

    got = [unpack(r["payload"]) for r in rows.select("payload").mapInArrow(run, "payload binary").collect()]
    kinds = (np.uint64, np.uint64, np.float64) if st else (np.uint64, np.int64, np.float64)
    return [np.concatenate([np.zeros(0, k), *[g[i] for g in got]]) for i, k in enumerate(kinds)]


class Heavy:
    """What is scored where the text is: frequent words and bigrams, sorted, with their weights."""

    def __init__(self, words: DataFrame, pairs: DataFrame, st: Stats, parts: int):
        got = _heavy(words, max(1, st.tokens / heavy(parts)))
        order = np.argsort(got[0])
        self.words, self.count, self.log_a = (x[order] for x in got)
        h, w, gain = _heavy(pairs, max(2, st.tokens / min(HEAVY_MOST, 10 * heavy(parts))), st)
        order = np.lexsort((w, h))
        self.own = np.unique(np.concatenate([h, w]))
        self.pairs, self.gain = joined(self.own, np.searchsorted(self.own, h[order]), np.searchsorted(self.own, w[order])), gain[order]
        self.start_alpha = float(lookup(self.words, self.log_a, np.array([START]), 0.0)[0])


def pair_at(own: np.ndarray, words: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bigrams over words as numbers over own words; of bigrams with other words a number that none has."""
    at = lookup(own, np.arange(len(own)), words, -1).astype(np.int64)
    return np.where((at[h] >= 0) & (at[w] >= 0), at[h] * len(own) + at[w], len(own) ** 2).astype(np.uint64)


def _score(docs: DataFrame, words: DataFrame, pairs: DataFrame, st: Stats, hot: Heavy, common: np.ndarray, parts: int) -> DataFrame:
    def word_values(c: np.ndarray, log_a: np.ndarray) -> list[np.ndarray]:
        return [st.log_base(c), (c > 0).astype(np.float64), st.log_p1(c) + log_a]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        kinds = [("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())]
        for tokens, ends, ids in token_chunks(batches, 1):
            yield from in_batches(((p, k, chunk, len(ids), x) for p, k, x in scored_rows(Chunk(tokens, ends), ids, chunk)), pa.schema(kinds))
            chunk += 1

    def scored_rows(c: Chunk, ids: list, chunk: int) -> Iterator[tuple]:
        n_docs = len(ids)
        first, doc, count = c.refs(c.tok, len(c.words))
        known = lookup(hot.words, np.ones(len(hot.words), bool), c.words, False) & (c.words != START)
        size = np.diff(first)
        key = np.repeat(np.arange(len(c.words), dtype=np.int32), size)
        at = known[key]
        values = word_values(lookup(hot.words, hot.count, c.words, 0), lookup(hot.words, hot.log_a, c.words, 0.0))
        sums = [np.bincount(doc[at], count[at] * v[key[at]], n_docs) for v in values]
        del key, at
        for p, own in by_part(c.word_parts(parts), parts):
            own = own[~known[own] & (size[own] > 0)]
            if len(own):
                at = positions(first[own], size[own])
                yield p, 0, fold(common, c.words[own], size[own], doc[at], count[at])
        first, doc, count = c.refs(c.pair_of, len(c.h))
        code = pair_at(hot.own, c.words, c.h, c.w)
        known = lookup(hot.pairs, np.ones(len(hot.pairs), bool), code, False)
        size = np.diff(first)
        key = np.repeat(np.arange(len(c.h), dtype=np.int32), size)
        at = known[key]
        gain = np.bincount(doc[at], count[at] * lookup(hot.pairs, hot.gain, code, 0.0)[key[at]], n_docs)
        sums[2] = sums[2] + gain + hot.start_alpha
        del key, at, code
        for p, own in by_part(c.pair_parts(parts), parts):
            own = own[~known[own]]
            if len(own):
                at = positions(first[own], size[own])
                some, h, w = local(c.words, c.h[own], c.w[own])
                yield p, 1, fold(common, some, joined(some, h, w), size[own], doc[at], count[at])
        fine = np.array([i is not None for i in ids])
        yield -1 - chunk % parts, 2, pack(fine, np.array([i or 0 for i in ids], np.int64).view(np.uint64), c.sizes, *sums)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, payload = left.column("chunk").to_pylist(), []
        model = unpack(right.column("payload")[0].as_py()) if right.num_rows else None
        kind = left.column("kind")[0].as_py() if left.num_rows else None
        if model and kind == 1:
            own, table = model[0], (model[1], gains(model, st)[3])
        for n_docs, raw in zip(left.column("n").to_pylist(), left.column("payload").to_pylist(), strict=True):
            got = unpack(raw) if kind == 2 else unfold(common, raw)
            if kind == 0:
                c, log_a = (lookup(model[0], model[i], got[0], 0) for i in (1, 2)) if model else (np.zeros(len(got[0])),) * 2
                key = np.repeat(np.arange(len(got[0])), got[1])
                payload.append(pack(*[np.bincount(got[2], got[3] * v[key], n_docs) for v in word_values(c, log_a)]))
            elif kind == 1:
                gain = lookup(*table, pair_at(own, got[0], *split(*got[:2])), 0.0) if model else np.zeros(len(got[1]))
                payload.append(pack(np.bincount(got[3], got[4] * np.repeat(gain, got[2]), n_docs)))
            else:
                payload.append(raw)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array([kind] * len(chunk), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        base = known = score = head = 0
        for kind, raw in zip(rows.column("kind").to_pylist(), rows.column("payload").to_pylist(), strict=True):
            got = unpack(raw)
            if kind == 2:
                head, got = got[:3], got[3:]
            if kind != 1:
                base, known, score = base + got[0], known + got[1], score + got[2]
            else:
                score = score + got[0]
        ids = pa.array(head[1].view(np.int64), mask=~head[0].astype(bool))
        n = len(head[1])
        return pa.table({"id": ids, "n_tokens": head[2].astype(np.int64), "n_known": np.rint(known).astype(np.int64), "train_tokens": np.full(n, st.tokens, np.int64), "base_score": base, "score": score})

    blocks = docs.select("id", "t").mapInArrow(chunked, "part int, kind int, chunk long, n int, payload binary")
    model = words.select("part", F.lit(0).alias("kind"), "payload").unionByName(pairs.select("part", F.lit(1).alias("kind"), "payload"))
    sums = blocks.groupBy("part", "kind").cogroup(model.groupBy("part", "kind")).applyInArrow(summed, "chunk long, kind int, payload binary")
    return sums.groupBy("chunk").applyInArrow(finish, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] | None = (5, 1), least: int = 2) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score, both log10; learns from the rows whose
    crc32(id as text) mod n is not r, holdout being (n, r). Bigrams seen fewer than `least` times count as not seen."""
    prepare(docs.sparkSession)
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")))
    train = rows.where(F.coalesce(crc_mod("id", holdout[0]) != holdout[1], F.lit(True))) if holdout else rows
    chars = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(4, -(-chars // PART_CHARS))
    common = _common(train, chars)
    counted = written(_count(train, common, parts, least), "counted")
    sums = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(9)]
    st = Stats(counted.groupBy("kind").agg(*sums).select("kind", F.array(*[f"s{i}" for i in range(9)]).alias("s")).collect(), least)
    release_shuffles(docs.sparkSession)
    words, pairs = _weights(counted, st, parts)
    drop(counted)
    release_shuffles(docs.sparkSession)
    hot, done = Heavy(words, pairs, st, parts), []
    for k in range(SLICES):
        some = rows.where(F.pmod(F.xxhash64("id", F.octet_length("t")), F.lit(SLICES)) == k)
        done.append(written(_score(some, words, pairs, st, hot, common, parts), "scores"))
        release_shuffles(docs.sparkSession)
    drop(words, pairs)
    return functools.reduce(DataFrame.unionByName, done).withColumnRenamed("id", id_col)
