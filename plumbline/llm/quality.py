"""Quality by weak supervision: rules vote, their accuracies are estimated without labels, the posterior decides.

Each rule reads counts of a text and votes good (1), bad (-1) or abstains (0). The votes of all documents are counted
by pattern, of which there are 3^rules at most whatever the corpus, and expectation-maximisation over the patterns
estimates the share of good documents and, for each rule, how often it is right about good and about bad ones. A
document is kept when the posterior probability that it is good is at least one half. Bad documents are of
many kinds and a rule knows but some, so it may be wrong about most of them; which of the two classes is good is fixed by
holding every rule at `FLOOR` or more on good documents, and no less ready to vote bad on bad documents than on good ones.

Plan: one pass counts in Arrow batches, whose results, without the texts, are written; votes and posteriors are native
columns over them, the pattern counts one aggregation with partial sums. The driver sees pattern counts only.

Defined cases: null and empty texts have no words, all counts 0 and fail; repeated rows count each time; extra columns
pass through, whatever their names: a result column whose name docs has already gets underscores behind it; rules
abstain on what they cannot measure; a document on which all rules abstain has the prior; without documents the
accuracies are those of the pseudo-counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, fresh, numbered_words, prepare, spread, text_buffer, written

#: Symbols that are counted, words of a window, and the limits that fail a text outright.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
#: Bytes that end a sentence.
ENDINGS = b".!?\"')"
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_upper", "n_worded", "n_top_word")

Rule = Callable[[Mapping[str, Column]], Column]


def _between(value: Column, good: Column, bad: Column, known: Column) -> Column:
    return F.when(known & good, F.lit(1)).when(known & bad, F.lit(-1)).otherwise(F.lit(0))


def _share(c: Mapping[str, Column], part: str, whole: str, good: int, bad: int, least: int = 1) -> Column:
    """Good while part is at most `good` hundredths of whole, bad while it is over `bad` (or the other way round, if good > bad)."""
    x, y = 100 * c[part], c[whole]
    up = good > bad
    return _between(x, x >= good * y if up else x <= good * y, x < bad * y if up else x > bad * y, y >= least)


#: Rules over the counts of a text; between the two limits of a rule it abstains.
RULES: dict[str, Rule] = {
    "long enough": lambda c: _between(c["n_words"], c["n_words"] >= 50, c["n_words"] < 25, F.lit(True)),
    "word length": lambda c: _between(c["word_chars"], c["word_chars"].between(3 * c["n_words"], 10 * c["n_words"]), ~c["word_chars"].between(2 * c["n_words"], 14 * c["n_words"]), c["n_words"] > 0),
    "few symbols": lambda c: _share(c, "n_symbols", "n_words", 3, 10),
    "few repeated lines": lambda c: _share(c, "n_dup_lines", "n_lines", 10, 30, least=3),
    "few repeated words": lambda c: _share(c, "n_repeat_words", "n_words", 8, 20),
    "words have letters": lambda c: _share(c, "n_worded", "n_words", 90, 80),
    "letters prevail": lambda c: _share(c, "n_letters", "word_chars", 85, 75),
    "few capitals": lambda c: _share(c, "n_upper", "n_letters", 15, 40),
    "no dominant word": lambda c: _share(c, "n_top_word", "n_words", 15, 30, least=20),
    "sentences end": lambda c: _share(c, "n_ended_lines", "n_lines", 60, 20, least=2),
}
#: Patterns that the driver may see: 3^rules.
MAX_RULES = 10
#: Steps of the estimation, its start, and bounds of accuracies.
STEPS, FLOOR, CEILING = 60, 0.6, 0.999
PRIOR, ON_GOOD, ON_BAD = 0.8, 0.9, 0.5
#: Pseudo-counts of (right, wrong) votes on good and on bad documents, and of (good, bad) documents.
SEEN_GOOD, SEEN_BAD, SEEN = (8.0, 2.0), (2.0, 2.0), (8.0, 2.0)


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SYMBOL, _ENDING = _table(SYMBOLS), _table(ENDINGS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123)))
_LETTER[0xC3:] = True  # first bytes of the letters past ASCII, one a letter
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False
_CHAR &= ~SPACE


def _by_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of marks between consecutive places."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _lines(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: lines with a word, of these the ones equal to an earlier one, and the ones that end a sentence."""
    n, breaks = len(offs) - 1, np.flatnonzero(data == 10)
    lo, hi = np.sort(np.concatenate((offs[:-1], breaks + 1))), np.sort(np.concatenate((breaks, offs[1:])))
    at = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(hi - lo, out=at[1:])
    same = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(at), pa.py_buffer(data[data != 10])).dictionary_encode()
    last = np.searchsorted(ends, hi, "right") - 1  # the last word that ends in the line, if it starts in it
    worded = np.flatnonzero((last >= 0) & (hi > lo))
    worded = worded[starts[last[worded]] >= lo[worded]]
    row = np.searchsorted(offs, lo[worded], "right") - 1
    ids = same.indices.to_numpy(zero_copy_only=False).astype(np.int64)[worded]
    distinct = np.unique(row * max(len(same.dictionary), 1) + ids) // max(len(same.dictionary), 1)
    lines = np.bincount(row, minlength=n)
    ended = _ENDING[data[ends[last[worded]] - 1]]
    return lines, lines - np.bincount(distinct, minlength=n), np.bincount(row[ended], minlength=n)


def _repeated(ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """By row: words in windows of WINDOW words that the row holds twice or more; windows are numbered by doubling, exactly."""
    code, size = ids, 1
    while size < WINDOW and len(code) > size:
        _, code = np.unique(code[:-size] * (code.max() + 1) + code[size:], return_inverse=True)
        size *= 2
    if size < WINDOW or not len(code):
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(row[: len(code)] == row[WINDOW - 1 :])
    _, number, times = np.unique(row[whole] * (code.max() + 1) + code[whole], return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    twice = whole[times[number] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def _counted(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTED by row."""
    n = len(offs) - 1
    ids, vocab, starts, ends = numbered_words(data, offs)
    row = np.searchsorted(offs, starts, "right") - 1
    lines, repeated_lines, ended = _lines(data, offs, starts, ends)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    pairs, times = np.unique(row * max(len(vocab), 1) + ids, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pairs // max(len(vocab), 1), times)
    return [
        np.bincount(row, minlength=n), _by_row(_CHAR[data], offs), _by_row(_SYMBOL[data], offs), repeated_lines, _repeated(ids, row, n), lines, ended,
        letters[offs[1:]] - letters[offs[:-1]], _by_row(_UPPER[data], offs), np.bincount(row[letters[ends] > letters[starts]], minlength=n), top,
    ]


def text_counts(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given), and behind them _counts, a struct of COUNTED."""
    prepare(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else tuple(keep)
    rows = spread(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in chunks(offs):
                found = _counted(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                counts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=list(COUNTED))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], counts], names=[*b.schema.names[:-1], "counts"])

    kinds = [f"`c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = rows.mapInArrow(work, ", ".join([*kinds, f"counts struct<{','.join(f'{c}:long' for c in COUNTED)}>"]))
    return out.toDF(*keep, fresh(docs, "_counts"))


@dataclass(frozen=True)
class Model:
    """The share of good documents, and each rule's share of right votes on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[float], list[float]]:
        """Log-odds of the prior, of a vote for good and of one for bad."""
        return (
            math.log(self.prior / (1 - self.prior)), [math.log(a / (1 - b)) for a, b in zip(self.on_good, self.on_bad, strict=True)],
            [math.log((1 - a) / b) for a, b in zip(self.on_good, self.on_bad, strict=True)],
        )


def estimate(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, steps: int = STEPS) -> Model:
    """Expectation-maximisation over (votes, documents) pairs, in the order of the votes."""
    table = sorted((tuple(v), n) for v, n in patterns)
    votes, n = np.array([v for v, _ in table], float).reshape(len(table), n_rules), np.array([x for _, x in table], float)
    model = Model(PRIOR, (ON_GOOD,) * n_rules, (ON_BAD,) * n_rules)
    for _ in range(steps):
        b, up, down = model.weights()
        odds = b + (votes > 0) @ np.array(up) + (votes < 0) @ np.array(down)
        good = n / (1 + np.exp(-odds))
        bad = n - good
        share = lambda seen, of, sign: (seen[0] + of @ (votes == sign)) / (sum(seen) + of @ (votes != 0))
        on_good = np.clip(share(SEEN_GOOD, good, 1), FLOOR, CEILING)
        on_bad = np.clip(share(SEEN_BAD, bad, -1), 1 - on_good, CEILING)
        model = Model(float((SEEN[0] + good.sum()) / (sum(SEEN) + n.sum())), tuple(on_good.tolist()), tuple(on_bad.tolist()))
    return model


def posterior(votes: Sequence[Column], model: Model) -> Column:
    """The probability of a good document, as a native column."""
    b, up, down = model.weights()
    odds = sum((F.when(v > 0, F.lit(u)).when(v < 0, F.lit(d)).otherwise(F.lit(0.0)) for v, u, d in zip(votes, up, down, strict=True)), F.lit(b))
    return 1 / (1 + F.exp(-odds))


def base_failed(c: Mapping[str, Column]) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def judge_quality(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given), and behind them _counts, _votes, _posterior, _base_failed and _kept."""
    rules = RULES if rules is None else rules
    if not 0 < len(rules) <= MAX_RULES:
        raise ValueError(f"1 to {MAX_RULES} rules are needed")
    keep = tuple(docs.columns) if keep is None else tuple(keep)
    counts, votes, chance, failed, kept = (fresh(docs, c) for c in ("_counts", "_votes", "_posterior", "_base_failed", "_kept"))
    found = written(text_counts(docs, text_col, keep), "quality")
    c = {name: F.col(counts)[name] for name in COUNTED}
    found = found.withColumn(votes, F.array(*[r(c) for r in rules.values()]))
    seen = found.groupBy(votes).count().collect()  # 3^rules rows at most
    model = estimate([(r[0], r[1]) for r in seen], len(rules))
    out = found.withColumn(chance, posterior([F.col(votes)[i] for i in range(len(rules))], model)).withColumn(failed, base_failed(c))
    return out.withColumn(kept, ~F.col(failed) & (F.col(chance) >= 0.5))
