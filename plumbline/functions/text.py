"""Scalar text and number functions as native columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The interior edges of ten equal bins as doubles of 0, 0.1, ... 1 stepped by one division.
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
#: Words that normalisation removes.
ARTICLES = "a|an|the"
FALLBACK_LABEL = "N/A"
#: Unicode's white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    c = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    c = F.regexp_replace(c, rf"(?U)\b({ARTICLES})\b", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def common_words(p: Column, t: Column) -> Column:
    """Size of the intersection of two word arrays as multisets: one fold over both, sorted together."""
    marked = lambda xs, one: F.transform(xs, lambda w: F.struct(w.alias("w"), F.lit(one).alias("p")))
    state = lambda w, a, b, same: F.struct(w.alias("w"), a.alias("a"), b.alias("b"), same.alias("same"))
    closed = lambda s: s["same"] + F.least(s["a"], s["b"])

    def step(s: Column, x: Column) -> Column:
        again = state(s["w"], s["a"] + x["p"], s["b"] + 1 - x["p"], s["same"])
        return F.when(s["w"] == x["w"], again).otherwise(state(x["w"], x["p"], 1 - x["p"], closed(s)))

    return F.aggregate(F.array_sort(F.concat(marked(p, 1), marked(t, 0))), state(F.lit(""), F.lit(0), F.lit(0), F.lit(0)), step, closed)


def token_f1_of(p: Column, t: Column) -> Column:
    """F1 of two word arrays as multisets; 0 if either is empty."""

    def score(x: Column) -> Column:
        n, m = F.size(x["p"]).cast("double"), F.size(x["t"]).cast("double")
        same = common_words(x["p"], x["t"]).cast("double")
        return let(same, lambda k: F.when(k == 0, F.lit(0.0)).otherwise(2 * (k / n) * (k / m) / (k / n + k / m)))

    return let(F.struct(p.alias("p"), t.alias("t")), score)


def token_f1(prediction: Column, truth: Column) -> Column:
    return token_f1_of(words(normalize(prediction)), words(normalize(truth)))


def same_answer(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def judge(prediction: Column, truths: Column, threshold: float = 0.8) -> Column:
    """Whether a truth is contained in the prediction (case and outer space aside) or has an F1 of the threshold.

    Null and empty predictions and empty lists of truths are wrong; "N/A" is no truth; an empty truth is contained
    in everything.
    """

    def hit(x: Column) -> Column:
        near = lambda t: token_f1_of(x["toks"], words(normalize(t))) >= threshold
        return F.exists(truths, lambda t: (t != FALLBACK_LABEL) & (x["low"].contains(F.lower(strip(t))) | near(t)))

    said = F.struct(F.lower(strip(prediction)).alias("low"), words(normalize(prediction)).alias("toks"))
    return F.coalesce((prediction != "") & let(said, hit), F.lit(False))


def judge_bool(prediction: Column, truth: Column) -> Column:
    """A yes/no truth given as a list's first element: "yes" anywhere says yes, else "no" anywhere says no."""
    low = F.lower(strip(prediction))
    said = F.when(low.contains("yes"), F.lit(True)).when(low.contains("no"), F.lit(False))
    return F.coalesce((prediction != "") & (said == truth), F.lit(False))


def best_f1(prediction: Column, truths: Column) -> Column:
    """The judge's score form: the best F1 over the truths."""
    best = let(words(normalize(prediction)), lambda p: F.array_max(F.transform(truths, lambda t: token_f1_of(p, words(normalize(t))))))
    return F.coalesce(best, F.lit(0.0))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _clamp(c: Column, top: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(top)))


def confidence_unit(c: Column) -> Column:
    """0 to 1 for calibration error and means: percent signs go, what is over 1 is in percent; null if no number."""
    x = _number(F.replace(strip(c), F.lit("%"), F.lit("")))
    return _clamp(F.when(x > 1, x / F.lit(100.0)).otherwise(x), 1.0)


def confidence_percent(c: Column) -> Column:
    """0 to 100 for reliability bins: what is at most 1 is a share; null if no number."""
    x = _number(F.replace(strip(c), F.lit("%"), F.lit("")))
    return _clamp(F.when(x > 1, F.least(x, F.lit(100.0))).otherwise(x * F.lit(100.0)), 100.0)


def confidence_rank(c: Column) -> Column:
    """0 to 1 for ranking metrics: always read as percent; 0 if there is no number."""
    x = _number(F.regexp_replace(strip(c), r"^%+|%+$", ""))
    return F.coalesce(_clamp(x / F.lit(100.0), 1.0), F.lit(0.0))


def confidence_words(c: Column) -> Column:
    """The first signed decimal in a text, else high 90, medium or moderate 50, low 10, else 0."""
    number = F.regexp_substr(c, F.lit(r"-?\d+(?:\.\d+)?")).try_cast("double")
    low = F.lower(c)
    said = (
        F.when(low.contains("high") & ~low.contains("low"), F.lit(90.0))
        .when(low.contains("medium") | low.contains("moderate"), F.lit(50.0))
        .when(low.contains("low"), F.lit(10.0))
    )
    return F.coalesce(number, said, F.lit(0.0))


def calibration_bin(unit: Column) -> Column:
    """0 to 9: how many interior edges are at most the value."""
    return sum(((unit >= F.lit(e)).cast("int") for e in BIN_EDGES[1:]), (unit >= F.lit(BIN_EDGES[0])).cast("int"))


def reliability_bin(percent: Column) -> Column:
    return F.when(percent.isNotNull(), F.least(F.floor(percent / F.lit(10.0)), F.lit(9)).cast("int"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"), lambda x: strip(x) != ""))


def word_range(n: Column) -> Column:
    """Twenty words either way, within 10 to 220, in tens rounded half to even."""
    low, high = n - 20, n + 20
    high = F.when(low < 10, F.lit(50)).otherwise(high)
    low = F.greatest(low, F.lit(10))
    low = F.when(high > 220, F.greatest(F.lit(10), F.lit(180))).otherwise(low)
    tens = lambda x: (F.bround(x / F.lit(10.0)) * 10).cast("long").cast("string")
    return F.when(n > 0, F.concat(tens(low), F.lit("-"), tens(F.least(high, F.lit(220))))).otherwise(F.lit("10-50"))


def sentence_range(n: Column) -> Column:
    n = F.least(F.greatest(n, F.lit(1)), F.lit(8))
    return F.concat(F.greatest(n - 1, F.lit(1)).cast("string"), F.lit("-"), (n + 1).cast("string"))


def numbered_facts(facts: Column) -> Column:
    """"1. f" lines; a repeated fact has the number of its first place."""
    return F.array_join(F.transform(facts, lambda f: F.concat(F.array_position(facts, f).cast("string"), F.lit(". "), f)), "\n")


def training_facts(contents: Column) -> Column:
    """"1: text" with a blank line between."""
    lines = F.transform(contents, lambda f, i: F.concat((i + 1).cast("string"), F.lit(": "), F.coalesce(f, F.lit("")), F.lit("\n")))
    return F.array_join(lines, "\n")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template's {name} places filled in; what is filled in is never expanded again."""
    import re

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            if piece not in values:
                raise KeyError(f"the template needs {piece}")
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def ordered_union(columns: Sequence[Column], extra: Column | None = None) -> Column:
    """Answers of several arrays in order, without empty ones, "N/A" and repeats; extra keeps "N/A"."""
    none = F.array().cast("array<string>")
    all_ = F.filter(F.flatten(F.array(*[F.coalesce(c, none) for c in columns])), lambda x: x.isNotNull() & (x != "") & (x != FALLBACK_LABEL))
    if extra is not None:
        all_ = F.concat(all_, F.filter(F.coalesce(extra, none), lambda x: x.isNotNull() & (x != "")))
    return F.array_distinct(all_)


def evaluation_truths(answer: Column, gold: Column, gt: Column, consistent: Column) -> Column:
    """The first present of three answer fields; with a consistent answer that too, without repeats."""
    first = F.coalesce(answer, gold, gt)
    return F.when(consistent.isNull(), first).otherwise(F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), consistent)))


def first_filled(*arrays: Column) -> Column:
    """The first of several arrays that is neither null nor empty; the last one where none is."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], arrays[-1])


def draw(values: Column, k: int, key: Column, seed: int = 42) -> Column:
    """k places of an array drawn without repeats (all, if fewer), in the order of the draw.

    The draw is by md5 of key, place and seed: the same on any cluster and in SQL, another one for another key.
    """
    digest = lambda i: F.md5(F.concat_ws("-", key.cast("string"), i.cast("string"), F.lit(str(seed))))
    tickets = F.array_sort(F.transform(values, lambda x, i: F.struct(digest(i).alias("d"), i.alias("i"), x.alias("x"))))
    return F.transform(F.slice(tickets, 1, k), lambda t: t["x"])


def combinations(values: Column, k: int, most: int = 10_000) -> Column:
    """All choices of k places of an array in the order of the places; an error where there would be more than `most`."""
    if k < 0:
        raise ValueError("k must not be negative")
    n = F.size(values)
    count = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (n - k + i) / i) if k else F.lit(1.0)
    none = F.array(F.array().cast("array<int>"))

    def step(chosen: Column, i: Column) -> Column:
        """Choices so far, and with place i those that lack places, if enough places are left for the rest."""
        longer = F.transform(F.filter(chosen, lambda c: F.size(c) < k), lambda c: F.array_append(c, i))
        return F.filter(F.concat(chosen, longer), lambda c: F.size(c) + n - 1 - i >= k)

    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    full = F.array_sort(F.aggregate(places, none, step))
    picked = F.transform(full, lambda c: F.transform(c, lambda i: F.get(values, i)))
    too_many = F.raise_error(F.concat(F.lit("more combinations than "), F.lit(str(most))))
    return F.when((n >= k) & (count > most), too_many).when(n < k, F.slice(picked, 1, 0)).otherwise(picked)


def portion(part: Column, whole: Column) -> Column:
    """"c/t (p%)" with one decimal."""
    share = F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
    return F.format_string("%d/%d (%.1f%%)", part, whole, share)
