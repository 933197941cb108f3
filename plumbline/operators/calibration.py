"""All metrics of a table from one pass: a mergeable state of sums by group and confidence.

The state has one row for each group of keys and each distinct reading of the confidences, so it is small beside the
table, partial sums shrink it before the shuffle, and every metric follows from it: shares and means by sums, binned
ones by sums of a bin, ranking ones by sums over the order of the scores. States of several data sets add up: `merged`
takes them together by grouping sets, without reading the rows again.

Ranking metrics of a group use windows of the group. Without keys there is one group; its scores are then cut into
`SLOTS` ranges, sums run within each range, and each range's start is joined back to it, so that no task sees all.
A range is a part of the interval from 0 to 1, not of the rows: confidences that all differ by less than that share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T

GROUPS = ("counterfactual", "consistent", "relevant_irrelevant")
#: What a state is grouped by besides its keys, and what it sums: rows, rows with an answer, judged and correct rows,
#: labels said, passages with a known label, and labels that are right.
DIMENSIONS = ("grp", "unit", "percent", "rank")
SUMS = ("n", "valid", "judged", "hits", "said", "known", "right")
SLOTS = 1024
NAN = float("nan")


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def state(
    df: DataFrame, keys: Sequence[str], correct: Column | None = None, confidence: Column | None = None, answer: Column | None = None, group: Column | None = None,
    types: Column | None = None, labels: Sequence[Column] = (),
) -> DataFrame:
    """Rows (keys, DIMENSIONS, SUMS). What is not given counts as missing; labels need types to be right or wrong."""
    none = lambda kind: F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    conf = none("string") if confidence is None else confidence.cast("string")
    right = none("boolean") if correct is None else correct.cast("boolean")
    one = {
        "grp": none("string") if group is None else group, "unit": T.confidence_unit(conf), "percent": T.confidence_percent(conf), "rank": T.confidence_rank(conf),
        "n": F.lit(1).cast("long"), "valid": F.lit(0).cast("long") if answer is None else flag(answer != ""), "judged": right.isNotNull().cast("long"), "hits": flag(right),
        "said": sum((flag(c != "") for c in labels), F.lit(0).cast("long")), "known": F.lit(0).cast("long"), "right": F.lit(0).cast("long"),
    }
    if types is not None and labels:
        pairs = label_pairs(types, labels)
        one["known"] = F.size(pairs).cast("long")
        one["right"] = F.size(F.filter(pairs, lambda p: F.coalesce(p["expected"] == p["predicted"], F.lit(False)))).cast("long")
    rows = df.select(*keys, *[c.alias(name) for name, c in one.items()])
    return rows.groupBy(*keys, *DIMENSIONS).agg(*[F.sum(c).alias(c) for c in SUMS])


def standard_state(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of a table with the standard columns: correct, and answer, confidence, types, passage_1_label to passage_3_label where it has them."""
    got = lambda c: F.col(c) if c in df.columns else None
    types = got("types")
    labels = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in (f"passage_{i}_label" for i in (1, 2, 3))]
    group = None if types is None else L.evaluation_group(types)
    return state(df, keys, got("correct"), got("confidence"), got("answer"), group, types, labels)


def merged(states: DataFrame, keys: Sequence[str], over: Sequence[str]) -> DataFrame:
    """The state, and with `merged` true the state with the keys `over` taken together (null in these rows)."""
    whole = [*keys, *DIMENSIONS]
    sets = [[F.col(c) for c in whole], [F.col(c) for c in whole if c not in over]]
    sums = [F.sum(c).alias(c) for c in SUMS]
    return states.groupingSets(sets, *[F.col(c) for c in whole]).agg((F.grouping(over[0]) == 1).alias("merged"), *sums)


def label_pairs(types: Column, predicted: Sequence[Column]) -> Column:
    """An array of (pos, expected, predicted), in comparable form, of the passages with a known expected label."""
    expected = F.transform(types, lambda t: L.comparable_label(L.expected_label(t, fold=True)))
    zipped = F.arrays_zip(expected.alias("e"), F.array(*[L.comparable_label(c) for c in predicted]).alias("p"))
    said = lambda p: F.nullif(F.btrim(F.btrim(p, F.lit("#"))), F.lit(""))
    pairs = F.transform(zipped, lambda x, i: F.struct((i + 1).alias("pos"), x["e"].alias("expected"), said(x["p"]).alias("predicted")))
    return F.coalesce(F.filter(pairs, lambda x: x["expected"].isNotNull()), F.array().cast("array<struct<pos:int,expected:string,predicted:string>>"))


def ranked(states: DataFrame, keys: Sequence[str], score: str = "rank") -> DataFrame:
    """The state with sums over the order of a score from the highest down: hits_above and judged_above (strictly above), hits_tied
    and judged_tied (at the same score), and first, true on one row of each score of a group."""
    slot = F.least(F.floor(F.col(score) * SLOTS), F.lit(SLOTS - 1))
    rows, by = (states, list(keys)) if keys else (states.withColumn("_slot", slot), ["_slot"])
    order = Window.partitionBy(*by).orderBy(F.desc(score))
    upto, tied = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    over = lambda c, w: F.sum(c).over(w)
    rows = rows.withColumns({
        "hits_tied": over("hits", tied), "judged_tied": over("judged", tied), "hits_above": over("hits", upto) - over("hits", tied),
        "judged_above": over("judged", upto) - over("judged", tied), "first": ~F.coalesce(F.lag(score).over(order) == F.col(score), F.lit(False)),
    })
    if keys:
        return rows
    totals = states.groupBy(slot.alias("_slot")).agg(F.sum("hits").alias("h"), F.sum("judged").alias("j"))  # SLOTS rows at most
    every = totals.agg(F.collect_list(F.struct("_slot", "h", "j")).alias("slots"))
    above = lambda c: F.aggregate(F.filter("slots", lambda s: s["_slot"] > F.col("_slot")), F.lit(0).cast("long"), lambda a, s: a + s[c])
    starts = totals.crossJoin(F.broadcast(every)).select("_slot", above("h").alias("_h"), above("j").alias("_j"))  # one row
    rows = rows.join(F.broadcast(starts), "_slot")
    return rows.withColumns({"hits_above": F.col("hits_above") + F.col("_h"), "judged_above": F.col("judged_above") + F.col("_j")}).drop("_slot", "_h", "_j")


def quantile_edges(states: DataFrame, score: str, weight: str, parts: int = 10) -> DataFrame:
    """One row with the array of the distinct quantiles 0, 1/parts, ... 1 of all rows, interpolated; null without rows.

    The quantiles are read off sums over the ranges of `ranked`, so no task holds all scores.
    """
    known = states.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(weight).alias("judged")).where("judged > 0").withColumn("hits", F.col("judged"))
    rows = ranked(known, [], score)
    total = known.agg(F.sum("judged").alias("_n"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("below", F.col("_n") - F.col("judged_above") - F.col("judged_tied"))  # one row
    at = [F.lit(i / parts) * (F.col("_n") - 1) for i in range(parts + 1)]
    value = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("judged_tied")), F.col(score)))
    picked = rows.agg(F.max("_n").alias("_n"), *[value(f(p)).alias(f"{name}{i}") for i, p in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int) -> Column:
        lo, hi, p = F.col(f"lo{i}"), F.col(f"hi{i}"), at[i]
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return picked.where("_n is not null").select(F.array_distinct(F.array(*[between(i) for i in range(parts + 1)])).alias("edges"))


def one_class(pos: Column, neg: Column, value: Column) -> Column:
    """0 without judged rows, NaN where all are right or all are wrong."""
    return F.when(F.coalesce(pos + neg, F.lit(0)) == 0, F.lit(0.0)).when((pos == 0) | (neg == 0), F.lit(NAN)).otherwise(value)


def _ece(bin_: Column, kept: Column | None = None) -> Column:
    """Weighted gap between mean confidence and accuracy over the bins; null without scored rows."""
    scored = F.col("unit").isNotNull() if kept is None else F.col("unit").isNotNull() & kept
    gap = F.col("unit") * F.col("judged") - F.col("hits")
    gaps = [F.abs(or_zero(F.sum(F.when(scored & (bin_ == b), gap)))) for b in range(10)]
    return F.try_divide(sum(gaps[1:], gaps[0]), F.sum(F.when(scored, F.col("judged"))))


def _bin(adaptive: bool, edges: str = "edges") -> Column:
    if not adaptive:
        return T.calibration_bin(F.col("unit"))
    under = F.size(F.filter(edges, lambda e: e <= F.col("unit"))) - 1
    return F.greatest(F.lit(0), F.least(under, F.size(edges) - 2))


def _reliability(adaptive: bool) -> Column:
    scored = F.col("percent").isNotNull()
    count = lambda b, c: F.coalesce(F.sum(F.when(scored & (T.reliability_bin(F.col("percent")) == b), F.col(c))), F.lit(0))
    return F.array(*[F.struct(F.lit(b).alias("bin"), count(b, "hits").alias("correct"), count(b, "judged").alias("total")) for b in range(10)])


def _auroc(adaptive: bool) -> Column:
    p, n = F.sum("hits"), F.sum(F.col("judged") - F.col("hits"))
    won = F.sum((F.col("judged") - F.col("hits")) * (F.col("hits_above") + F.lit(0.5) * F.col("hits_tied")))
    return one_class(p, n, F.try_divide(won, p * n))


def _auprc(adaptive: bool) -> Column:
    above, upto = F.col("judged_above"), F.col("judged_above") + F.col("judged_tied")
    before = F.when(above == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("hits_above"), above))
    here = or_zero(F.try_divide(F.col("hits_above") + F.col("hits_tied"), upto))
    area = F.sum(F.when(F.col("first"), F.col("hits_tied") * (before + here) / F.lit(2.0)))
    p, n = F.sum("hits"), F.sum(F.col("judged") - F.col("hits"))
    return one_class(p, n, F.try_divide(area, p))


def _by_group(value: Callable[[Column], Column]) -> Column:
    return F.array(*[F.struct(F.lit(g).alias("grp"), value(F.coalesce(F.col("grp") == g, F.lit(False))).alias("value")) for g in GROUPS])


def _mean(part: Column, whole: Column) -> Column:
    return F.try_divide(F.sum(part).cast("double"), F.sum(whole))


#: Metric name to an aggregate over rows of the state; the argument chooses deciles as bins where a metric has bins.
#: Ranking metrics may use the columns of `ranked`, those with deciles `edges` (of the keys) and `group_edges` (of the group too).
METRICS: dict[str, Callable[[bool], Column]] = {
    "accuracy": lambda adaptive: or_zero(_mean(F.col("hits"), F.col("judged"))),
    "valid_sample_portion": lambda adaptive: T.portion(F.coalesce(F.sum("valid"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))),
    "label_accuracy": lambda adaptive: F.coalesce(_mean(F.col("right"), F.col("known")), F.lit(NAN)),
    "label_extraction_portion": lambda adaptive: T.portion(F.coalesce(F.sum("said"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)) * 3),
    "ave_conf": lambda adaptive: or_zero(_mean(F.col("unit") * F.col("n"), F.when(F.col("unit").isNotNull(), F.col("n")))),
    "ece": lambda adaptive: or_zero(_ece(_bin(adaptive))),
    "ece_adaptive": lambda adaptive: or_zero(_ece(_bin(True))),
    "auroc": _auroc,
    "auprc": _auprc,
    "reliability_diagram": _reliability,
    "ece_by_group": lambda adaptive: _by_group(lambda g: _ece(_bin(adaptive, "group_edges"), g)),
    "accuracy_by_group": lambda adaptive: _by_group(lambda g: _mean(F.when(g, F.col("hits")), F.when(g, F.col("judged")))),
}
#: Metrics over the order of scores; metrics that need a confidence; metrics that need the passages' types.
RANKING = {"auroc", "auprc"}
CONFIDENT = {"ave_conf", "ece", "ece_adaptive", "auroc", "auprc", "reliability_diagram", "ece_by_group"}
TYPED = {"ece_by_group", "accuracy_by_group", "label_accuracy"}
_DECILES = [i / 10 for i in range(11)]


def _with_edges(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct deciles of the judged confidences of each group."""
    weight = F.when(F.col("unit").isNotNull(), F.col("judged")).otherwise(F.lit(0))
    edges = F.percentile("unit", F.array(*[F.lit(p) for p in _DECILES]), weight)
    return rows.withColumn(name, F.array_distinct(edges.over(Window.partitionBy(*by))))


def measure(states: DataFrame, keys: Sequence[str], metrics: Sequence[str], places: int | None = None, adaptive: bool = False, registry: Mapping[str, Callable[[bool], Column]] = METRICS) -> DataFrame:
    """One row for each group of keys (null keys are a group) with a column for each metric."""
    rows, names = states, set(metrics)
    if names & RANKING or names - set(METRICS):
        rows = ranked(rows, keys)
    if "ece_adaptive" in names or adaptive and "ece" in names:
        rows = _with_edges(rows, keys, "edges") if keys else rows.join(F.broadcast(quantile_edges(states, "unit", "judged")), how="left")  # one row
    if adaptive and "ece_by_group" in names:
        rows = _with_edges(rows, [*keys, "grp"], "group_edges")
    out = rows.groupBy(*keys).agg(*[registry[m](adaptive).alias(m) for m in metrics])
    if places is None:
        return out
    kinds = dict(out.dtypes)
    for m in metrics:
        if kinds[m] == "double":
            out = out.withColumn(m, F.bround(m, places))
        elif kinds[m] == "array<struct<grp:string,value:double>>":
            out = out.withColumn(m, F.transform(m, lambda x: x.withField("value", F.bround(x["value"], places))))
    return out
