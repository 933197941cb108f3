"""Calibration and label metrics as grouped aggregations.

Every metric takes a DataFrame, the grouping keys (none: one row over all) and column expressions, and returns keys
and values. Judging is done once, as a column; metrics that need an order first sum by distinct score, so what is
ordered is small and partitioned by the keys, or without keys by ranges of the score. `evaluate` gets all metrics from
one pass (see `calibration`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from . import calibration as K
from .calibration import GROUPS, METRICS

_NAN, _or_zero = K.NAN, K.or_zero


def accuracy(df: DataFrame, keys: Sequence[str], correct: Column) -> DataFrame:
    """Share of correct rows among judged ones; 0 if none is judged."""
    return df.groupBy(*keys).agg(_or_zero(F.avg(correct.cast("double"))).alias("accuracy"))


def average_confidence(df: DataFrame, keys: Sequence[str], confidence: Column) -> DataFrame:
    return df.groupBy(*keys).agg(_or_zero(F.avg(T.confidence_unit(confidence))).alias("ave_conf"))


def valid_portion(df: DataFrame, keys: Sequence[str], answer: Column) -> DataFrame:
    got = F.count_if(F.coalesce(answer != "", F.lit(False)))
    return df.groupBy(*keys).agg(T.portion(got, F.count("*")).alias("valid_sample_portion"))


def label_portion(df: DataFrame, keys: Sequence[str], labels: Sequence[Column]) -> DataFrame:
    found = sum((F.coalesce(c != "", F.lit(False)).cast("long") for c in labels[1:]), F.coalesce(labels[0] != "", F.lit(False)).cast("long"))
    return df.groupBy(*keys).agg(T.portion(F.sum(found), F.count("*") * len(labels)).alias("label_extraction_portion"))


def ece(df: DataFrame, keys: Sequence[str], confidence: Column, correct: Column, adaptive: bool = False) -> DataFrame:
    """Expected calibration error over ten equal bins, or over deciles of the confidences; 0 without scored rows."""
    return K.measure(K.state(df, keys, correct, confidence), keys, ["ece"], adaptive=adaptive)


def auroc(df: DataFrame, keys: Sequence[str], confidence: Column, correct: Column) -> DataFrame:
    """Chance that a correct row has more confidence than a wrong one, ties half; NaN with one class, 0 with none."""
    return K.measure(K.state(df, keys, correct, confidence), keys, ["auroc"])


def auprc(df: DataFrame, keys: Sequence[str], confidence: Column, correct: Column) -> DataFrame:
    """Area under precision over recall by trapezoids from (0, 1); NaN with one class, 0 with none."""
    return K.measure(K.state(df, keys, correct, confidence), keys, ["auprc"])


def reliability(df: DataFrame, keys: Sequence[str], confidence: Column, correct: Column) -> DataFrame:
    """Rows (keys, bins): ten structs (bin, correct, total), empty bins included."""
    rows = df.select(*keys, T.reliability_bin(T.confidence_percent(confidence)).alias("bin"), correct.cast("long").alias("hit")).where("bin is not null and hit is not null")
    bins = [
        F.struct(F.lit(b).alias("bin"), F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("hit"))), F.lit(0)).alias("correct"), F.count_if(F.col("bin") == b).alias("total"))
        for b in range(10)
    ]
    return rows.groupBy(*keys).agg(F.array(*bins).alias("bins"))


def _group_rows(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    return df.select(*keys, F.explode(name).alias("g")).select(*keys, "g.grp", F.col("g.value").alias(value))


def ece_by_group(df: DataFrame, keys: Sequence[str], confidence: Column, correct: Column, group: Column, adaptive: bool = False) -> DataFrame:
    """Rows (keys, grp, ece) of all three groups; null where a group has no scored rows."""
    return _group_rows(K.measure(K.state(df, keys, correct, confidence, group=group), keys, ["ece_by_group"], adaptive=adaptive), keys, "ece_by_group", "ece")


def accuracy_by_group(df: DataFrame, keys: Sequence[str], correct: Column, group: Column) -> DataFrame:
    """Rows (keys, grp, accuracy) of all three groups; null where a group has no judged rows."""
    return _group_rows(K.measure(K.state(df, keys, correct, group=group), keys, ["accuracy_by_group"]), keys, "accuracy_by_group", "accuracy")


def _label_pairs(df: DataFrame, keys: Sequence[str], types: Column, predicted: Sequence[Column]) -> DataFrame:
    """Rows (keys, pos, expected, predicted) of all passages with a known expected label."""
    return df.select(*keys, F.inline(K.label_pairs(types, predicted)))


def label_accuracy(df: DataFrame, keys: Sequence[str], types: Column, predicted: Sequence[Column], position: int | None = None) -> DataFrame:
    """Share of passages with the expected label; a missing one is wrong; NaN without known passages."""
    if position is not None and position not in (1, 2, 3):
        raise ValueError("position must be 1, 2 or 3")
    rows = _label_pairs(df, keys, types, predicted)
    rows = rows if position is None else rows.where(F.col("pos") == position)
    hit = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("double")
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(_NAN)).alias("label_accuracy"))


def label_confusion(df: DataFrame, keys: Sequence[str], types: Column, predicted: Sequence[Column]) -> DataFrame:
    """Rows (keys, expected, predicted, count), all nine cells; missing predictions are left out."""
    names = [x.lower() for x in L.LABELS]
    rows = _label_pairs(df, keys, types, predicted).where(F.col("predicted").isin(*names))
    cells = [
        F.struct(F.lit(e).alias("expected"), F.lit(p).alias("predicted"), F.count_if((F.col("expected") == e) & (F.col("predicted") == p)).alias("count"))
        for e in names
        for p in names
    ]
    return rows.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")


def label_missing(df: DataFrame, keys: Sequence[str], types: Column, predicted: Sequence[Column]) -> DataFrame:
    """Rows (keys, expected, missing, total): passages by expected label, and those of them without a known prediction,
    which label_confusion leaves out."""
    said = F.coalesce(F.col("predicted").isin(*[x.lower() for x in L.LABELS]), F.lit(False))
    return _label_pairs(df, keys, types, predicted).groupBy(*keys, "expected").agg(F.count_if(~said).alias("missing"), F.count("*").alias("total"))


def majority_vote(df: DataFrame, keys: Sequence[str], answer: Column, confidence: Column, order: Column) -> DataFrame:
    """The answer of the largest group of equal normal forms: ties by mean confidence, then by first place."""
    rows = df.select(*keys, answer.alias("answer"), confidence.alias("conf"), order.alias("place"), T.normalize(answer).alias("norm")).where("answer is not null")
    groups = rows.groupBy(*keys, "norm").agg(
        F.min_by("answer", "place").alias("answer"), F.count("*").alias("votes"), F.avg("conf").alias("confidence"), F.min("place").alias("place")
    )
    best = F.max_by(F.struct("answer", "votes", "confidence"), F.struct("votes", "confidence", (-F.col("place")).alias("first")))
    return groups.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def detect(df: DataFrame) -> list[str]:
    """The metrics that the data has columns and values for."""
    has = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)) if c in df.columns else F.lit(False)
    row = df.agg(has("confidence").alias("c"), has("passage_1_label").alias("a"), has("passage_2_label").alias("b"), has("passage_3_label").alias("d")).first()
    out = ["accuracy", "valid_sample_portion"]
    if row["a"] or row["b"] or row["d"]:
        out += ["label_accuracy"] * ("types" in df.columns) + ["label_extraction_portion"]
    if row["c"]:
        out += ["ave_conf", "ece", "auroc", "auprc", "reliability_diagram", *["ece_by_group", "accuracy_by_group"] * ("types" in df.columns)]
    return out


def evaluate(
    df: DataFrame, keys: Sequence[str] = ("model", "task"), metrics: Sequence[str] | None = None, places: int | None = None, adaptive: bool = False, merge: Sequence[str] = (),
) -> DataFrame:
    """One row for each group with a column for each metric, from one pass; raises on unknown names and missing fields.

    adaptive: ece and ece_by_group take deciles of the confidences as bins. merge: some of the keys, say the data set;
    rows with `merged` true have these taken together. Null keys are groups of their own. A group without judged rows or
    confidences has each metric's empty value: 0, NaN for label accuracy, ten empty bins, null for an empty passage group.
    """
    metrics = list(metrics) if metrics is not None else detect(df)
    if unknown := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"unknown metrics: {unknown}")
    needed = ["answer", "correct", *["confidence"] * bool(K.CONFIDENT & set(metrics)), *["types"] * bool(K.TYPED & set(metrics))]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing fields: {missing}")
    if unknown := [k for k in merge if k not in keys]:
        raise ValueError(f"merged keys must be keys: {unknown}")
    states, by = K.standard_state(df, list(keys)), list(keys)
    if merge:
        states, by = K.merged(states, by, list(merge)), [*by, "merged"]
    return K.measure(states, by, metrics, places, adaptive)
