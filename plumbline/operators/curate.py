"""Rules that turn sampled responses into training triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import labels as L
from ..functions import text as T

#: The order of the rules; a response carries the first that it breaks.
REASONS = ("blank", "no_think", "no_steps", "no_step_four", "no_labels", "no_answer_or_confidence", "mismatch")


def validated_text(text: Column, think: Column) -> Column:
    """What rules look at: all of it, or of thinking models what follows the first closing mark."""
    at = F.instr(text, "</think>")
    return F.when(think, F.when(at > 0, T.strip(F.substr(text, at + len("</think>"))))).otherwise(text)


def apply_rules(responses: DataFrame, text: Column, types: Column, think: Column, tolerate: bool = False) -> DataFrame:
    """responses with reject_reason (null: kept), tolerated, labels, model_answer, stated_confidence and content.

    What a text is parsed to is generated as one struct a row: filters on the result stay above it, so a text is parsed once.
    content is a column above it, so it is made of kept responses only, and not at all where nothing reads it.
    """
    rows = responses.withColumn("_truth", L.expected_labels(types)).where(F.col("_truth").isNotNull())
    parsed = T.let(F.struct(T.strip(text).alias("full"), think.alias("think")), lambda x: T.let(
        F.struct(x["full"].alias("full"), x["think"].alias("think"), validated_text(x["full"], x["think"]).alias("valid")),
        lambda y: F.struct(
            y["full"].alias("full"), y["think"].alias("think"), y["valid"].alias("valid"), L.label_block(y["valid"]).alias("labels"),
            E.rule_answer(y["valid"]).alias("answer"), E.rule_confidence(y["valid"]).alias("stated"),
        ),
    ))
    judged = T.let(parsed, lambda x: _judged(x, tolerate))
    rows = rows.select("*", F.explode(F.array(judged)).alias("_ruled"))
    found = {c: F.col("_ruled")[c] for c in ("labels", "model_answer", "stated_confidence", "reject_reason", "tolerated")}
    content = T.let(T.strip(text), lambda full: _content(full, think, found["labels"]))
    found["content"] = F.when(found["reject_reason"].isNull(), content)
    return rows.select(*[F.col(c) for c in responses.columns], *[v.alias(c) for c, v in found.items()])


def _content(full: Column, think: Column, labels: Column) -> Column:
    """What a kept response is rewritten to; a thought stays as it is."""
    at = F.when(think, F.instr(full, "</think>")).otherwise(0)
    cut = F.when(at > 0, at + len("</think>") - 1).otherwise(0)
    return T.let(cut, lambda n: F.concat(F.substr(full, F.lit(1), n), T.let(F.substr(full, n + 1), lambda rest: L.standard_answer(L.normal_block(rest, labels)))))


def _judged(x: Column, tolerate: bool) -> Column:
    """The result of the rules for a parsed text, beside the column _truth."""
    full, valid, thinks, labels = x["full"], x["valid"], x["think"], x["labels"]
    mild = lambda d: d["p"].isin(L.SOME, L.NONE) & d["t"].isin(L.SOME, L.NONE)
    differ = F.filter(F.arrays_zip(labels.alias("p"), F.col("_truth").alias("t")), lambda d: d["p"] != d["t"])

    def ruled(d: Column) -> Column:
        excused = F.lit(tolerate) & (F.size(d) == 1) & F.forall(d, mild)
        reason = (
            F.when(full.isNull() | (full == ""), "blank")
            .when(thinks & F.coalesce(valid == "", F.lit(True)), "no_think")
            .when(~thinks & ~E.has_steps(full), "no_steps")
            .when(~thinks & ~E.has_step_four(full), "no_step_four")
            .when(labels.isNull(), "no_labels")
            .when(x["answer"].isNull() | x["stated"].isNull(), "no_answer_or_confidence")
            .when((F.size(d) > 0) & ~excused, "mismatch")
        )
        return F.struct(reason.alias("reason"), F.coalesce(excused, F.lit(False)).alias("excused"))

    def result(r: Column) -> Column:
        kept = r["reason"].isNull()
        return F.struct(
            labels.alias("labels"), x["answer"].alias("model_answer"), x["stated"].alias("stated_confidence"), r["reason"].alias("reject_reason"),
            (r["excused"] & kept).alias("tolerated"),
        )

    return T.let(T.let(differ, ruled), result)


def funnel(ruled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact counts: rows seen, rows that break each rule first, tolerated ones, and kept ones."""
    counts = [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    return ruled.groupBy(*keys).agg(F.count("*").alias("seen"), *counts, F.count_if(F.col("tolerated")).alias("tolerated"), F.count_if(F.col("reject_reason").isNull()).alias("kept"))


def remove_longest(rows: DataFrame, keys: Sequence[str], text: Column, order: Column, share: float) -> DataFrame:
    """Without the longest ceil(n * share) rows of each group, one at least staying; of equals the first goes."""
    if share <= 0:
        return rows
    group = Window.partitionBy(*keys)
    n = F.count("*").over(group)
    drop = F.when(n > 1, F.least(F.ceil(n * F.lit(float(share))), n - 1)).otherwise(0)
    rank = F.row_number().over(group.orderBy(F.length(F.coalesce(text, F.lit(""))).desc(), order))
    return rows.withColumn("_keep", rank > drop).where("_keep").drop("_keep")


def common_ids(rows: DataFrame, id_col: str, model_col: str) -> DataFrame:
    """Ids that every model has."""
    total = rows.select(F.countDistinct(model_col).alias("total"))
    return rows.groupBy(id_col).agg(F.countDistinct(model_col).alias("models")).join(F.broadcast(total), F.col("models") == F.col("total")).select(id_col)


def only_common(rows: DataFrame, id_col: str, model_col: str) -> DataFrame:
    return rows.join(common_ids(rows, id_col, model_col), id_col, "left_semi")


def balance(prompts: DataFrame, id_col: str, group_col: str, seed: int = 42) -> DataFrame:
    """Consistent prompts drawn down to the number of irrelevant ones, if there are some and fewer; others stay.

    The draw takes the first by md5 of id and seed: the same on any cluster and in SQL. They are numbered within
    slots of the digest's first three digits, moved by the sizes of the slots before, of which there are 4,096 at most.
    """
    sizes = prompts.agg(F.count_if(F.col(group_col) == "consistent").alias("_c"), F.count_if(F.col(group_col) == "irrelevant").alias("_i"))
    rows = prompts.where(F.col(group_col) == "consistent").withColumn("_draw", F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))))
    rows = rows.withColumn("_slot", F.left("_draw", F.lit(3)))
    slots = rows.groupBy("_slot").count()
    before = slots.select("_slot", (F.sum("count").over(Window.orderBy("_slot")) - F.col("count")).alias("_before")).crossJoin(F.broadcast(sizes))  # one row
    drawn = rows.join(F.broadcast(before), "_slot").where((F.col("_i") == 0) | (F.col("_before") < F.col("_i")))
    within = F.row_number().over(Window.partitionBy("_slot").orderBy("_draw", id_col))
    kept = drawn.withColumn("_rank", F.col("_before") + within).where((F.col("_i") == 0) | (F.col("_rank") <= F.col("_i"))).select(*prompts.columns)
    return prompts.where((F.col(group_col) != "consistent") | F.col(group_col).isNull()).unionByName(kept)


def select_response(rows: DataFrame, keys: Sequence[str], correct: Column, confidence: Column, order: Column, policy: str = "reference") -> DataFrame:
    """One row for each group. Candidates are the surest correct and the least sure wrong one; of both, policy
    "reference" takes the less confident, "brier" the one with the smaller squared gap. Ties: first by order."""
    if policy not in ("reference", "brier"):
        raise ValueError(f"unknown policy: {policy}")
    rows = rows.withColumns({"_ok": correct, "_conf": confidence, "_at": order})
    own = F.when(F.col("_ok"), -F.col("_conf")).otherwise(F.col("_conf"))
    first = F.row_number().over(Window.partitionBy(*keys, "_ok").orderBy(own, "_at"))
    rows = rows.withColumn("_first", first).where("_first = 1")
    gap = F.pow(F.col("_conf") / F.lit(100.0) - F.col("_ok").cast("double"), F.lit(2.0))
    by = F.col("_conf") if policy == "reference" else gap
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(by, F.desc("_ok"), "_at"))
    return rows.withColumn("_best", best).where("_best = 1").drop("_ok", "_conf", "_at", "_first", "_best")


def training_triples(rows: DataFrame, instruction: str, template: str, question: Column, contents: Column, output: Column, think: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (instruction, input, output); thinking models' outputs begin with a thinking mark."""
    text = T.strip(F.coalesce(output, F.lit("")))
    shown = T.render(template, {"question": question, "facts": T.training_facts(contents), **(extra or {})})
    marked = F.when(think & ~text.startswith("<think>"), F.concat(F.lit("<think>"), text)).otherwise(text)
    return rows.select(F.lit(instruction).alias("instruction"), shown.alias("input"), marked.alias("output"))


def group_report(chosen: DataFrame, group: Column, correct: Column, confidence: Column) -> DataFrame:
    """Of each prompt group: rows, accuracy and mean confidence of what was chosen."""
    return chosen.groupBy(group.alias("grp")).agg(F.count("*").alias("total"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))
