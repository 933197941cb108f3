"""Metrics by hand and by invariants; curation rules on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import curate as C
from plumbline.operators import metrics as M

def frame(spark, rows):
    return spark.createDataFrame(rows, "confidence string, correct boolean, answer string, model string")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(f"{r.randrange(0, 101)}%", r.random() < 0.5, "a", f"m{i % 2}") for i in range(400)]


def test_auroc_by_hand(spark):
    df = frame(spark, [("90", True, "a", "m"), ("90", False, "a", "m"), ("10", False, "a", "m")])
    assert M.auroc(df, [], F.col("confidence"), F.col("correct")).first()[0] == pytest.approx(0.75)


def test_one_class_and_no_rows(spark):
    one = frame(spark, [("90", True, "a", "m")])
    none = frame(spark, []).where("model is not null")
    for f in (M.auroc, M.auprc):
        assert math.isnan(f(one, [], F.col("confidence"), F.col("correct")).first()[0])
        assert f(none, [], F.col("confidence"), F.col("correct")).first()[0] == 0.0
    assert M.ece(none, [], F.col("confidence"), F.col("correct")).first()[0] == 0.0
    assert M.accuracy(none, [], F.col("correct")).first()[0] == 0.0


def test_against_brute_force(spark, rows):
    df = frame(spark, rows)
    for r in M.evaluate(df, ["model"], ["accuracy", "ave_conf", "ece", "auroc"]).collect():
        own = [(int(c[:-1]) / 100, ok) for c, ok, _, m in rows if m == r["model"]]
        pos, neg = [c for c, ok in own if ok], [c for c, ok in own if not ok]
        assert r["accuracy"] == pytest.approx(len(pos) / len(own))
        own = [(1.0 if c == 0.01 else c, ok) for c, ok in own]  # what is at most 1 is a share, percent sign or not
        assert r["ave_conf"] == pytest.approx(sum(c for c, _ in own) / len(own))
        assert r["auroc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
        edges = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
        bins = [[x for x in own if sum(x[0] >= e for e in edges) == b] for b in range(10)]
        assert r["ece"] == pytest.approx(sum(abs(sum(c for c, _ in b) - sum(ok for _, ok in b)) for b in bins) / len(own))


def test_invariants(spark, rows):
    df = frame(spark, rows)
    a = M.auroc(df, [], F.col("confidence"), F.col("correct")).first()[0]
    turned = df.withColumn("confidence", F.concat((100 - F.regexp_extract("confidence", r"\d+", 0).cast("int")).cast("string"), F.lit("%")))
    assert M.auroc(turned, [], F.col("confidence"), F.col("correct")).first()[0] == pytest.approx(1 - a)
    bins = M.reliability(df, [], F.col("confidence"), F.col("correct")).first()["bins"]
    assert len(bins) == 10 and sum(b["total"] for b in bins) == len(rows)
    assert 0 <= M.ece(df, ["model"], F.col("confidence"), F.col("correct"), adaptive=True).first()["ece"] <= 1


def test_adaptive_single_value(spark):
    df = frame(spark, [("80%", True, "a", "m"), ("80%", False, "a", "m")])
    assert M.ece(df, [], F.col("confidence"), F.col("correct"), adaptive=True).first()[0] == pytest.approx(0.3)


def test_detection_and_errors(spark, rows):
    df = frame(spark, rows[:5])
    confident = ["ave_conf", "ece", "auroc", "auprc", "reliability_diagram"]
    assert M.detect(df) == ["accuracy", "valid_sample_portion", *confident]
    typed = df.withColumn("types", F.array(F.lit("relevant"))).withColumn("passage_2_label", F.lit("Relevant"))
    labelled = ["label_accuracy", "label_extraction_portion"]
    assert M.detect(typed.withColumn("passage_1_label", F.lit(None).cast("string")).withColumn("passage_3_label", F.lit(None).cast("string"))) == [
        "accuracy", "valid_sample_portion", *labelled, *confident, "ece_by_group", "accuracy_by_group"
    ]
    with pytest.raises(ValueError):
        M.evaluate(df, [], ["nonsense"])
    with pytest.raises(ValueError):
        M.evaluate(df.drop("correct"), [], ["accuracy"])
    with pytest.raises(ValueError):
        M.label_accuracy(df, [], F.array(), [], position=4)


def test_label_metrics(spark):
    df = spark.createDataFrame([(["gt_passage", "relevant", "irrelevant"], "##Highly Relevant##", "", None)], "types array<string>, a string, b string, c string")
    said = [F.col("a"), F.col("b"), F.col("c")]
    assert M.label_accuracy(df, [], F.col("types"), said).first()[0] == pytest.approx(1 / 3)
    cells = M.label_confusion(df, [], F.col("types"), said).collect()
    assert len(cells) == 9 and sum(c["count"] for c in cells) == 1


def test_majority_vote(spark):
    df = spark.createDataFrame([(1, "Paris", 0.9, 0), (1, "paris.", 0.7, 1), (1, "Rome", 0.99, 2)], "q int, a string, c double, i int")
    r = M.majority_vote(df, ["q"], F.col("a"), F.col("c"), F.col("i")).first()
    assert (r["answer"], round(r["confidence"], 9)) == ("Paris", 0.8)


STEPS = "Step 1: a\nStep 4: b\nPassage Classifications:\n1. {}\n2. {}\n3. {}\nFinal Answer: x\nConfidence: 70%"


def ruled(spark, texts, types=("gt_passage", "irrelevant", "irrelevant"), think=False, tolerate=False):
    df = spark.createDataFrame([(i, t, list(types)) for i, t in enumerate(texts)], "i int, t string, types array<string>")
    return {r["i"]: r for r in C.apply_rules(df, F.col("t"), F.col("types"), F.lit(think), tolerate).collect()}


def test_rules_in_order(spark):
    good = STEPS.format("Highly Relevant", "Irrelevant", "Irrelevant")
    swapped = STEPS.format("Highly Relevant", "Relevant", "Irrelevant")
    texts = [good, None, "  ", "no marks", "Step 1: only", good.replace("3. ", "x. "), good.replace("Confidence: 70%", ""), swapped, STEPS.format("Relevant", "Irrelevant", "Irrelevant")]
    got = ruled(spark, texts)
    assert [got[i]["reject_reason"] for i in range(9)] == [None, "blank", "blank", "no_steps", "no_step_four", "no_labels", "no_answer_or_confidence", "mismatch", "mismatch"]
    assert got[0]["content"].endswith("3. IrrelevantAnswer: x\nConfidence: 70%")  # the rule takes white space before it along
    got = ruled(spark, texts, tolerate=True)
    assert got[7]["reject_reason"] is None and got[7]["tolerated"] and got[8]["reject_reason"] == "mismatch"


def test_thinking_models(spark):
    body = "Passage Classifications:\n1. Highly Relevant\n2. Irrelevant\n3. Irrelevant\nAnswer: x\nConfidence: 7"
    got = ruled(spark, [f"long thought</think>{body}", body, "thought</think>  "], think=True)
    assert [got[i]["reject_reason"] for i in range(3)] == [None, "no_think", "no_think"]


def test_funnel_adds_up(spark):
    df = spark.createDataFrame([(i, t, ["gt_passage", "irrelevant", "irrelevant"]) for i, t in enumerate(["", "x", STEPS.format("Highly Relevant", "Irrelevant", "Irrelevant")])], "i int, t string, types array<string>")
    r = C.funnel(C.apply_rules(df, F.col("t"), F.col("types"), F.lit(False)), []).first()
    assert r["seen"] == sum(r[x] for x in C.REASONS) + r["kept"]


def test_remove_longest(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([3, 5, 5, 1, 2])] + [(2, 0, "only")], "g int, i int, t string")
    left = {(r["g"], r["i"]) for r in C.remove_longest(df, ["g"], F.col("t"), F.col("i"), 0.05).collect()}
    assert left == {(1, 0), (1, 2), (1, 3), (1, 4), (2, 0)}
    assert C.remove_longest(df, ["g"], F.col("t"), F.col("i"), 0.99).where("g = 2").count() == 1


def test_select_response(spark):
    df = spark.createDataFrame([(1, True, 90.0, 0), (1, True, 70.0, 1), (1, False, 20.0, 2), (1, False, 60.0, 3)], "q int, ok boolean, c double, i int")
    pick = lambda p: C.select_response(df, ["q"], F.col("ok"), F.col("c"), F.col("i"), p).first()["i"]
    assert pick("reference") == 2 and pick("brier") == 0
    with pytest.raises(ValueError):
        pick("other")


def test_balance_and_common(spark):
    df = spark.createDataFrame([(i, "consistent" if i < 8 else "irrelevant" if i < 11 else "counterfactual") for i in range(14)], "id int, g string")
    n = {r["g"]: r["count"] for r in C.balance(df, "id", "g").groupBy("g").count().collect()}
    assert n == {"consistent": 3, "irrelevant": 3, "counterfactual": 3}
    assert C.balance(df.where("g <> 'irrelevant'"), "id", "g").where("g = 'consistent'").count() == 8
    models = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a")], "id int, m string")
    assert {r["id"] for r in C.common_ids(models, "id", "m").collect()} == {1, 3}


def test_balance_draws_the_first_by_digest(spark):
    import hashlib

    groups = {i: "irrelevant" if i % 3 == 0 else "consistent" for i in range(6000)}
    left = {r["id"] for r in C.balance(spark.createDataFrame(list(groups.items()), "id int, g string"), "id", "g", 7).collect()}
    drawn = sorted((i for i, g in groups.items() if g == "consistent"), key=lambda i: (hashlib.md5(f"{i}-7".encode()).hexdigest(), i))[:2000]
    assert left == {i for i, g in groups.items() if g == "irrelevant"} | set(drawn)
