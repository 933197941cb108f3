"""Whole ways through the engine on small tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import prompts as P
from plumbline.plans import workflows as W

GOOD = "Step 1: a\nStep 4: b\nPassage Classifications:\n1. Highly Relevant\n2. Relevant\n3. Irrelevant\n\nAnswer: {}\nConfidence: {}%"


def items(spark):
    rows = [("s1", "q1", ["gt_passage", "relevant", "irrelevant"], ["a", "b", "c"], ["Rome"]), ("2", "q2", ["relevant", "relevant", "irrelevant"], ["d", "e", "f"], ["Oslo"])]
    return spark.createDataFrame(rows, "id string, question string, types array<string>, contents array<string>, truths array<string>")


def test_curate(spark):
    rows = [("s1", m, i, GOOD.format(a, c), False) for m in ("x", "y") for i, (a, c) in enumerate([("Rome", 90), ("Paris", 20), ("Rome", 50)])] + [("2", "x", 0, "no steps", False), ("2", "y", 0, "", False)]
    responses = spark.createDataFrame(rows, "id string, model string, sample_id int, text string, distill boolean")
    triples, funnel = W.curate(responses, items(spark), "Do it.", "Q: {question}\n{facts}")
    got = triples.orderBy("model").collect()
    assert [(r["model"], r["id"], r["grp"]) for r in got] == [("x", "s1", "consistent"), ("y", "s1", "consistent")]
    assert "Answer: Paris" in got[0]["output"] and got[0]["input"] == "Q: q1\n1: a\n\n2: b\n\n3: c\n"
    brier, _ = W.curate(responses, items(spark), "Do it.", "{question}", policy="brier")
    assert all("Confidence: 90%" in r["output"] for r in brier.collect())
    assert {r["model"]: (r["seen"], r["kept"]) for r in funnel.collect()} == {"x": (4, 3), "y": (4, 3)}


def test_curated_rows_are_freed(spark):
    responses = spark.createDataFrame([("s1", "x", 0, GOOD.format("Rome", 90), False)], "id string, model string, sample_id int, text string, distill boolean")
    out = W.curate(responses, items(spark), "Do it.", "{question}")
    before = out[0].collect()
    assert out.ruled.storageLevel.useDisk and len(before) == 1
    out.close()
    assert not out.ruled.storageLevel.useDisk and out[0].collect() == before


def test_evaluate(spark):
    rows = [("s1", "m", GOOD.format("Rome", 80)), ("2", "m", GOOD.format("Bergen", 40)), ("2", "m", "nothing")]
    responses = spark.createDataFrame(rows, "id string, model string, text string")
    r = W.evaluate(responses, items(spark), "ckpt_test", unmatched="empty_0").first()
    assert r["accuracy"] == pytest.approx(1 / 3) and r["valid_sample_portion"] == "2/3 (66.7%)" and r["label_extraction_portion"] == "6/9 (66.7%)"


def test_generate(spark):
    shown = spark.createDataFrame([("s1", "q", ["Rome", "Roma"], "One two. Three.", ["old"])], "id string, question string, gt_answer array<string>, gt_passage string, passages array<string>")

    def service(prompt):
        assert "True answer: Rome\n" in prompt and "1-3 sentences" in prompt
        return "\n".join(f"Passage {i}: p{i}\nTopic {i}: t{i}" for i in range(1, 6))

    r = W.generate_noise(shown, "gen_irrelevant", service).first()
    assert [p["content"] for p in r["generated"]] == ["p3", "p4", "p5"] and r["status"] == "ok"
    asked = W.ask(shown, "rag_test", lambda p: p, F.col("passages"), "cot", samples=2).collect()
    assert len(asked) == 2 and all("Question (bi): q" in x["text"] and "1. old" in x["text"] for x in asked)
    with pytest.raises(KeyError):
        P.ask_template("rag_test", "top-k")
    with pytest.raises(KeyError):
        P.noise_template("NLI")


def test_small_pieces(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "id string, at int, v string")
    assert [r["v"] for r in W.latest(rows, ["id"], F.col("at")).collect()] == ["y"]
    typed = spark.createDataFrame([("a", [("c", "Relevant")] * 3), ("b", [("c", "x")])], "id string, passages array<struct<content:string,type:string>>")
    assert [(r["id"], r["types"]) for r in W.passage_types(typed).collect()] == [("a", ["relevant"] * 3)]
    trees = spark.createDataFrame([({"cot": ["c"], "z": ["q"]},), ({"z": ["q"]},)], "m map<string,array<string>>")
    assert [r[0] for r in trees.select(W.preferred_list(F.col("m"))).collect()] == [["c"], ["q"]]
