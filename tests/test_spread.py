"""Responses are parsed by all cores, whatever few bytes their prompts have."""

from pyspark.sql import functions as F

from plumbline.plans import workflows as W
from plumbline.plans.bindings import view
from plumbline.plans.queries import QUERIES


def test_responses_lie_in_many_partitions(spark, sf_dir):
    rows = view(spark, sf_dir, "resp").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in rows) <= sum(r["n"] for r in rows) / 4
    assert view(spark, sf_dir, "resp").select("prompt", "s").distinct().count() == sum(r["n"] for r in rows)


def test_parsing_stage(spark, sf_dir):
    parts = QUERIES["normalize_block"](spark, sf_dir).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= spark.sparkContext.defaultParallelism


def test_ruled_rows_are_short(spark):
    """Contents and questions join the chosen responses only; items that share an id give one triple."""
    good = "Step 1: a\nStep 4: b\nPassage Classifications:\n1. Highly Relevant\n2. Relevant\n3. Irrelevant\n\nAnswer: Rome\nConfidence: 90%"
    responses = spark.createDataFrame([("a", m, 0, good, False) for m in "xy"], "id string, model string, sample_id int, text string, distill boolean")
    types = ["gt_passage", "relevant", "irrelevant"]
    items = spark.createDataFrame([("a", q, types, [q * 1000] * 3, ["Rome"]) for q in ("q2", "q1")], "id string, question string, types array<string>, contents array<string>, truths array<string>")
    out = W.curate(responses, items, "Do.", "Q {question}")
    assert not {"question", "contents"} & set(out.ruled.columns)
    plan = out[0]._jdf.queryExecution().optimizedPlan().toString()
    printed = plan.count("== Final Plan ==") + plan.count("== Initial Plan ==")  # of the persisted rows
    assert plan.count("Generate explode") == printed >= plan.count("InMemoryRelation") > 0  # no branch parses again
    assert sorted((r["model"], r["input"]) for r in out[0].collect()) == [("x", "Q q1"), ("y", "Q q1")]
    out.close()
    facts = W.curate(responses, items.where("question = 'q2'"), "Do.", "{facts}")
    assert all(r["input"].startswith("1: q2q2") for r in facts[0].collect())
    facts.close()
