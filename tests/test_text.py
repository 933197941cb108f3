"""Hand-derived values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import extract as E
from plumbline.functions import labels as L
from plumbline.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def s(x):
    return F.lit(x).cast("string")


def arr(*xs):
    return F.array(*[s(x) for x in xs])


@pytest.mark.parametrize(
    ("text", "want"),
    [("The Eiffel-Tower, a  landmark!", "eiffeltower landmark"), ("", ""), ("a an the", ""), ("Ä the é", "ä é"), (None, None)],
)
def test_normalize(spark, text, want):
    assert value(spark, T.normalize(s(text))) == want


def test_f1(spark):
    assert value(spark, T.token_f1(s("new york city"), s("york city"))) == pytest.approx(0.8)
    assert value(spark, T.token_f1(s("the, a!"), s("york"))) == 0.0
    assert value(spark, T.token_f1(s("b b c"), s("b b b"))) == pytest.approx(2 / 3)


@pytest.mark.parametrize(
    ("pred", "truths", "want"),
    [("It is Paris.", ["Paris"], True), ("x", ["N/A"], False), ("new york city", ["N/A", "york city"], True), ("", ["a"], False), (None, ["a"], False), ("x", [], False), ("x", [""], True)],
)
def test_judge(spark, pred, truths, want):
    assert value(spark, T.judge(s(pred), arr(*truths) if truths else F.array().cast("array<string>"))) is want


def test_judge_yes_no(spark):
    assert value(spark, T.judge_bool(s("I don't know"), F.lit(False))) is True
    assert value(spark, T.judge_bool(s("Yes, no"), F.lit(True))) is True
    assert value(spark, T.judge_bool(s("maybe"), F.lit(True))) is False


@pytest.mark.parametrize(
    ("text", "unit", "percent", "rank"),
    [("85%", 0.85, 85.0, 0.85), ("0.85", 0.85, 85.0, 0.0085), ("1", 1.0, 100.0, 0.01), ("high", None, None, 0.0), (None, None, None, 0.0), ("-3", 0.0, 0.0, 0.0), (" 250 % ", 1.0, 100.0, 1.0)],
)
def test_confidences(spark, text, unit, percent, rank):
    got = spark.range(1).select(T.confidence_unit(s(text)), T.confidence_percent(s(text)), T.confidence_rank(s(text))).first()
    assert [pytest.approx(x) if x is not None else None for x in (unit, percent, rank)] == list(got)


def test_bins(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("u"), F.col("id").cast("double").alias("p"))
    got = {int(r[2]): (r[0], r[1]) for r in rows.select(T.calibration_bin(F.col("u")), T.reliability_bin(F.col("p")), "p").collect()}
    assert {p for p, (a, b) in got.items() if a != b} == {30, 60, 70}
    assert got[0] == (0, 0) and got[100] == (9, 9)


@pytest.mark.parametrize(("text", "want"), [("High", 90.0), ("moderate", 50.0), ("below", 10.0), ("-5%", -5.0), (None, 0.0), ("highly low", 10.0)])
def test_confidence_words(spark, text, want):
    assert value(spark, T.confidence_words(s(text))) == want


@pytest.mark.parametrize(("n", "want"), [(0, "10-50"), (25, "10-50"), (45, "20-60"), (55, "40-80"), (100, "80-120"), (300, "180-220")])
def test_word_range(spark, n, want):
    assert value(spark, T.word_range(F.lit(n))) == want


def test_sentences(spark):
    assert value(spark, T.sentence_count(s("A. B! C?"))) == 3
    assert value(spark, T.sentence_range(F.lit(3))) == "2-4"
    assert value(spark, T.sentence_range(F.lit(0))) == "1-2"


def test_facts_and_templates(spark):
    assert value(spark, T.numbered_facts(arr("a", "b", "a"))) == "1. a\n2. b\n1. a"
    assert value(spark, T.training_facts(arr("x", "y"))) == "1: x\n\n2: y\n"
    assert value(spark, T.render("{a}-{b}", {"a": s("{b}"), "b": s("z")})) == "{b}-z"
    with pytest.raises(KeyError):
        T.render("{missing}", {})


def test_truths(spark):
    none = F.lit(None).cast("array<string>")
    assert value(spark, T.ordered_union([arr("a", "N/A"), none, arr("", "b", "a")], arr("N/A", "c"))) == ["a", "b", "N/A", "c"]
    assert value(spark, T.evaluation_truths(none, arr("x", "x"), arr("y"), none)) == ["x", "x"]
    assert value(spark, T.evaluation_truths(none, arr("x"), arr("y"), arr("x", "z"))) == ["x", "z"]


@pytest.mark.parametrize(("text", "want"), [("##Highly relevant##", "Highly Relevant"), ("Irrelevant", "Irrelevant"), (" relevant ", "Relevant"), ("other", None), ("", None)])
def test_canonical(spark, text, want):
    assert value(spark, L.canonical_label(s(text))) == want


def test_groups(spark):
    assert value(spark, L.prompt_group(arr("counterfactual", "gt_passage", "relevant"))) == "counterfactual"
    assert value(spark, L.prompt_group(arr("relevant", "relevant"))) == "unknown"
    assert value(spark, L.evaluation_group(arr("Relevant", "relevant"))) == "relevant_irrelevant"
    assert value(spark, L.expected_labels(arr("gt_passage", "relevant", "odd"))) is None


def test_generated_passages(spark):
    got = value(spark, E.generated_passages(s("Passage 1: p\nTopic 1: t\nPassage 2: q"), "irrelevant"))
    assert [tuple(x) for x in got] == [("p", "irrelevant", "t")]
    got = value(spark, E.generated_passages(s("Passage 1 alone\nAlternative Expression 1: x\nAlternative Expression 2: y\nmore"), "consistent"))
    assert [tuple(x) for x in got] == [("Passage 1 alone", "consistent", "y")]


def test_append_last(spark):
    assert value(spark, E.append_last(F.lit(None).cast("array<string>"), arr("a", "b"))) == ["a", "b"]
    assert value(spark, E.append_last(arr("o"), arr("a", "b", "c", "d"))) == ["o", "b", "c", "d"]


def test_extraction_cascade(spark):
    text = "**Final Answer**: ##Rome##\n**Final Confidence**: ##90%##"
    row = E.extract(spark.createDataFrame([(text,), ("nothing",)], "text string"), E.SPECS["default"], unmatched="empty_0").orderBy("matched").collect()
    assert (row[0]["answer"], row[0]["confidence"]) == ("", "0")
    assert (row[1]["answer"], row[1]["confidence"]) == ("Rome", "90")
    multi = "Answer: one\nAnswer: two\nStep 1 Confidence: 30%\nStep 2 Confidence: 70%"
    got = E.extract(spark.createDataFrame([(multi,)], "text string"), E.spec_for("rag_test", "multi-step")).first()
    assert (got["answer"], got["confidence"]) == ("two", "30")
    with pytest.raises(ValueError):
        E.spec_for("base_sample")


def test_label_recovery(spark):
    none = [F.lit(None).cast("string")] * 3
    text = s("Passage 1 is irrelevant. The second passage: ##Relevant##. And one is Highly Relevant")
    got = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(L.recover_labels(text, none))]).first()
    assert list(got) == ["##Irrelevant##", "##Relevant##", "##Relevant##"]
    got = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(L.recover_labels(s("nothing"), none))]).first()
    assert list(got) == ["", "", ""]
