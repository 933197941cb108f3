"""Label blocks: hand-made texts with their labels, and properties that hold for any text."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import labels as L

H, R, N = L.LABELS
TEXTS = [
    ("Passage Classifications:\n1. Highly Relevant\n2. Relevant\n3. Irrelevant\nAnswer: x", [H, R, N]),
    ("Step 1: read\npassage classifications: 1. relevant 2. irrelevant 3. highly relevant\nAnswer: x", [R, N, H]),
    ("Passage Classifications:\n1. ##Relevant##\n2. ##Irrelevant##\n3. ##Highly Relevant##", [R, N, H]),
    ("PASSAGE CLASSIFICATIONS\n  1. Relevant  \n\n a remark\n2. IRRELEVANT\n3. relevant\nConfidence: 50%", [R, N, R]),
    ("1. Irrelevant\n2. Irrelevant\n3. Irrelevant\nPassage Classifications:\n1. Relevant\n2. Relevant\n3. Highly relevant", [R, R, H]),
    ("Passage Classifications:\n1. Relevant\n2. Relevant\n3. Irrelevant\n4. Highly Relevant", [R, R, N]),
    ("Passage Classifications:\n1. Relevant\n2. Irrelevant\nAnswer: x", None),
    ("Passage Classifications:\n1. Relevant\nFinal Answer: x\n2. Relevant\n3. Relevant", None),
    ("Passage Classifications:\n1. unsure\n2. Relevant\n3. Relevant\n4. Relevant", None),
    ("Passage Classifications:\n## done\n1. Relevant\n2. Relevant\n3. Relevant", None),
    ("1. Relevant\n2. Relevant\n3. Relevant", None),
    ("", None),
    (None, None),
]


def read(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", L.normal_block(F.col("t")))
    got = rows.select("i", "n", L.label_block(F.col("t")).alias("a"), L.label_block(F.col("n")).alias("b")).orderBy("i").collect()
    return [(r["a"], r["n"], r["b"]) for r in got]


@pytest.mark.parametrize(("text", "labels"), TEXTS)
def test_hand_made_texts(spark, text, labels):
    assert read(spark, [text])[0][0] == labels


def test_every_order_of_labels_is_kept(spark):
    orders = list(itertools.product(L.LABELS, repeat=3))
    texts = [f"before\nPassage Classifications:\n1. {a}\n2. {b}\n3. {c}\nAnswer: 1. {c} 2. {b}" for a, b, c in orders]
    assert [a for a, _, _ in read(spark, texts)] == [list(x) for x in orders]


LINES = st.sampled_from(["Passage Classifications:", "passage classifications: 1. Relevant 2. irrelevant", "1. Highly Relevant", "2. relevant", "3. Irrelevant", "  2. ##Irrelevant##",
                         "1. odd", "## end", "Answer: x", "Confidence: 50%", "free text", "", "1. Relevant 2. Irrelevant 3. Highly relevant"])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(bodies=st.lists(st.lists(LINES, min_size=1, max_size=9).map("\n".join), min_size=150, max_size=200))
def test_properties(spark, bodies):
    before = "some words\nof an introduction\n"
    for t, (labels, normal, again), (same, moved, _) in zip(bodies, read(spark, bodies), read(spark, [before + t for t in bodies]), strict=True):
        assert labels is None or (len(labels) == 3 and set(labels) <= set(L.LABELS)), t
        assert same == labels and moved == before + normal, t  # what stands before a block has no part in it and stays
        if labels is None:
            assert normal == t
        else:
            assert again == labels and "Passage Classifications:" in normal.splitlines(), t
