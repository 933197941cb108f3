"""What parsing a response costs: each line is matched once."""

from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions import text as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_matched_once(spark):
    texts = spark.createDataFrame([("x",)], "t string")
    assert plan(texts.select(L.label_block(F.col("t")).alias("x"))).count(L.LIST_ITEM) == 1
    assert plan(texts.select(L.normal_block(F.col("t")).alias("x"))).count(L.LIST_ITEM) == 2  # for its labels, and where it ends


def test_strip_knows_all_white_space(spark):
    """As the pattern did, for every character of the basic plane, in runs and mixed, and at both ends only."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c + " " + c + "a" + c + "b" + c + "\n" + c,) for c in chars] + [("",), (" 　",), (None,)], "t string")
    same = T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert rows.where(~same).count() == 0
    assert "regexp_replace" not in plan(rows.select(T.strip(F.col("t"))))


def test_lines_end_at_any_line_end(spark):
    texts = ["a\r\nb\n\nc\n", "a\rb", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\x1fb c", "", "\n", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in rows.select("i", L._lines(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [["a", "b", "", "c"], ["a", "b"], list("abcdefghi"), ["a\x1fb c"], [], [""], None]
