"""A value of one owner is live in however many documents; exact copies are one repository."""

from plumbline.llm.queries import op10_secrets

ONE, COPIED, TWO, MANY = "tR7xQ2mZp9LkV4sWb8Nd", "Qw8zLk3Xv7Tn2Rb6Yc4M", "Hy5mKp2Zs8Vd4Xj9Wq3T", "Ex4mpleT0kenV4lueAbCd"


def test_owners_decide(spark, tmp_path):
    rows = [(i, f"page {i} {ONE}", "a") for i in range(80)]
    rows += [(100 + i, f"same page {COPIED}", "ab"[i % 2]) for i in range(80)]  # two owners, one text each
    rows += [(200 + i, f"page {i} {TWO}", "ab"[i % 2]) for i in range(80)]  # two owners, 80 repositories
    rows += [(300 + i, f"page {i} {MANY}", "abc"[i % 3]) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in op10_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        at = text.rindex(" ") + 1
        assert got[i] == (f"live:{at}:{at + 20}" if i < 200 else "")
