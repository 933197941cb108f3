"""Columns of the caller that have the operators' own names come back unchanged."""

from plumbline.llm.decontam import matches
from plumbline.llm.linededup import drop_lines


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, "s", f"menu\nown line {i}", 7, "d", 8, 9, 10, 11) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _host int, _drop string, _salt int, _kept int, _n_lines int, _n_dropped int")
    for most in (200_000, 0):  # broadcast, and salted join
        out = drop_lines(df, "source", "text", broadcast_lines=most, salts=3)
        assert out.columns == [*df.columns, "_n_lines_", "_n_dropped_"]
        for r in out.collect():
            assert r["text"] == f"own line {r['doc_id']}" and (r["_n_lines_"], r["_n_dropped_"]) == (2, 1)
            assert (r["_host"], r["_drop"], r["_salt"], r["_kept"], r["_n_lines"], r["_n_dropped"]) == (7, "d", 8, 9, 10, 11)


def test_decontamination_keeps_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "m", 5), (2, "nothing of the kind here at all", "m", 5)], "doc_id long, text string, _matches string, _row int")
    bench = spark.createDataFrame([(1, text), (2, "other words that stand in no document whatever"), (3, text + " eleven")], "item_id long, text string")
    for most in (20_000, 1):  # one slice, and several
        out = matches(docs, bench, max_items=most)
        got = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == [*docs.columns, "_matches_"] and len(got) == 2
        assert [m["item_id"] for m in got[1]["_matches_"]] == [1, 3] and got[2]["_matches_"] == []
        assert all((r["_matches"], r["_row"]) == ("m", 5) for r in got.values())
