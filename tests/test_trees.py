"""Trees of unknown shape, arrays of any size, files continued in place, positions in file order, the ledger of requests."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import json_io as J
from plumbline.sources import trees as V
from plumbline.sources.array_sink import write_array
from plumbline.sources.responder import respond_once


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


TREE = {"ckpt_test": ["s0", "s1"], "base_pure": {"cot": ["c0"], "vanilla": ["v0"]}, "rag_test": {"bm25-facts": {"z": ["z0"], "a": "no list"}}, "none": None, "empty": [], "flat": {"a": "x"}}


def test_paths(spark, tmp_path):
    put(tmp_path / "in.json", [{"id": "1", "response": TREE}, {"id": 2, "response": TREE}])
    rows = V.items(V.read_texts(spark, str(tmp_path)))
    paths = [["response", "ckpt_test"], ["response", "ckpt_test", 1], ["response", "base_pure"], ["response", "base_pure", "cot"], ["response", "rag_test", "bm25-facts"],
             ["response", "none"], ["response", "empty"], ["response", "flat"], ["response", "flat", "a"]]
    got = {(r["id"], r["path_key"]): r["text"] for r in V.project(rows, paths).collect()}
    want = {"ckpt_test": "s0", "ckpt_test/1": "s1", "base_pure": "v0", "base_pure/cot": "c0", "rag_test/bm25-facts": "z0", "flat/a": "x"}
    assert got == {(i, f"response/{k}"): v for i in ("1", "2") for k, v in want.items()}


@pytest.mark.parametrize("path", [["response", "nowhere"], ["response", "ckpt_test", 2], ["response", "ckpt_test", "key"], ["answer"], ["response", "none", "x"]])
def test_missing_path_raises(spark, tmp_path, path):
    put(tmp_path / "in.json", [{"id": "1", "response": TREE}])
    rows = V.items(V.read_texts(spark, str(tmp_path)))
    with pytest.raises(Exception, match="path not found"):
        V.project(rows, [path]).collect()
    assert V.project(rows, [path], missing="skip").collect() == []


def test_paths_by_file_name(spark, tmp_path):
    for name in ("m_vanilla", "m_cot", "m_other"):
        put(tmp_path / f"{name}.json", [{"id": "1", "response": {"base_pure": {"cot": ["c0"], "vanilla": ["v0"]}}}])
    got = {r["file"]: (r["path_key"], r["text"]) for r in V.project(V.items(V.read_texts(spark, str(tmp_path))), [["response", "base_pure"]], by_file=True).collect()}
    assert got == {"m_vanilla.json": ("response/base_pure/vanilla", "v0"), "m_cot.json": ("response/base_pure/cot", "c0"), "m_other.json": ("response/base_pure", "v0")}


def test_list_and_object_forms(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "1", "v": 1}, {"v": 2}, {"id": "1", "v": 3}, {"id": "2", "v": 4}, 5])
    put(tmp_path / "b.json", {"z": {"id": "1", "v": 6}, "y": {"v": 7}, "x": "text", "a": {"id": "1", "v": 8}})
    put(tmp_path / "c.json", "no json")
    put(tmp_path / "d.json", [])
    got = V.load(spark, str(tmp_path)).select("file", "id", F.variant_get("item", "$.v", "int").alias("v")).collect()
    assert {tuple(r) for r in got} == {("a.json", "1", 3), ("a.json", "2", 4), ("b.json", "1", 8)}
    os.mkdir(tmp_path / "empty")
    with pytest.raises(ValueError):
        V.load(spark, str(tmp_path / "empty"))


def left_over(folder):
    return [n for n in os.listdir(folder) if "parts" in n]


def test_array_of_any_size(spark, tmp_path):
    n, path = 1_000_000, str(tmp_path / "out.json")
    rows = spark.range(0, n, 1, 7).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit('ü"'), F.col("id").cast("string"))).alias("a b.c"))
    write_array(rows, path)
    with open(path) as f:
        got = json.load(f)
    assert [r["id"] for r in got] == list(range(n)) and got[0] == {"id": 0, "a b.c": None} and got[1]["a b.c"] == 'ü"1'
    write_array(rows.limit(0), path)
    assert json.load(open(path)) == [] and left_over(tmp_path) == []


def test_failed_write_leaves_the_old_array(spark, tmp_path):
    path = put(tmp_path / "out.json", [{"id": 7}])
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("cut"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="cut"):
        write_array(bad, path)
    assert json.load(open(path)) == [{"id": 7}] and left_over(tmp_path) == []


def test_continue_in_place(spark, tmp_path):
    source = put(tmp_path / "in.json", [{"id": str(i), "question": f"q{i}", "gt_answer": ["x"]} for i in range(9)])
    out = str(tmp_path / "out.json")
    first = J.slice_items(J.read_items(spark, source), 2, 5).select("id", F.array(F.lit("first")).alias("answer"))
    assert J.continue_in_place(spark, first, source, out) == 9
    bad = spark.createDataFrame([("4", ["y"]), ("5", ["y"])], "id string, answer array<string>").withColumn("answer", F.when(F.col("id") == "5", F.raise_error(F.lit("cut"))).otherwise(F.col("answer")))
    with pytest.raises(Exception, match="cut"):
        J.continue_in_place(spark, bad, source, out)
    second = spark.createDataFrame([("new", ["n"], 1), ("4", ["second"], 2)], "id string, answer array<string>, mark int")
    assert J.continue_in_place(spark, second, source, out) == 10
    got = json.load(open(out))
    assert [r["id"] for r in got] == [*map(str, range(9)), "new"]
    assert [r["answer"] for r in got] == [None, None, ["first"], ["first"], ["second"], None, None, None, None, ["n"]]
    assert got[0]["question"] == "q0" and got[4]["question"] == "q4" and got[4]["mark"] == 2 and got[3]["mark"] is None
    with pytest.raises(ValueError):
        J.continue_in_place(spark, second.unionAll(second), source, out)


def test_positions_follow_file_names(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "a0", "question": "q"}])
    put(tmp_path / "b.json", [{"id": f"b{i}", "question": "q" * 50} for i in range(50)])
    put(tmp_path / "c.json", [{"id": "c0"}, {"id": "c1"}])
    rows = J.with_position(J.read_items(spark, str(tmp_path))).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] == ["a0", *(f"b{i}" for i in range(50)), "c0", "c1"]
    assert sorted(r["position"] for r in rows) == list(range(53))
    assert {r["id"] for r in J.slice_items(J.read_items(spark, str(tmp_path)), 0, 2).collect()} == {"a0", "b0"}


def calls(folder):
    return [open(f"{folder}/{n}").read() for n in os.listdir(folder)]


def flaky_responder(folder):
    """Fails for a third of the calls, and writes down each call that it answers."""

    def answer(prompt):
        if random.random() < 1 / 3:
            raise RuntimeError("busy")
        with open(f"{folder}/{random.getrandbits(64):x}", "w") as f:
            f.write(prompt)
        return f"re: {prompt}"

    return answer


def test_every_key_is_answered_once(spark, tmp_path):
    os.mkdir(tmp_path / "calls")
    prompts = spark.range(0, 200, 1, 5).select("id", (F.col("id") % 2).alias("sample"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    flaky, ledger = flaky_responder(str(tmp_path / "calls")), str(tmp_path / "ledger")
    part = respond_once(prompts.where("id < 120"), flaky, ledger, ["id", "sample"], rounds=1, batch=7, tasks=3).collect()
    assert {r["status"] for r in part} == {"ok", "RuntimeError: busy"} and all((r["text"] is None) == (r["status"] != "ok") for r in part)
    got = respond_once(prompts, flaky, ledger, ["id", "sample"], rounds=30, batch=7, tasks=3).collect()
    assert {(r["id"], r["text"], r["status"]) for r in got} == {(i, f"re: p{i}", "ok") for i in range(200)}
    assert sorted(calls(tmp_path / "calls")) == sorted(f"p{i}" for i in range(200))
    with pytest.raises(ValueError):
        respond_once(prompts.unionAll(prompts), flaky, ledger, ["id"])


DEADLY = """
import os, random
from pyspark.sql import SparkSession, functions as F
from plumbline.sources.responder import respond_once

def deadly(prompt):  # kills its Python worker once on the way
    if prompt == "p77" and not os.path.exists("{folder}/died"):
        open("{folder}/died", "w").close()
        os._exit(1)
    with open("{folder}/calls/%x" % random.getrandbits(64), "w") as f:
        f.write(prompt)
    return prompt

spark = SparkSession.builder.master("local[2, 4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.range(0, 100, 1, 2).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
got = respond_once(rows, deadly, "{folder}/ledger", ["id"], rounds=1, tasks=2, batch=5, threads=1).collect()
assert sorted(r["text"] for r in got) == sorted("p%d" % i for i in range(100))
"""


def test_a_task_that_is_run_again_reads_the_ledger(tmp_path):
    """With task retries (local[n, failures]) only the batch under way is asked again."""
    import subprocess
    import sys
    from pathlib import Path

    os.mkdir(tmp_path / "calls")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run([sys.executable, "-c", DEADLY.format(folder=tmp_path)], env=env, timeout=300, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    said = calls(tmp_path / "calls")
    assert set(said) == {f"p{i}" for i in range(100)} and len(said) <= 104 and (tmp_path / "died").exists()
