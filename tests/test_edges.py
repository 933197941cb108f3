"""JSON edges, responders and streaming bins."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import json_io as J
from plumbline.sources.responder import Echo, endpoint, replicas, respond
from plumbline.streaming.calibration import error_of, windowed_bins


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_items_and_slices(spark, tmp_path):
    p = put(tmp_path / "a_modelx.json", [{"id": str(i), "question": f"q{i}", "gt_answer": ["x"], "passages": [{"content": "c", "type": "relevant", "Topic": "t"}]} for i in range(7)])
    items = J.read_items(spark, p)
    assert items.count() == 7 and items.first()["passages"][0]["Topic"] == "t"
    assert {r["id"] for r in J.slice_items(items, 2, 4).collect()} == {"2", "3"}
    assert J.slice_items(items, 5, 0).count() == 2 and J.slice_items(items, 6, 3).count() == 0
    assert J.slice_items(items.limit(3), 2, 1).count() == 3
    assert items.select(J.model_of(F.col("file"))).first()[0] == "modelx"


def test_resume(spark, tmp_path):
    a = put(tmp_path / "in.json", [{"id": "1", "question": "q"}])
    b = put(tmp_path / "out.json", [{"id": "1", "question": "q"}])
    c = put(tmp_path / "bad.json", [{"x": 1}])
    assert J.resume_source(spark, a, b) == b and J.resume_source(spark, a, c) == a
    assert J.resume_source(spark, a, str(tmp_path / "none.json")) == a and J.resume_source(spark, a, c, check=False) == c


def test_extracted_and_responses(spark, tmp_path):
    p = put(tmp_path / "e.json", {"response/x": [{"id": "1", "answer": "a", "confidence": "80", "true_answer": ["a"]}], "response/y": []})
    rows = J.read_extracted(spark, p).collect()
    assert [(r["path_key"], r["id"], r["true_answer"]) for r in rows] == [("response/x", "1", ["a"])]
    tree = {"ckpt_test": ["s0", "s1"], "base_pure": {"cot": ["c0"]}, "rag_test": {"bm25-facts": {"vanilla": ["v0", "v1"]}}}
    long = J.flatten_responses(spark, put(tmp_path / "r.json", [{"id": "1", "response": tree}]))
    assert long.count() == 5
    assert json.loads(J.nest_responses(long).first()["response"]) == tree


def test_lists_and_sinks(spark, tmp_path):
    for n in ("x_m1.json", "y_m2.json", "z.txt"):
        (tmp_path / n).write_text("[]")
    files = J.list_files(spark, str(tmp_path), ["m1", "m2"])
    assert files.count() == 2
    done = spark.createDataFrame([("x_m1.json",)], "file string")
    assert [r["file"] for r in J.pending(files, done).collect()] == ["y_m2.json"]
    df = spark.createDataFrame([("a_b", 3, None)], "model string, kept long, note string")
    assert json.loads(J.array_text(df)) == [{"model": "a_b", "kept": 3, "note": None}]
    with pytest.raises(ValueError):
        J.array_text(spark.range(5), limit=2)
    assert r"a\_b & 3 \\" in J.latex_table(df, "model", ["kept"])
    metrics = spark.createDataFrame([("m", "t1", 0.5), ("m", "t2", 0.25)], "model string, task string, accuracy double")
    doc = J.metrics_documents(metrics).first()
    assert doc["model_name"] == "m" and set(json.loads(doc["tasks"])) == {"t1", "t2"}


def test_responders(spark):
    def broken(prompt):
        raise RuntimeError("no service")

    prompts = replicas(spark.createDataFrame([(1, "p")], "id int, prompt string"), 2)
    got = respond(prompts, Echo()).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["text"], r["status"]) for r in got] == [(0, "Answer: p", "ok"), (1, "Answer: p", "ok")]
    bad = respond(prompts, broken).first()
    assert bad["text"] is None and bad["status"] == "RuntimeError: no service"
    e = endpoint({"m": {"url": "http://localhost:8000/v1"}}, "m", port=9, think_tokens={"m": 5})
    assert e.url == "http://localhost:9/v1" and e.max_tokens == 5
    assert endpoint({"m": {"url": "u"}}, "m").max_tokens == 1024


def test_streaming_bins(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "80%", True), ("2024-01-01 00:20:00", "80%", False), ("2024-01-01 02:00:00", "x", True)], "t string, c string, ok boolean")
    rows.select(F.to_timestamp("t").alias("t"), "c", "ok").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, c string, ok boolean").parquet(str(tmp_path / "in"))
    q = windowed_bins(stream, "t", F.col("c"), F.col("ok")).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = error_of(spark.table("bins")).collect()
    assert [(round(r["ece"], 9), r["n"]) for r in got] == [(0.3, 2)]


def test_positions_over_partitions(spark):
    rows = J.with_position(spark.range(0, 103, numPartitions=7).where("id % 10 <> 3 and not id between 30 and 60")).collect()
    ids = [i for i in range(103) if i % 10 != 3 and not 30 <= i <= 60]
    assert {r["position"]: r["id"] for r in rows} == dict(enumerate(ids))
    assert J.with_position(spark.range(0)).count() == 0
