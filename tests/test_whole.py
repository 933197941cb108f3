"""Registered queries see whole texts and all rows: checked in plain Python, apart from their SQL."""

import math
import re

from plumbline.plans.bindings import view
from plumbline.plans.queries import QUERIES


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def word_range(n):
    if n <= 0:
        return "10-50"
    low, high = max(n - 20, 10), 50 if n - 20 < 10 else n + 20
    low = 180 if high > 220 else low
    return f"{round(low / 10) * 10}-{round(min(high, 220) / 10) * 10}"


def test_passages_are_whole_texts(spark, sf_dir):
    docs = texts(spark, sf_dir)
    got = {r["doc_id"]: r["content"] for r in view(spark, sf_dir, "passages").select("doc_id", "content").collect()}
    assert got == docs and max(map(len, docs.values())) > 60


def test_render_prompts_shows_whole_texts(spark, sf_dir):
    docs = texts(spark, sf_dir)
    for r in QUERIES["render_prompts"](spark, sf_dir).collect():
        assert r["shown"].split("\n", 1)[1] == docs[3 * r["prompt"]]


def test_noise_prompts_measure_whole_texts(spark, sf_dir):
    docs, ranges = texts(spark, sf_dir), set()
    for r in QUERIES["noise_prompts"](spark, sf_dir).collect():
        text = docs[3 * r["prompt"]]
        k = min(max(sum(bool(x.strip()) for x in re.split("[.!?]+", text)), 1), 8)
        ranges.add(word_range(len(text.split())))
        assert f"of {max(k - 1, 1)}-{k + 1} sentences and {word_range(len(text.split()))} words" in r["shown"]
    assert "180-220" in ranges  # beyond what a prefix of 60 characters holds


def test_evaluate_responses_scores_every_response(spark, sf_dir):
    hits, units = {}, {}
    for r in view(spark, sf_dir, "resp").select("s", "text").collect():
        answer, conf = re.search(r"(?i)answer:\s*([^\n]*)", r["text"]), re.search(r"(?i)confidence:\s*(\d+)\s*%", r["text"])
        if answer and conf:
            x = float(conf[1])
            hits.setdefault(r["s"], []).append(answer[1] == "alpha river")
            units.setdefault(r["s"], []).append(x / 100 if x > 1 else x)
    got = {r["model"]: (r["accuracy"], r["ave_conf"]) for r in QUERIES["evaluate_responses"](spark, sf_dir).collect()}
    assert set(got) == set(hits)
    for s, (accuracy, ave_conf) in got.items():
        assert math.isclose(accuracy, sum(hits[s]) / len(hits[s])) and math.isclose(ave_conf, sum(units[s]) / len(units[s]))
