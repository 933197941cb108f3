"""One pass for all metrics: empty and null groups, data sets taken together, float scores without keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as K
from plumbline.operators import metrics as M

EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def unit(c):
    try:
        x = float(c.strip().replace("%", ""))
    except (ValueError, AttributeError):
        return None
    return min(max(x / 100 if x > 1 else x, 0), 1)


def rank(c):
    try:
        return min(max(float(c.strip().strip("%")) / 100, 0), 1)
    except (ValueError, AttributeError):
        return 0.0


def plain(rows):
    """accuracy, ave_conf, ece, auroc, auprc of (confidence, correct) rows, each by its definition."""
    judged = [ok for _, ok in rows if ok is not None]
    units = [unit(c) for c, _ in rows if unit(c) is not None]
    scored = [(unit(c), ok) for c, ok in rows if unit(c) is not None and ok is not None]
    bins = [[x for x in scored if sum(x[0] >= e for e in EDGES) == b] for b in range(10)]
    ece = sum(abs(sum(c for c, _ in b) - sum(ok for _, ok in b)) for b in bins) / len(scored) if scored else 0.0
    ranks = [(rank(c), ok) for c, ok in rows if ok is not None]
    pos, neg = [c for c, ok in ranks if ok], [c for c, ok in ranks if not ok]
    if not ranks:
        auroc = auprc = 0.0
    elif not pos or not neg:
        auroc = auprc = math.nan
    else:
        auroc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        auprc, before = 0.0, (0.0, 1.0)
        for t in sorted({c for c, _ in ranks}, reverse=True):
            hit, all_ = sum(c >= t for c in pos), sum(c >= t for c, _ in ranks)
            now = (hit / len(pos), hit / all_)
            auprc += (now[0] - before[0]) * (now[1] + before[1]) / 2
            before = now
    return [sum(judged) / len(judged) if judged else 0.0, sum(units) / len(units) if units else 0.0, ece, auroc, auprc]


NAMES = ["accuracy", "ave_conf", "ece", "auroc", "auprc"]


def same(got, want):
    return all(math.isnan(a) and math.isnan(b) if math.isnan(b) else a == pytest.approx(b) for a, b in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(f"{r.randrange(0, 101)}%", r.random() < 0.5, "a", r.choice(["m", "n", None]), r.choice(["d1", "d2", None])) for _ in range(600)]
    out += [(r.choice(["none", "n/a", None]), r.random() < 0.5, "a", "mute", "d1") for _ in range(9)]  # no readable confidence
    out += [("50%", None, "", "unjudged", "d1")] * 3 + [("70", True, "x", "right", "d2")] * 2 + [("0.7", True, "x", "right", "d2")]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "confidence string, correct boolean, answer string, model string, dataset string")


def test_null_and_empty_groups(frame, rows):
    got = {r["model"]: r for r in M.evaluate(frame, ["model"]).collect()}
    assert set(got) == {r[3] for r in rows} and None in got
    for model, r in got.items():
        own = [(c, ok) for c, ok, _, m, _ in rows if m == model]
        assert same([r[n] for n in NAMES], plain(own))
        assert len(r["reliability_diagram"]) == 10
        assert sum(b["total"] for b in r["reliability_diagram"]) == sum(unit(c) is not None and ok is not None for c, ok in own)
    assert got["mute"]["ece"] == 0.0 and got["unjudged"]["accuracy"] == 0.0 and math.isnan(got["right"]["auroc"])
    assert got["unjudged"]["valid_sample_portion"] == "0/3 (0.0%)"


def test_merged_data_sets(frame, rows):
    got = M.evaluate(frame, ["model", "dataset"], NAMES, merge=["dataset"]).collect()
    assert len(got) == len({(r[3], r[4]) for r in rows}) + len({r[3] for r in rows})
    for r in got:
        own = [(c, ok) for c, ok, _, m, d in rows if m == r["model"] and (r["merged"] or d == r["dataset"])]
        assert same([r[n] for n in NAMES], plain(own))
    with pytest.raises(ValueError):
        M.evaluate(frame, ["model"], NAMES, merge=["dataset"])


def test_one_scan(frame, tmp_path, spark):
    frame.write.parquet(f"{tmp_path}/rows")
    out = M.evaluate(spark.read.parquet(f"{tmp_path}/rows"), ["model", "dataset"], [*NAMES, "reliability_diagram", "valid_sample_portion"], adaptive=True, merge=["dataset"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BatchScan" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_floats_without_keys(spark, n):
    r = random.Random(n)
    rows = [(repr(r.choice([r.random() * 100, 40.0, 99.99999, 140.0])), r.random() < 0.6) for _ in range(n)]
    df = spark.createDataFrame(rows, "confidence string, correct boolean").withColumn("answer", F.lit("a")).repartition(5)
    got = M.evaluate(df, [], NAMES).first()
    assert same([got[x] for x in NAMES], plain(rows))
    deciles = M.ece(df, [], F.col("confidence"), F.col("correct"), adaptive=True).first()[0]
    keyed = M.ece(df.withColumn("k", F.lit(1)), ["k"], F.col("confidence"), F.col("correct"), adaptive=True).first()
    assert deciles == pytest.approx(keyed["ece"] if keyed else 0.0)
    if n:
        edges = K.quantile_edges(K.state(df, [], F.col("correct"), F.col("confidence")), "unit", "judged").first()[0]
        import numpy as np

        want = np.unique(np.percentile([unit(c) for c, _ in rows], np.linspace(0, 100, 11)))
        assert len(edges) == len(want) and edges == pytest.approx(want.tolist())


def test_no_single_partition_window(spark):
    df = spark.createDataFrame([("1", True)], "confidence string, correct boolean")
    for metric in (M.auroc, M.auprc):
        plan = metric(df, [], F.col("confidence"), F.col("correct"))._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" in plan and all("_slot" in line for line in plan.split("\n") if "Window [" in line)


def test_adaptive_null_keys_and_groups(spark):
    rows = [("80%", True, None, ["relevant"]), ("60%", False, None, ["gt_passage"]), ("60%", True, "m", ["counterfactual"]), ("bad", True, "m", ["consistent"])]
    df = spark.createDataFrame(rows, "confidence string, correct boolean, model string, types array<string>").withColumn("answer", F.lit("a"))
    got = {r["model"]: r for r in M.evaluate(df, ["model"], ["ece", "ece_by_group", "accuracy_by_group"], places=2, adaptive=True).collect()}
    assert got[None]["ece"] == pytest.approx(0.4) and got["m"]["ece"] == pytest.approx(0.4)
    values = lambda m, c: {g["grp"]: g["value"] for g in got[m][c]}
    assert values(None, "ece_by_group") == {"counterfactual": None, "consistent": 0.6, "relevant_irrelevant": 0.2}
    assert values("m", "ece_by_group") == {"counterfactual": 0.4, "consistent": None, "relevant_irrelevant": None}
    assert values("m", "accuracy_by_group") == {"counterfactual": 1.0, "consistent": 1.0, "relevant_irrelevant": None}


def test_own_metric(frame, monkeypatch):
    monkeypatch.setitem(K.METRICS, "rows", lambda adaptive: F.sum("n"))
    assert M.evaluate(frame, [], ["rows", "accuracy"]).first()["rows"] == frame.count()
