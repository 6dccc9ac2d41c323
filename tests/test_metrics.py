"""Evaluation on small and degenerate predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.operators import metrics as mt


def pred(spark, rows):
    return spark.createDataFrame(rows, "label INT, score DOUBLE").selectExpr("*", "CAST(score > 0.5 AS INT) AS prediction")


def area(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_curves_match_brute_force(spark):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 2, 400)
    scores = np.round(rng.random(400) * 0.7 + labels * 0.2, 2)
    df = pred(spark, [(int(y), float(s)) for y, s in zip(labels, scores)])
    assert mt.roc_auc(df).first()[0] == pytest.approx(area(labels, scores))
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in mt.roc_curve(df, slices=7).collect()}
    assert points[float("inf")] == (0.0, 0.0)
    for s in set(scores):
        above = scores >= s
        assert points[s] == pytest.approx((above[labels == 0].mean(), above[labels == 1].mean()))
    ap, last = 0.0, 0.0
    for s in sorted(set(scores), reverse=True):
        above = scores >= s
        recall = above[labels == 1].mean()
        ap += (recall - last) * labels[above].mean()
        last = recall
    assert mt.average_precision(df, slices=3).first()[0] == pytest.approx(ap)
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in mt.pr_curve(df).collect()}
    assert curve[min(scores)] == pytest.approx((labels.mean(), 1.0))


def test_all_scores_equal(spark):
    df = pred(spark, [(1, 0.4), (0, 0.4), (0, 0.4)])
    assert mt.roc_auc(df).first()[0] == 0.5
    assert mt.average_precision(df).first()[0] == pytest.approx(1 / 3)
    m = mt.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["fpr"]) == (0.0, 0.0, 0.0, 0.0)


def test_one_class_only(spark):
    df = pred(spark, [(0, 0.9), (0, 0.1)])
    assert mt.roc_auc(df).first()[0] is None
    cells = {(r["label"], r["prediction"]): r["count"] for r in mt.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0}
    assert mt.binary_metrics(df).first()["fpr"] == 0.5
    report = {r["class"]: r for r in mt.classification_report(df).collect()}
    assert report["Attack"]["support"] == 0 and report["Attack"]["f1"] == 0.0
    assert report["weighted avg"]["recall"] == 0.5


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1.5, 4, 10)] + [(None,)], "v DOUBLE")
    got = [r["count"] for r in mt.histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == [3, 0, 1, 0, 1]
    flat = mt.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE"), "v", 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["count"]) for r in flat] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_latency_summary(spark):
    values = [float(v) for v in range(1, 101)]
    got = mt.latency_summary(spark.createDataFrame([(v,) for v in values], "us DOUBLE"), "us").first()
    assert (got["median"], got["max"], got["pct_under_target"]) == (50.5, 100.0, 49.0)
    assert got["p95"] == pytest.approx(np.percentile(values, 95))
    assert got["std"] == pytest.approx(np.std(values))


def test_compare_predictions(spark):
    a = spark.createDataFrame([(i, 1, 0.9) for i in range(100)], "id INT, prediction INT, score DOUBLE")
    b = spark.createDataFrame([(i, int(i > 1), 0.8) for i in range(100)], "id INT, prediction INT, score DOUBLE")
    got = mt.compare_predictions(a, b, "id").first()
    assert got["match_rate"] == pytest.approx(0.98) and not got["passed"]
    assert got["max_abs_diff"] == pytest.approx(0.1)


def test_rows_that_one_scorer_lost_are_mismatches(spark):
    a = spark.createDataFrame([(i, 1, 0.9) for i in range(100)], "id INT, prediction INT, score DOUBLE")
    got = mt.compare_predictions(a, a.where("id < 50"), "id").first()
    assert (got["rows"], got["missing"], got["match_rate"], got["passed"]) == (100, 50, 0.5, False)
    truth = spark.createDataFrame([(i, 0) for i in range(90, 110)], "id INT, label INT")
    joined = mt.join_truth(a, truth, "id")
    assert joined.count() == 110 and joined.where("matched").count() == 10


def test_score_ranges_need_no_cut_points(spark):
    """Running counts over many ranges; the plan holds no list of bounds."""
    rows = spark.range(20000).selectExpr("double((id * 7919) % 20000) AS score", "int(id % 3 = 0) AS label")
    table = mt.score_table(rows, slices=500)
    plan = table._jdf.queryExecution().toString()
    assert len(plan) < 20000 and plan.count("D,") == 0
    got = table.orderBy(F.desc("score")).collect()
    assert len(got) == 20000
    tp = fp = 0
    for r in got:
        tp, fp = tp + r["pos"], fp + r["neg"]
        assert (r["tp"], r["fp"]) == (tp, fp)
    assert {(r["_p"], r["_n"]) for r in got} == {(tp, fp)}
