"""Training, tuning, comparing and explaining on a small separable table."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators import models as md
from floodlens.operators import scoring
from floodlens.operators.flows import fit_minmax
from floodlens.plans.training import evaluate, prepare, train_and_select
from floodlens.schemas import FEATURES, FLOW_FEATURES


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        attack = i % 2
        row = rng.normal(size=10)
        row[2] += 6 * attack
        rows.append((f"k{i}", *map(float, row), attack))
    schema = "k STRING, " + ", ".join(f"`{f}` DOUBLE" for f in FLOW_FEATURES) + ", label INT"
    return spark.createDataFrame(rows, schema).cache()


def test_grids_and_quick_mode():
    names = [s for s in (md.TREE_GRID, md.FOREST_GRID, md.BOOSTED_GRID)]
    assert [int(np.prod([len(v) for v in g.values()])) for g in names] == [12, 9, 54]
    spec = md.ModelSpec("x", None, {"a": [1, 2, 3], "b": [1, 2], "c": [4]}).quick()
    assert spec.grid == {"a": [1, 3], "b": [1, 2], "c": [4]}


def test_compare_save_load_explain(spark, table, tmp_path):
    specs = [md.ModelSpec(s.name, s.estimator, {"maxDepth": [1, 3]}) for s in md.model_specs()[:1]]
    specs += [md.ModelSpec(s.name, s.estimator, {"maxDepth": [2], "numTrees": [3]}) for s in md.model_specs()[1:2]]
    train, test = table.where("hash(k) % 4 <> 0"), table.where("hash(k) % 4 = 0")
    path = str(tmp_path / "models")
    report = md.compare_models(specs, train, test, "k", path)
    rows = {r["model"]: r for r in report.collect()}
    assert set(rows) == {"DecisionTree", "RandomForest"}
    assert all(r["f1"] > 0.9 and r["size_kb"] > 0 and r["inference_us"] > 0 for r in rows.values())
    assert set(json.loads(rows["DecisionTree"]["best_params"])) == {"maxDepth"}
    best = md.save_best(report, path)
    model, name = md.load_model(spark, path)
    assert name == best == md.rank_models(report).first()["model"]
    built_in = md.feature_importance(spark, model).collect()
    assert built_in[-1]["feature"] == "SYN Flag Count"
    dropped = md.permutation_importance(test, model, "k", group_rows=100).collect()
    assert len(dropped) == 10
    assert dropped[-1]["feature"] == "SYN Flag Count" and dropped[-1]["importance"] > 0.2
    unused = {r["feature"]: r["importance"] for r in built_in}
    assert all(r["importance"] == 0 for r in dropped if unused[r["feature"]] == 0)


def test_scaler_travels_with_the_model(spark, table, tmp_path):
    scaler = fit_minmax(table)
    scaled = md.train_tree(table, scaler=scaler, maxDepth=3)
    plain = md.train_tree(table, maxDepth=3)
    scaled.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    loaded = PipelineModel.load(str(tmp_path / "m"))
    a = md.predict(table, loaded, ["k"]).withColumnRenamed("score", "s1").drop("prediction")
    b = md.predict(table, plain, ["k"]).withColumnRenamed("score", "s2").drop("prediction")
    assert a.join(b, "k").where("abs(s1 - s2) > 0.02").count() <= 4
    assert md.permutation_importance(table, loaded, "k", group_rows=100).count() == 10


def test_rank_models_breaks_ties(spark):
    report = spark.createDataFrame(
        [("b", 0.9, 5.0), ("a", 0.9, 5.0), ("c", 0.9, 1.0), ("d", 0.99, 50.0)], "model STRING, f1 DOUBLE, inference_us DOUBLE"
    )
    assert [r["model"] for r in md.rank_models(report).collect()] == ["d", "c", "a", "b"]


def test_prepare_train_and_evaluate(spark, tmp_path):
    rng = np.random.default_rng(1)
    names = [
        "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "SYN Flag Count",
        "ACK Flag Count", "Packet Length Mean", "Packet Length Variance", "Flow Duration", "Flow IAT Mean",
    ]
    rows = [(f"f{i}", *map(float, rng.integers(1, 50, 9)), "Syn" if i % 4 == 0 else "BENIGN") for i in range(200)]
    flows = spark.createDataFrame(rows, "flow_id STRING, " + ", ".join(f"`{n}` DOUBLE" for n in names) + ", Label STRING")
    ready = prepare(flows)
    sizes = {r["label"]: r["count"] for r in ready.train.groupBy("label").count().collect()}
    assert sizes[0] == sizes[1]
    assert ready.test.where(F.col("flow_id").contains("#")).count() == 0
    ranges = ready.train.select(*[F.min(f"`{f}`") for f in FLOW_FEATURES], *[F.max(f"`{f}`") for f in FLOW_FEATURES]).first()
    assert list(ranges) == pytest.approx([0.0] * 10 + [1.0] * 10)
    name, report = train_and_select(
        flows, str(tmp_path / "run"), [md.ModelSpec("Tree", md.model_specs()[0].estimator, {"maxDepth": [2]})]
    )
    assert name == "Tree" and report.count() == 1
    model, _ = md.load_model(spark, str(tmp_path / "run" / "models"))
    unseen = spark.read.parquet(str(tmp_path / "run" / "unseen"))
    assert unseen.exceptAll(ready.raw_test).isEmpty() and unseen.count() == ready.test.count()
    found = evaluate(unseen, model)
    assert found["classification_report"].count() == 5
    assert found["confusion_matrix"].agg({"count": "sum"}).first()[0] == ready.test.count()
    assert 0 <= found["roc_auc"].first()[0] <= 1
    leaky = prepare(flows, order="reference")
    both = leaky.train.unionByName(leaky.test)
    assert {r["count"] for r in both.groupBy("label").count().collect()} == {150}


def _varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def _field(number, payload):
    """One length-delimited or varint field of a serialized message."""
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _value(name, columns):
    dims = _field(1, _field(2, "n")) + _field(1, _field(1, columns))
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))


def tiny_model():
    """sigmoid(sum of the ten features - 5) in the exchange format."""
    weights = _field(1, 10) + _field(1, 1) + _field(2, 1) + _field(8, "w") + _field(9, np.ones(10, "<f4").tobytes())
    bias = _field(1, 1) + _field(2, 1) + _field(8, "b") + _field(9, np.array([-5], "<f4").tobytes())
    nodes = [(["x", "w"], "m", "MatMul"), (["m", "b"], "a", "Add"), (["a"], "p", "Sigmoid")]
    graph = b"".join(
        _field(1, b"".join(_field(1, i) for i in ins) + _field(2, out) + _field(4, op)) for ins, out, op in nodes
    )
    graph += _field(2, "g") + _field(5, weights) + _field(5, bias)
    graph += _field(11, _value("x", 10)) + _field(12, _value("p", 1))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_exported_model_scores_in_batches(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "model.onnx"
    path.write_bytes(tiny_model())
    rows = [tuple(float((i * j) % 3) for j in range(10)) for i in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} DOUBLE" for f in FEATURES))
    got = scoring.threshold(scoring.score(df, scoring.onnx_scorer(str(path), 16)), 0.5).collect()
    for r in got:
        p = 1 / (1 + np.exp(5 - sum(r[f] for f in FEATURES)))
        assert r["score"] == pytest.approx(p, abs=1e-5)
        assert r["is_attack"] == (r["score"] > 0.5)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.85,), (0.8500001,), (None,)], "score DOUBLE")
    assert [r["is_attack"] for r in scoring.threshold(df).collect()] == [False, True, False]


def test_donors_are_never_broadcast(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = md.permutation_importance(stored, md.train_tree(stored, maxDepth=3), "k", group_rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def _left(spark, before=frozenset()):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("*-*")} - before


def test_search_makes_no_copies_and_scores_like_the_library(spark, table, monkeypatch):
    spec = md.ModelSpec("Tree", md.model_specs()[0].estimator, {"maxDepth": [0, 1, 3], "minInstancesPerNode": [1, 60]})
    searches, search = [], md._search
    monkeypatch.setattr(md, "_search", lambda s, rows: searches.append((s, rows.localCheckpoint())) or search(s, rows))
    before = _left(spark)
    in_memory = md.grid_search(table, spec, "k")
    searches.clear()
    monkeypatch.setattr(md, "FEW_ROWS", 10)
    with monkeypatch.context() as m:
        for name in ("cache", "persist"):
            m.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows are copied"))
        found = md.grid_search(table, spec, "k")
        m.setattr(md, "TOGETHER_ROWS", 10)
        alone = md.grid_search(table, spec, "k")
    assert not [name for name in _left(spark, before) if name.startswith("folds-")]
    want = CrossValidator.fit(*searches[0])
    assert found.avgMetrics == pytest.approx(want.avgMetrics) == alone.avgMetrics == in_memory.avgMetrics
    assert found.stdMetrics == pytest.approx(want.stdMetrics) and md.best_params(found) == md.best_params(want)
    assert md.best_params(alone) == md.best_params(want)
    with pytest.raises(ValueError, match="no key"):
        md.grid_search(table.withColumn("k", F.lit(None).cast("string")), spec, "k")
    with pytest.raises(ValueError, match="fold"):
        md.grid_search(table.where("k = 'k1'"), spec, "k")


def test_models_share_the_written_folds(spark, table, tmp_path, monkeypatch):
    made, store = [], md.store
    monkeypatch.setattr(md, "FEW_ROWS", 10)
    monkeypatch.setattr(md, "store", lambda df, name: made.append(name) or store(df, name))
    tree, _, _, leafwise = md.model_specs()
    specs = [md.ModelSpec(n, tree.estimator, {"maxDepth": [d]}) for n, d in (("A", 1), ("B", 2))]
    specs.append(md.ModelSpec("C", leafwise.estimator, {"maxIter": [10], "numLeaves": [3]}))
    before = _left(spark)
    assert md.compare_models(specs, table, table, "k", str(tmp_path / "m")).count() == 3
    # One copy of the rows for all models, and none of it or of the boosted rows is left.
    assert made == ["folds"]
    assert not [name for name in _left(spark, before) if name.startswith(("folds-", "boosted-"))]


def test_preparation_writes_each_row_once(spark):
    rng = np.random.default_rng(1)
    names = ["Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "SYN Flag Count",
             "ACK Flag Count", "Packet Length Mean", "Packet Length Variance", "Flow Duration", "Flow IAT Mean"]
    rows = [(f"f{i}", *map(float, rng.integers(1, 50, 9)), "Syn" if i % 4 == 0 else "BENIGN") for i in range(200)]
    flows = spark.createDataFrame(rows, "flow_id STRING, " + ", ".join(f"`{n}` DOUBLE" for n in names) + ", Label STRING")
    before = _left(spark)
    ready = prepare(flows)
    parts = {r["label"]: r["count"] for r in ready.raw_train.groupBy("label").count().collect()}
    assert parts[0] == parts[1] and ready.train.count() + ready.test.count() > 200
    left = {name.rsplit("-", 1)[0] for name in _left(spark, before)}
    assert {"features", "synthetic"} <= left <= {"features", "synthetic", "scaler", "rank-slots"}
    ready.release()
    assert {name.rsplit("-", 1)[0] for name in _left(spark, before)} <= {"rank-slots"}
