"""Training, tuning, comparing and explaining tree models on MLlib."""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodlens.functions.hashing import key_bucket, key_number
from floodlens.operators.leafwise import LeafwiseBoosted
from floodlens.operators.metrics import binary_metrics
from floodlens.schemas import FLOW_FEATURES
from floodlens.session import release, store

SEED = 42
# MLlib's deepest tree; stands for "no limit".
UNLIMITED_DEPTH = 30
# Training rows of all models that are fitted at a time: each keeps its own binned copy of the rows,
# and many rows keep all cores busy with one model.
TOGETHER_ROWS = 12_000_000
# Training rows of a search that are kept in memory; more are written.
FEW_ROWS = 1_000_000

# --- fixed values: search grids of the compared models ---------------------
TREE_GRID = {"maxDepth": [5, 10, 15, UNLIMITED_DEPTH], "minInstancesPerNode": [1, 2, 4]}
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 15, 20]}
BOOSTED_GRID = {
    "maxIter": [100, 200, 300],
    "maxDepth": [4, 6, 8],
    "stepSize": [0.05, 0.1, 0.2],
    "subsamplingRate": [0.8, 1.0],
}
LEAFWISE_GRID = {
    "maxIter": [100, 200, 300],
    "maxDepth": [4, 6, 8],
    "stepSize": [0.05, 0.1, 0.2],
    "numLeaves": [31, 50, 80],
}
# ---------------------------------------------------------------------------


@dataclass
class ModelSpec:
    """A named estimator with the parameter values to try."""

    name: str
    estimator: Estimator
    grid: dict[str, list] = field(default_factory=dict)

    def quick(self) -> ModelSpec:
        """First and last value of every list with more than two."""
        ends = {p: [v[0], v[-1]] if len(v) > 2 else list(v) for p, v in self.grid.items()}
        return ModelSpec(self.name, self.estimator, ends)


def model_specs() -> list[ModelSpec]:
    """The compared models; boosted trees grow level by level (MLlib) or by their best leaf."""
    common = {"featuresCol": "features", "labelCol": "label", "seed": SEED}
    return [
        ModelSpec("DecisionTree", DecisionTreeClassifier(**common), TREE_GRID),
        ModelSpec("RandomForest", RandomForestClassifier(**common), FOREST_GRID),
        ModelSpec("Boosted", GBTClassifier(**common), BOOSTED_GRID),
        ModelSpec("BoostedLeafwise", LeafwiseBoosted(labelCol="label"), LEAFWISE_GRID),
    ]


def minmax_stage(params: DataFrame) -> SQLTransformer:
    """Fitted scaling as a pipeline stage, so that serving scales like training.

    Scaled copies are named ``scaled_<position>``; raw columns stay.
    """
    terms = [
        f"(CAST(`{r['feature']}` AS DOUBLE) - CAST({r['min']!r} AS DOUBLE)) * CAST({r['scale']!r} AS DOUBLE)"
        f" AS scaled_{i}"
        for i, r in enumerate(params.collect())  # one row per feature
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def pipeline_for(
    estimator: Estimator, features: Sequence[str] = FLOW_FEATURES, scaler: DataFrame | None = None
) -> Pipeline:
    stages, inputs = [], list(features)
    if scaler is not None:
        order = {r["feature"]: i for i, r in enumerate(scaler.select("feature").collect())}
        stages, inputs = [minmax_stage(scaler)], [f"scaled_{order[f]}" for f in features]
    if isinstance(estimator, LeafwiseBoosted):
        return Pipeline(stages=[*stages, estimator.copy({estimator.inputCols: inputs})])
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), estimator])


def _fit(estimator, train: DataFrame, features: Sequence[str], scaler: DataFrame | None, params: dict):
    common = {"featuresCol": "features", "labelCol": "label", "seed": SEED}
    return pipeline_for(estimator(**{**common, **params}), features, scaler).fit(train)


def train_tree(
    train: DataFrame, features: Sequence[str] = FLOW_FEATURES, scaler: DataFrame | None = None, **params
) -> PipelineModel:
    return _fit(DecisionTreeClassifier, train, features, scaler, params)


def train_forest(
    train: DataFrame, features: Sequence[str] = FLOW_FEATURES, scaler: DataFrame | None = None, **params
) -> PipelineModel:
    return _fit(RandomForestClassifier, train, features, scaler, params)


def train_boosted(
    train: DataFrame, features: Sequence[str] = FLOW_FEATURES, scaler: DataFrame | None = None, **params
) -> PipelineModel:
    return _fit(GBTClassifier, train, features, scaler, params)


def train_leafwise(
    train: DataFrame, features: Sequence[str] = FLOW_FEATURES, scaler: DataFrame | None = None, **params
) -> PipelineModel:
    return pipeline_for(LeafwiseBoosted(labelCol="label", **params), features, scaler).fit(train)


def _param_maps(estimator: Estimator, grid: dict[str, list]) -> list[dict]:
    names = list(grid)
    return [
        {estimator.getParam(n): v for n, v in zip(names, values)} for values in product(*[grid[n] for n in names])
    ]


def grid_search(
    train: DataFrame,
    spec: ModelSpec,
    key: str,
    features: Sequence[str] = FLOW_FEATURES,
    scaler: DataFrame | None = None,
    folds: int = 3,
    parallelism: int = 4,
    folded: DataFrame | None = None,
) -> CrossValidatorModel:
    """Cross-validated search by the F1 of the attack class.

    Folds come from the key's hash, so they are the same on every run. ``folded`` holds what
    ``with_folds`` made of the rows, for searches that share it.
    """
    evaluator = MulticlassClassificationEvaluator(
        labelCol="label", predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0
    )
    search = CrossValidator(
        estimator=pipeline_for(spec.estimator, features, scaler),
        estimatorParamMaps=_param_maps(spec.estimator, spec.grid),
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=SEED,
    )
    if folded is not None:
        return _search(search, folded)
    with with_folds(train, key, features, folds) as folded:
        return _search(search, folded)


@contextmanager
def with_folds(
    train: DataFrame, key: str, features: Sequence[str] = FLOW_FEATURES, folds: int = 3
) -> Iterator[DataFrame]:
    """The columns that models read and the number of the row's fold: every fold and parameter set
    reads the same rows. They are kept in memory, or written where they are many."""
    fold = key_bucket(key, "fold", folds).cast("int").alias("fold")
    folded = train.select(*features, "label", fold)
    if train.count() <= FEW_ROWS:
        folded.persist()
        try:
            yield folded
        finally:
            folded.unpersist()
        return
    folded = store(folded, "folds")
    try:
        yield folded
    finally:
        release(folded)


def _search(search: CrossValidator, folded: DataFrame) -> CrossValidatorModel:
    """What ``search.fit`` does, without its copies of the rows.

    That caches the rows of every fold once more. Here all fits read the same rows, and memory is left
    to the binned rows that each fit keeps.
    """
    estimator, maps, evaluator = search.getEstimator(), search.getEstimatorParamMaps(), search.getEvaluator()
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}  # one row per fold
    if None in sizes:
        raise ValueError(f"{sizes[None]} rows have no key and so no fold.")
    total = sum(sizes.values())
    for i in range(search.getNumFolds()):
        for part, rows in (("training", total - sizes.get(i, 0)), ("validation", sizes.get(i, 0))):
            if rows == 0:
                raise ValueError(f"The {part} data at fold {i} is empty.")
    scores = np.zeros((search.getNumFolds(), len(maps)))

    def score(place: tuple[int, int]) -> None:
        i, j = place
        model = estimator.fit(folded.where(F.col("fold") != i), maps[j])
        scores[i, j] = evaluator.evaluate(model.transform(folded.where(F.col("fold") == i)))

    with ThreadPool(max(1, min(search.getParallelism(), TOGETHER_ROWS // total))) as pool:
        pool.map(inheritable_thread_target(folded.sparkSession)(score), np.ndindex(scores.shape), chunksize=1)
    means = scores.mean(axis=0)
    best = int(means.argmax() if evaluator.isLargerBetter() else means.argmin())
    model = estimator.fit(folded, maps[best])
    return search._copyValues(CrossValidatorModel(model, means.tolist(), [], scores.std(axis=0).tolist()))


def best_params(found: CrossValidatorModel) -> dict:
    scores = found.avgMetrics
    chosen = found.getEstimatorParamMaps()[scores.index(max(scores))]
    return {param.name: value for param, value in chosen.items()}


def predict(df: DataFrame, model: PipelineModel, keep: Sequence[str] = ("label",)) -> DataFrame:
    """(kept columns, prediction 0/1, score)."""
    scored = model.transform(df)
    score = F.col("score") if scores_itself(model) else F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"), score.alias("score"))


def scores_itself(model: PipelineModel) -> bool:
    """Whether the last stage is SQL with a column `score`, not an MLlib model."""
    return isinstance(model.stages[-1], SQLTransformer)


def _folder_kb(spark: SparkSession, path: str) -> float:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(location).getLength() / 1024


def compare_models(
    specs: Sequence[ModelSpec],
    train: DataFrame,
    test: DataFrame,
    key: str,
    path: str,
    features: Sequence[str] = FLOW_FEATURES,
    scaler: DataFrame | None = None,
    folds: int = 3,
) -> DataFrame:
    """Tune, save and evaluate every model: one report row each.

    The loop runs over models; training, scoring and counting are Spark jobs. All read the same folds.
    Scoring time is wall time of the batch divided by its rows.
    """
    spark = train.sparkSession
    rows = test.count()
    report = []
    for spec, found, train_seconds in _searches(specs, train, key, features, scaler, folds):
        model, folder = found.bestModel, f"{path}/{spec.name}"
        model.write().overwrite().save(folder)
        started = time.perf_counter()
        metrics = binary_metrics(predict(test, model)).first()
        scoring_us = (time.perf_counter() - started) * 1e6 / max(rows, 1)
        report.append(
            (
                spec.name,
                *[metrics[m] for m in ("accuracy", "precision", "recall", "f1", "fpr")],
                round(scoring_us, 2),
                round(train_seconds, 2),
                round(_folder_kb(spark, folder), 1),
                json.dumps(best_params(found)),
            )
        )
    return spark.createDataFrame(
        report,
        "model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, fpr DOUBLE, "
        "inference_us DOUBLE, train_time_s DOUBLE, size_kb DOUBLE, best_params STRING",
    )


def _searches(specs, train, key, features, scaler, folds) -> Iterator[tuple[ModelSpec, CrossValidatorModel, float]]:
    """Each model with its search and the seconds that took."""
    with with_folds(train, key, features, folds) as folded:
        for spec in specs:
            started = time.perf_counter()
            found = grid_search(train, spec, key, features, scaler, folds, folded=folded)
            yield spec, found, time.perf_counter() - started


def rank_models(report: DataFrame) -> DataFrame:
    """Best F1 first, then the faster one, then the name."""
    return report.orderBy(F.desc("f1"), "inference_us", "model")


def save_best(report: DataFrame, path: str) -> str:
    """Copy the best model to ``best`` with its name beside it; returns the name."""
    best = rank_models(report).first()
    PipelineModel.load(f"{path}/{best['model']}").write().overwrite().save(f"{path}/best")
    meta = report.sparkSession.createDataFrame([best], report.schema)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/best_meta")
    return best["model"]


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, str]:
    """The best model and its name ('Unknown' without one)."""
    model = PipelineModel.load(f"{path}/best")
    meta = spark.read.schema("model STRING").json(f"{path}/best_meta").first()
    return model, meta["model"] if meta and meta["model"] else "Unknown"


def rank_importance(importance: DataFrame) -> DataFrame:
    """Least important first, the order of a horizontal bar chart."""
    return importance.orderBy("importance", "feature")


def feature_importance(
    spark: SparkSession, model: PipelineModel, features: Sequence[str] = FLOW_FEATURES
) -> DataFrame:
    """Built-in importance by feature name; of best-leaf-first trees the share of all splits."""
    if scores_itself(model):
        scaled = {}
        if len(model.stages) > 1:
            scaled = {n: f for f, n in re.findall(r"CAST\(`([^`]+)` AS DOUBLE\) - .*? AS (scaled_\d+)", model.stages[0].getStatement())}
        splits = re.findall(r"CAST\(`([^`]+)` AS DOUBLE\) <= ", model.stages[-1].getStatement())
        found = Counter(scaled.get(name, name) for name in splits)
        values = [found[f] / max(len(splits), 1) for f in features]
    else:
        values = model.stages[-1].featureImportances.toArray().tolist()
    return rank_importance(
        spark.createDataFrame(list(zip(features, values)), "feature STRING, importance DOUBLE")
    )


def permutation_importance(
    df: DataFrame,
    model: PipelineModel,
    key: str,
    features: Sequence[str] = FLOW_FEATURES,
    seed: int = SEED,
    group_rows: int = 10_000,
) -> DataFrame:
    """Loss of F1 when one feature gets the values of other rows.

    Rows fall into groups of about ``group_rows`` by hash and are paired inside them by two
    different hash orders, so there is no global ordering and no single task sees all rows.
    All features are judged in one pass over rows that carry their donor.
    """
    names = list(features)
    groups = max(1, df.count() // group_rows)
    rows = df.select(
        F.col(key).cast("string").alias("_key"),
        F.col("label").cast("int").alias("label"),
        F.array(*[F.col(f"`{f}`").cast("double") for f in names]).alias("own"),
    ).withColumn("_group", key_bucket("_key", f"{seed}:group", groups))

    def place(salt: str):
        ordered = Window.partitionBy("_group").orderBy(key_number("_key", f"{seed}:{salt}"), "_key")
        return F.row_number().over(ordered)

    placed = rows.withColumn("_at", place("take")).withColumn("_from", place("give"))
    donors = placed.select("_group", F.col("_from").alias("_at"), F.col("own").alias("other"))
    # As many donors as rows: left to its guess by file size, in which an array counts as one
    # number, Spark would broadcast them.
    paired = placed.select("_group", "_at", "label", "own").join(donors.hint("merge"), ["_group", "_at"])
    # Variant 0 is the row as it is; variant i has feature i of the donor.
    variants = paired.select(
        "label",
        "own",
        "other",
        F.posexplode(F.array(*[F.lit(n) for n in ["", *names]])).alias("_v", "feature"),
    )
    mixed = F.transform(
        F.col("own"), lambda x, i: F.when(i + 1 == F.col("_v"), F.get("other", i)).otherwise(x)
    )
    scored = model.stages[-1].transform(
        _prepared(model, variants.select("label", "feature", mixed.alias("_x")), names)
    )
    guess, truth = F.col("prediction").cast("int"), F.col("label")
    counts = scored.groupBy("feature").agg(
        F.sum(F.when((guess == 1) & (truth == 1), 2.0).otherwise(0.0)).alias("_hits"),
        F.sum(guess + truth).cast("double").alias("_all"),
    )
    f1 = F.when(F.col("_all") > 0, F.col("_hits") / F.col("_all")).otherwise(F.lit(0.0))
    # One row per feature and one for the unchanged rows.
    base = F.max(F.when(F.col("feature") == "", F.col("f1"))).over(Window.partitionBy())
    return rank_importance(
        counts.select("feature", f1.alias("f1"))
        .select("feature", (base - F.col("f1")).alias("importance"))
        .where(F.col("feature") != "")
    )


def _prepared(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Run all stages before the classifier on rows that hold features as an array."""
    if len(model.stages) == 2 and not scores_itself(model):
        return df.select("label", "feature", array_to_vector("_x").alias("features"))
    wide = df.select("label", "feature", *[F.get("_x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    for stage in model.stages[:-1]:
        wide = stage.transform(wide)
    return wide
