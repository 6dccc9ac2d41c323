"""Labelled flows to scaled train and test tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators.flows import (
    apply_minmax,
    clean_flows,
    fit_minmax,
    flow_features,
    select_features,
)
from floodlens.operators.metrics import (
    average_precision,
    binary_metrics,
    classification_report,
    confusion_matrix,
    pr_curve,
    roc_auc,
    roc_curve,
    score_table,
)
from floodlens.operators.models import (
    ModelSpec,
    compare_models,
    feature_importance,
    model_specs,
    permutation_importance,
    predict,
    rank_models,
    save_best,
)
from floodlens.operators.smote import smote
from floodlens.operators.split import in_test, stratified_split
from floodlens.session import collected, materialize, release, store
from floodlens.sources.sinks import write_report, write_splits


@dataclass
class Prepared:
    """Scaled tables, the fitted scaler, the same rows unscaled, and what all of them read."""

    train: DataFrame
    test: DataFrame
    scaler: DataFrame
    raw_train: DataFrame
    raw_test: DataFrame
    stored: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the written rows; none of the tables can be read afterwards."""
        release(*self.stored)
        self.stored = []


def labelled_features(flows: DataFrame, key: str = "flow_id") -> DataFrame:
    """Clean, derive and select: (key, ten inputs, label)."""
    return select_features(flow_features(clean_flows(flows)), [key])


def prepare(
    flows: DataFrame,
    key: str = "flow_id",
    balance: bool = True,
    test: float = 0.2,
    seed: int = 42,
    order: str = "split-first",
) -> Prepared:
    """Clean, derive, split, balance the training part, scale by the training part.

    ``order='reference'`` balances before splitting, which lets synthetic rows into
    the test part; the default keeps the test part real.
    """
    if order not in ("split-first", "reference"):
        raise ValueError("order must be 'split-first' or 'reference'")
    held_out = in_test(key, test, seed).alias("_held_out")
    with collected() as stored:
        # Read by the split, the balancing and the scaling jobs. Real rows are written once, with their
        # part; balancing adds the synthetic rows in a table of their own.
        rows = labelled_features(flows, key).withColumn(key, F.col(key).cast("string"))
        table = store(rows.select("*", held_out), "features")
        if balance and order == "reference":
            table = store(smote(table.drop("_held_out"), key, seed=seed, written=True).select("*", held_out), "balanced")
        train, unseen = stratified_split(table, key, test, seed, marked="_held_out")
        if balance and order == "split-first":
            train = smote(train, key, seed=seed, written=True)
        # One row per feature, read by every model.
        scaler = store(fit_minmax(train).coalesce(1), "scaler")
    return Prepared(apply_minmax(train, scaler), apply_minmax(unseen, scaler), scaler, train, unseen, stored)


def train_and_select(
    flows: DataFrame,
    path: str,
    specs: Sequence[ModelSpec] | None = None,
    key: str = "flow_id",
    balance: bool = True,
    folds: int = 3,
) -> tuple[str, DataFrame]:
    """From labelled flows to saved models: (name of the best, comparison report).

    Models are fitted on unscaled rows with the scaler as their first stage, so a
    loaded model takes rows as they come. Splits, models, the best model, the
    report and the unscaled test rows (``unseen``) are written below ``path``.
    """
    ready = prepare(flows, key, balance)
    ready.raw_test.write.parquet(f"{path}/unseen")
    unseen = flows.sparkSession.read.schema(ready.raw_test.schema).parquet(f"{path}/unseen")
    write_splits(ready.train, ready.test, ready.scaler, f"{path}/splits")
    report = compare_models(
        model_specs() if specs is None else specs,
        ready.raw_train,
        unseen,
        key,
        f"{path}/models",
        scaler=ready.scaler,
        folds=folds,
    )
    write_report(rank_models(report), f"{path}/comparison_report")
    best = save_best(report, f"{path}/models")
    ready.release()
    return best, report


def evaluate(test: DataFrame, model: PipelineModel, key: str = "flow_id") -> dict[str, DataFrame]:
    """Everything an evaluation reports, by name; scores are computed once."""
    scored = materialize(predict(test, model, [key, "label"]), "scored")
    points = materialize(score_table(scored), "score-table")
    return {
        "classification_report": classification_report(scored),
        "confusion_matrix": confusion_matrix(scored),
        "metrics": binary_metrics(scored),
        "roc_curve": roc_curve(scored, points=points),
        "roc_auc": roc_auc(scored, points=points),
        "pr_curve": pr_curve(scored, points=points),
        "average_precision": average_precision(scored, points=points),
        "feature_importance": feature_importance(test.sparkSession, model),
        "permutation_importance": permutation_importance(test, model, key),
    }
