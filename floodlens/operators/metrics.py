"""Evaluation of predictions: counts, rates, curves and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators.ordered import exact_quantiles, in_ranges, running_totals

# Numerator and denominator of each class's scores over the four counts.
_SCORES = {
    0: {"precision": ("tn", "tn + fn"), "recall": ("tn", "tn + fp"), "f1": ("2 * tn", "2 * tn + fn + fp")},
    1: {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn")},
}
_SUPPORT = {0: "tn + fp", 1: "tp + fn"}
_ALL = "tn + fp + fn + tp"


def _cells(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """The four counts as one row, zeros included."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return pred.selectExpr(
        *[f"count_if({label} = {t} AND {prediction} = {g}) AS {name}" for name, (t, g) in cells.items()]
    )


def _ratio(top: str, bottom: str) -> str:
    """Division with 0 for an empty denominator."""
    return f"CASE WHEN {bottom} > 0 THEN double({top}) / ({bottom}) ELSE 0D END"


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count); all four cells are always there."""
    return _cells(pred, label, prediction).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, count)"
    )


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1, and the false positive rate."""
    return _cells(pred, label, prediction).selectExpr(
        f"round({_ratio('tp + tn', _ALL)}, 4) AS accuracy",
        *[f"round({_ratio(*parts)}, 4) AS {name}" for name, parts in _SCORES[1].items()],
        f"round({_ratio('fp', 'fp + tn')}, 6) AS fpr",
    )


def classification_report(
    pred: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    names: tuple[str, str] = ("Benign", "Attack"),
) -> DataFrame:
    """Per class precision, recall, F1 and support, then the three averages."""
    lines = [(names[c], [_ratio(*parts) for parts in _SCORES[c].values()], _SUPPORT[c]) for c in (0, 1)]
    benign, attack = lines[0][1], lines[1][1]
    lines.append(("accuracy", [_ratio("tn + tp", _ALL)] * 3, _ALL))
    lines.append(("macro avg", [f"(({b}) + ({a})) / 2D" for b, a in zip(benign, attack)], _ALL))
    lines.append(
        (
            "weighted avg",
            [_ratio(f"({b}) * ({_SUPPORT[0]}) + ({a}) * ({_SUPPORT[1]})", _ALL) for b, a in zip(benign, attack)],
            _ALL,
        )
    )
    rows = ", ".join(
        f"'{name}', {', '.join(f'round({score}, 4)' for score in scores)}, {support}"
        for name, scores, support in lines
    )
    return _cells(pred, label, prediction).selectExpr(
        f"stack({len(lines)}, {rows}) AS (class, precision, recall, f1, support)"
    )


def latency_summary(df: DataFrame, column: str, target: float = 50.0) -> DataFrame:
    """Mean, deviation, median, P95, P99, maximum and the share below the target."""
    x = F.col(column).cast("double")
    moments = df.agg(
        F.count(column).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.max(x).alias("max"),
        (F.avg(F.when(x < target, 1.0).when(x.isNotNull(), 0.0)) * F.lit(100.0).cast("double")).alias(
            "pct_under_target"
        ),
    )
    quantiles = exact_quantiles(df, [], column, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    # Two single rows with different columns become one.
    names = ["count", "mean", "std", "median", "p95", "p99", "max", "pct_under_target"]
    return moments.unionByName(quantiles, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins (bin, low, high, count), empty ones included.

    The last bin is closed. A constant column gets a range of one around it.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    low, high = values.agg(F.min("x"), F.max("x")).first()  # two numbers
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin INT, low DOUBLE, high DOUBLE, count BIGINT")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = f"CAST(least(floor((x - {low!r}D) / {width!r}D), {bins - 1}) AS INT)"
    counted = values.groupBy(F.expr(place).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).selectExpr(
        "CAST(id AS INT) AS bin", f"{low!r}D + id * {width!r}D AS low", f"{low!r}D + (id + 1) * {width!r}D AS high"
    )
    return edges.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


# Rows that one slice of the ordered scores stands for; there are as many slices as cores at least.
SLICE_ROWS = 1_000_000


def score_table(
    pred: DataFrame, label: str = "label", score: str = "score", digits: int | None = None, slices: int | None = None
) -> DataFrame:
    """Per distinct score, descending: positives and negatives at and above it.

    All curves and areas are made from this table. Written once, it can be given to each of
    them as ``points``.
    """
    if slices is None:
        slices = max(pred.sparkSession.sparkContext.defaultParallelism, -(-pred.count() // SLICE_ROWS))
    s = F.col(score).cast("double")
    if digits is not None:
        s = F.round(s, digits)
    per_score = (
        # Not named as the input: an alias that changes nothing is dropped, and then both sides
        # of the join in running_totals carry the input's own attribute.
        pred.select(s.alias("_s"), F.col(label).cast("int").alias("_y"))
        .groupBy("_s")
        .agg(
            F.sum(F.when(F.col("_y") == 1, 1).otherwise(0).cast("long")).alias("pos"),
            F.sum(F.when(F.col("_y") == 1, 0).otherwise(1).cast("long")).alias("neg"),
        )
    )
    table = running_totals(
        in_ranges(per_score, F.desc("_s"), slices, "_slice"), "_slice", [F.desc("_s")], {"pos": "tp", "neg": "fp"}, {"pos": "_p", "neg": "_n"}
    )
    return table.drop("_slice").withColumnRenamed("_s", "score")


def roc_curve(
    pred: DataFrame,
    label: str = "label",
    score: str = "score",
    digits: int | None = None,
    slices: int | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score and at the origin.

    ``digits`` rounds scores first, which makes the curve approximate.
    """
    table = score_table(pred, label, score, digits, slices) if points is None else points
    curve = table.select(
        F.col("score").alias("threshold"),
        F.expr(_ratio("fp", "_n")).alias("fpr"),
        F.expr(_ratio("tp", "_p")).alias("tpr"),
    )
    return curve.unionByName(_start(pred, {"fpr": 0.0, "tpr": 0.0}))


def pr_curve(
    pred: DataFrame,
    label: str = "label",
    score: str = "score",
    digits: int | None = None,
    slices: int | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """(threshold, precision, recall) at every distinct score and at recall 0."""
    table = score_table(pred, label, score, digits, slices) if points is None else points
    curve = table.select(
        F.col("score").alias("threshold"),
        F.expr(_ratio("tp", "tp + fp")).alias("precision"),
        F.expr(_ratio("tp", "_p")).alias("recall"),
    )
    return curve.unionByName(_start(pred, {"precision": 1.0, "recall": 0.0}))


def _start(pred: DataFrame, values: dict[str, float]) -> DataFrame:
    """First curve point, where nothing is predicted positive."""
    one = pred.sparkSession.range(1)
    return one.select(
        F.lit(float("inf")).alias("threshold"), *[F.lit(v).alias(name) for name, v in values.items()]
    )


def roc_auc(
    pred: DataFrame,
    label: str = "label",
    score: str = "score",
    digits: int | None = None,
    slices: int | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """Area under the ROC curve by trapezoids; NULL with one class only."""
    rows = score_table(pred, label, score, digits, slices) if points is None else points
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")).cast("double"))
    pairs = F.max("_p").cast("double") * F.max("_n").cast("double")
    return rows.agg(F.when(pairs > 0, area / (pairs * F.lit(2.0).cast("double"))).alias("roc_auc"))


def average_precision(
    pred: DataFrame,
    label: str = "label",
    score: str = "score",
    digits: int | None = None,
    slices: int | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """Precision averaged over recall steps, without interpolation."""
    rows = score_table(pred, label, score, digits, slices) if points is None else points
    step = F.col("pos").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    positives = F.max("_p").cast("double")
    return rows.agg(
        F.when(positives > 0, F.sum(step) / positives).otherwise(F.lit(0.0)).alias("average_precision")
    )


def join_truth(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions with the label of the same key, and rows that only one side has: their other
    columns are NULL and ``matched`` is false."""
    made = pred.withColumn("_made", F.lit(True))
    known = truth.withColumn("_known", F.lit(True))
    both = F.col("_made").isNotNull() & F.col("_known").isNotNull()
    return made.join(known, key, "full_outer").withColumn("matched", both).drop("_made", "_known")


def compare_predictions(
    a: DataFrame, b: DataFrame, key: str, label: str = "prediction", probability: str = "score", needed: float = 0.99
) -> DataFrame:
    """How far two scorers agree. A row that only one of them has is a mismatch."""
    left = a.select(key, F.col(label).alias("_la"), F.col(probability).cast("double").alias("_pa"), F.lit(1).alias("_a"))
    right = b.select(key, F.col(label).alias("_lb"), F.col(probability).cast("double").alias("_pb"), F.lit(1).alias("_b"))
    same = F.when(F.col("_la") == F.col("_lb"), 1.0).otherwise(0.0)
    return left.join(right, key, "full_outer").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"),
        F.avg(same).alias("match_rate"),
        F.max(F.abs(F.col("_pa") - F.col("_pb"))).alias("max_abs_diff"),
        F.coalesce(F.avg(same) >= needed, F.lit(False)).alias("passed"),
    )
