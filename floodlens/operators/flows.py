"""Labelled flow tables: cleaning, derived features, scaling and description."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.functions.traffic import entropy_sql
from floodlens.operators.detect import class_of
from floodlens.operators.ordered import exact_quantiles
from floodlens.schemas import BENIGN, FLOW_FEATURES, LABEL, require
from floodlens.session import materialize


def concat_flows(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def clean_flows(flows: DataFrame, dedup: bool = True) -> DataFrame:
    """Drop rows with an infinite or missing value in any column, then copies.

    Copies collapse inside each task before the shuffle, so a row repeated a
    billion times costs one row per task.
    """
    # NaN is above infinity, and a comparison with a missing value does not hold: one test for each
    # column. Over columns that are still to be parsed, more of them parse each value again, in a
    # method too long for the JVM to compile.
    checks = []
    for field in flows.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            checks.append(f"abs(`{field.name}`) < double('Infinity')")
        else:
            checks.append(f"`{field.name}` IS NOT NULL")
    usable = " AND ".join(checks)
    kept = flows.where(usable)
    return kept.dropDuplicates() if dedup else kept


def cleaning_stats(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows before and after cleaning in one result row."""
    sizes = raw.agg(F.count(F.lit(1)).alias("n_raw")).withColumn("n_clean", F.lit(0).cast("long"))
    sizes = sizes.unionByName(
        clean.agg(F.count(F.lit(1)).alias("n_clean")).withColumn("n_raw", F.lit(0).cast("long"))
    )
    removed = F.col("n_raw") - F.col("n_clean")
    percent = F.when(
        F.col("n_raw") > 0, removed.cast("double") / F.col("n_raw").cast("double") * F.lit(100.0).cast("double")
    ).otherwise(F.lit(0.0))
    return sizes.agg(F.sum("n_raw").alias("n_raw"), F.sum("n_clean").alias("n_clean")).select(
        F.col("n_raw").alias("initial"),
        removed.alias("removed"),
        F.round(percent, 1).alias("removed_pct"),
        F.col("n_clean").alias("remaining"),
    )


def flow_features(flows: DataFrame) -> DataFrame:
    """Add the two derived inputs: SYN per ACK and the entropy of the directions.

    Without ACKs the ratio is the SYN count; the entropy is 0 when one direction
    (or both) is silent or a count is missing.
    """
    require(flows, ["SYN Flag Count", "ACK Flag Count", "Total Fwd Packets", "Total Backward Packets"])
    acks = "CASE WHEN `ACK Flag Count` = 0 THEN 1 ELSE `ACK Flag Count` END"
    directions = entropy_sql(["`Total Fwd Packets`", "`Total Backward Packets`"])
    return flows.withColumns(
        {
            "SYN_ACK_Ratio": F.expr(f"double(`SYN Flag Count`) / {acks}"),
            "Proto_Entropy": F.expr(f"coalesce({directions}, 0D)"),
        }
    )


def select_features(flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ten inputs in model order and the 0/1 label; ``keep`` adds key columns."""
    require(flows, [*FLOW_FEATURES, LABEL])
    return flows.selectExpr(
        *[f"`{k}`" for k in keep],
        *[f"double(`{f}`) AS `{f}`" for f in FLOW_FEATURES],
        f"CAST({LABEL} <> '{BENIGN}' AS INT) AS label",
    )


def available(df: DataFrame, columns: Sequence[str] = FLOW_FEATURES) -> list[str]:
    return [c for c in columns if c in df.columns]


def class_distribution(df: DataFrame, column: str = LABEL) -> DataFrame:
    """Rows per class, largest first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def _long(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    typed = df.selectExpr(*ids, *[f"double(`{f}`) AS `{f}`" for f in features])
    return typed.unpivot([*ids], [f"`{f}`" for f in features], "feature", "value")


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_features(df: DataFrame, features: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max: one row per feature."""
    chosen = list(features) if features is not None else available(df)
    long = _long(df, chosen)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # One row per feature on both sides.
    joined = moments.join(F.broadcast(exact_quantiles(long, ["feature"], "value", _QUARTILES)), "feature")
    return joined.select(
        "feature", "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", *_QUARTILES, "max")]
    )


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson coefficient per given pair: (a, b, r).

    Two scans of the named columns: means first, then sums of centred products,
    which is stable and keeps one number per pair. Rows with a missing value are
    left out; a constant column has no coefficient.
    """
    names = sorted({n for pair in pairs for n in pair})
    at = {n: i for i, n in enumerate(names)}
    table = df.selectExpr(*[f"double(`{n}`) AS c{i}" for n, i in at.items()]).dropna()
    means = table.selectExpr(*[f"avg(c{i}) AS c{i}" for i in at.values()]).first()  # one row
    if means["c0"] is None:
        return df.sparkSession.createDataFrame([(a, b, None) for a, b in pairs], "a STRING, b STRING, r DOUBLE")
    centred = table.selectExpr(*[f"c{i} - double('{means[f'c{i}']!r}') AS c{i}" for i in at.values()])
    products = sorted({tuple(sorted((at[a], at[b]))) for a, b in pairs} | {(i, i) for i in at.values()})
    sums = centred.selectExpr(*[f"sum(c{i} * c{j}) AS s_{i}_{j}" for i, j in products])

    def row(a: str, b: str) -> str:
        i, j = sorted((at[a], at[b]))
        scale = f"sqrt(s_{i}_{i}) * sqrt(s_{j}_{j})"
        return f"struct('{a}' AS a, '{b}' AS b, CASE WHEN {scale} > 0 THEN s_{i}_{j} / ({scale}) END AS r)"

    return sums.selectExpr(f"inline(array({', '.join(row(a, b) for a, b in pairs)}))")


def correlation_matrix(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Coefficients of all pairs of features, in both orders."""
    chosen = list(features) if features is not None else available(df)
    return correlations(df, [(a, b) for a in chosen for b in chosen])


def box_stats(df: DataFrame, features: Sequence[str] | None = None, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and outlier count per class and feature.

    A whisker ends at the last value within ``reach`` interquartile ranges.
    """
    chosen = list(features) if features is not None else available(df)
    long = _long(class_of(df), chosen, ["class"])
    quartiles = exact_quantiles(long, ["class", "feature"], "value", _QUARTILES)
    spread = F.col("q75") - F.col("q25")
    fences = quartiles.withColumn("_low", F.col("q25") - reach * spread).withColumn(
        "_high", F.col("q75") + reach * spread
    )
    # Two classes times the features: a handful of rows, read before and after the values are added up.
    group = F.xxhash64("class", "feature").alias("_group")
    fences = materialize(fences.select("*", group), "fences")
    # One number is looked up far faster than two texts; texts of one hash would need both.
    few = fences.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_group").alias("numbers")).first()
    by = ["_group"] if few["n"] == few["numbers"] else ["_group", "class", "feature"]
    value = F.col("value")
    return (
        long.where(value.isNotNull())
        .withColumn("_group", group)
        .join(F.broadcast(fences.select(*by, "_low", "_high")), by)
        .groupBy("class", "feature")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(F.when(value >= F.col("_low"), value)).alias("_first"),
            F.max(F.when(value <= F.col("_high"), value)).alias("_last"),
            F.count_if((value < F.col("_low")) | (value > F.col("_high"))).alias("outliers"),
        )
        .join(F.broadcast(fences.drop("_low", "_high", "_group")), ["class", "feature"])
        .select(
            "class",
            "feature",
            "count",
            *_QUARTILES,
            F.least("_first", "q25").alias("whisker_low"),
            F.greatest("_last", "q75").alias("whisker_high"),
            "outliers",
        )
    )


def fit_minmax(train: DataFrame, features: Sequence[str] = FLOW_FEATURES) -> DataFrame:
    """Scaler table with one row per feature; a constant feature gets scale 1."""
    extremes = train.selectExpr(
        *[f"double(min(`{f}`)) AS lo_{i}" for i, f in enumerate(features)],
        *[f"double(max(`{f}`)) AS hi_{i}" for i, f in enumerate(features)],
    )
    rows = ", ".join(
        f"struct('{f}' AS feature, lo_{i} AS min, hi_{i} AS max)" for i, f in enumerate(features)
    )
    return extremes.selectExpr(f"inline(array({rows}))").selectExpr(
        "feature",
        "min",
        "max",
        "max - min AS data_range",
        "1D / CASE WHEN max = min THEN 1D ELSE max - min END AS scale",
    )


def apply_minmax(df: DataFrame, params: DataFrame) -> DataFrame:
    """(x - min) * scale with the fitted values as literals; nothing is clipped."""
    fitted = {r["feature"]: r for r in params.collect()}  # one row per feature

    def scaled(name: str) -> str:
        if name not in fitted:
            return f"`{name}`"
        p = fitted[name]
        return f"(double(`{name}`) - double('{p['min']!r}')) * double('{p['scale']!r}') AS `{name}`"

    return df.selectExpr(*[scaled(c) for c in df.columns])
