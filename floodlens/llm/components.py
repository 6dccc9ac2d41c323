"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node near them: the larger ones of a node (large)
    or the node and its smaller ones (small)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    if large:
        linked = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return linked.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) of integers; root is the smallest node it
    can reach, itself included. Each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round. Loops and repeated edges have no effect."""
    up = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    up = materialize(up, "edges")
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = up.agg(*mark).first()
    while True:
        up = materialize(_stars(_stars(up, large=True), large=False), "edges")
        now = up.agg(*mark).first()
        if now == before:
            break
        before = now
    leaves = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(up.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
