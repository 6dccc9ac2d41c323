"""Reproducible train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.hashing import HASH_RANGE, key_number
from floodlens.operators.ordered import select_ranks


def in_test(key: str | Column, test: float = 0.2, seed: int = 42) -> Column:
    """Whether a key belongs to the test part: its hash lies in the lowest share."""
    return key_number(key, seed) < F.lit(int(test * HASH_RANGE))


def stratified_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42, label: str = "label", exact: bool = False,
    marked: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test), deterministic per key.

    The default is a filter on the key's hash: no shuffle, and every class is cut
    in the same proportion up to chance. ``exact=True`` takes exactly the rounded
    share of every class, by the hash value at that rank. ``marked`` names a column that holds
    ``in_test`` of the key already, so that a table which is read often hashes each key once;
    it is not part of the result.
    """
    if marked is not None:
        return tuple(df.where(c).drop(marked) for c in (~F.col(marked), F.col(marked)))
    if not exact:
        chosen = in_test(key, test, seed)
        return df.where(~chosen), df.where(chosen)
    hashed = df.withColumn("_h", key_number(key, seed))
    edges = select_ranks(
        hashed,
        [label],
        "_h",
        lambda total: [("edge", F.round(F.lit(test) * total.cast("double")).cast("long"))],
        [test],
    ).select(label, F.col("value").alias("_edge"))
    # One row per class; a class without an edge is all test.
    marked = hashed.join(F.broadcast(edges), label, "left").withColumn(
        "_test", F.coalesce(F.col("_h").cast("double") < F.col("_edge"), F.lit(True))
    )
    columns = df.columns
    return (
        marked.where(~F.col("_test")).select(*columns),
        marked.where(F.col("_test")).select(*columns),
    )
