"""Counting sketches and key statistics for very many sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.durations import to_interval
from floodlens.functions.hashing import key_bucket
from floodlens.session import materialize

# --- fixed values: documented sketch size -------------------------------------
DEPTH = 4
WIDTH = 16384
# ---------------------------------------------------------------------------

# Buckets of a sketch that may be broadcast: about 8 MB.
BROADCAST_WIDTH = 1 << 18


def count_min_sketch(
    df: DataFrame, key: str, weight: Column | str | None = None, d: int = DEPTH, w: int = WIDTH
) -> DataFrame:
    """Counters (row, bucket, count).

    Adding up happens inside the tasks first: at most d x w rows leave a task,
    whatever the number of keys and rows.
    """
    amount = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    places = F.array(
        *[F.struct(F.lit(i).alias("row"), key_bucket(key, i, w).alias("bucket")) for i in range(d)]
    )
    # Per key first, so that a key is hashed once and not once per row.
    per_key = df.select(key, amount.alias("_amount")).groupBy(key).agg(F.sum("_amount").alias("_amount"))
    return (
        per_key.select("_amount", F.inline(places))
        .groupBy("row", "bucket")
        .agg(F.sum("_amount").alias("count"))
    )


def cms_estimate(keys: DataFrame, sketch: DataFrame, key: str, d: int = DEPTH, w: int = WIDTH) -> DataFrame:
    """Estimate per given key: the smallest of its counters, never below the truth.

    The sketch is turned once into one row per bucket number with ``d`` counters, written,
    and looked up once for each of its rows. Up to BROADCAST_WIDTH buckets are broadcast; a
    wider sketch is joined by bucket.
    """
    wide = sketch.groupBy("bucket").agg(*[F.max(F.when(F.col("row") == i, F.col("count"))).alias(f"c{i}") for i in range(d)])
    wide = materialize(wide, "sketch")
    probed = keys
    for i in range(d):
        row = wide.select(F.col("bucket").alias(f"_b{i}"), F.col(f"c{i}").alias(f"_c{i}"))
        row = F.broadcast(row) if w <= BROADCAST_WIDTH else row
        probed = probed.withColumn(f"_b{i}", key_bucket(key, i, w)).join(row, f"_b{i}", "left")
    counts = [F.coalesce(F.col(f"_c{i}"), F.lit(0).cast("long")) for i in range(d)]
    smallest = F.least(*counts) if d > 1 else counts[0]
    return probed.select(*keys.columns, smallest.alias("estimate"))


def heavy_hitters(df: DataFrame, n: int, key: str = "src_ip", weight: str | None = None) -> DataFrame:
    """The n largest keys, exactly; ties go to the smaller key."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(key).agg(amount.alias("total")).orderBy(F.desc("total"), key).limit(n)


def sketch_accuracy(df: DataFrame, key: str, d: int = DEPTH, w: int = WIDTH) -> DataFrame:
    """Exact count and estimate per key with the overcount."""
    exact = df.groupBy(key).agg(F.count(F.lit(1)).alias("exact"))
    sketch = count_min_sketch(exact, key, "exact", d, w)
    return cms_estimate(exact, sketch, key, d, w).withColumn("overcount", F.col("estimate") - F.col("exact"))


def distinct_sources(
    packets: DataFrame, window: str, exact: bool = False, rsd: float = 0.02, key: str = "src_ip"
) -> DataFrame:
    """Sources per window. The default keeps one fixed-size sketch per window; the
    exact form first reduces every window to its distinct keys."""
    w = F.window("ts", to_interval(window)).alias("w")
    if exact:
        counted = packets.groupBy(w, key).agg(F.lit(1).alias("_")).groupBy("w").agg(
            F.count(F.lit(1)).alias("sources")
        )
    else:
        counted = packets.groupBy(w).agg(F.approx_count_distinct(key, rsd).alias("sources"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sources")


def key_sketches(packets: DataFrame, window: str, key: str = "src_ip", lg_k: int = 14) -> DataFrame:
    """One fixed-size sketch of the different keys per window, to be stored: batch or stream."""
    w = F.window("ts", to_interval(window)).alias("w")
    held = packets.groupBy(w).agg(F.hll_sketch_agg(key, lg_k).alias("sketch"))
    return held.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sketch")


def roll_up_sketches(sketches: DataFrame, window: str) -> DataFrame:
    """Stored sketches merged into longer windows, without the packets."""
    w = F.window("window_start", to_interval(window)).alias("w")
    held = sketches.groupBy(w).agg(F.hll_union_agg("sketch").alias("sketch"))
    return held.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sketch")


def sketch_counts(sketches: DataFrame) -> DataFrame:
    return sketches.select("window_start", "window_end", F.hll_sketch_estimate("sketch").alias("sources"))


def key_entropy(packets: DataFrame, window: str, key: str = "src_ip") -> DataFrame:
    """Shannon entropy (bits) of the packet share of the keys in every window.

    With n packets in all, H = log2(n) - sum(c * log2(c)) / n, so one count per key
    and two sums per window are enough.
    """
    w = F.window("ts", to_interval(window)).alias("w")
    c = F.col("_c").cast("double")
    total = F.sum(c)
    entropy = F.log2(total) - F.sum(c * F.log2(c)) / total
    return (
        packets.groupBy(w, key)
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("keys"), F.greatest(entropy, F.lit(0.0)).alias("entropy"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "keys", "entropy")
    )


def rate_threshold(counters: DataFrame, syn_per_sec: float = 1000.0) -> DataFrame:
    """Window counters with the SYN rate and whether it is above the limit."""
    seconds = (F.unix_micros("window_end") - F.unix_micros("window_start")).cast("double") / F.lit(1e6)
    per_second = F.col("syn_count").cast("double") / seconds
    return counters.withColumn("syn_rate", per_second).withColumn("is_attack", per_second > F.lit(float(syn_per_sec)))
