"""Per-source traffic counters: all algebraic, so they combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.durations import to_interval, to_micros
from floodlens.functions.traffic import protocol_class
from floodlens.operators.ordered import lag_in_slices, time_slice
from floodlens.schemas import DEFAULT_WINDOW, SUM_COUNTERS, require

WINDOW_KEYS = ["src_ip", "window_start", "window_end"]


def classify_protocol(packets: DataFrame) -> DataFrame:
    """Add the protocol class; SYN and ACK flags count only on TCP packets.

    A packet with both flags set counts in both.
    """
    require(packets, ["proto", "tcp_syn", "tcp_ack"])
    return packets.withColumn("proto_class", protocol_class("proto")).selectExpr(
        "*",
        "proto_class = 'tcp' AND coalesce(tcp_syn, false) AS is_syn",
        "proto_class = 'tcp' AND coalesce(tcp_ack, false) AS is_ack",
    )


def add_window(packets: DataFrame, window: str) -> DataFrame:
    """Tumbling window borders as plain columns."""
    w = F.window("ts", to_interval(window))
    return packets.withColumn("_w", w).select(
        *packets.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")
    )


def counter_aggregates(names: Sequence[str] | None = None) -> list[Column]:
    """Aggregates over classified packets, all or those named.

    The gaps between consecutive packets add up to last minus first arrival, so
    their sum needs no ordering.
    """
    sums = {
        "pkt_count": "count(1)",
        "byte_count": "sum(pkt_len)",
        "syn_count": "count_if(is_syn)",
        "ack_count": "count_if(is_ack)",
        "udp_count": "count_if(proto_class = 'udp')",
        "icmp_count": "count_if(proto_class = 'icmp')",
        "tcp_count": "count_if(proto_class = 'tcp')",
        "other_proto": "count_if(proto_class = 'other')",
        "pkt_size_sum_sq": "sum(pkt_len * pkt_len)",
        "first_seen": "min(ts)",
        "last_seen": "max(ts)",
        "iat_sum_us": "unix_micros(max(ts)) - unix_micros(min(ts))",
    }
    return [F.expr(sql).alias(name) for name, sql in sums.items() if names is None or name in names]


def _count(packets: DataFrame, keys: Sequence[str | Column], by_cpu: bool) -> DataFrame:
    classified = classify_protocol(packets)
    if by_cpu:
        per_cpu = classified.groupBy(*keys, "cpu").agg(*counter_aggregates())
        return merge_counters(per_cpu, per_cpu.columns[: len(keys)])
    return classified.groupBy(*keys).agg(*counter_aggregates())


def _count_with_squares(
    packets: DataFrame, keys: Sequence[str], slice_us: int, by_cpu: bool
) -> DataFrame:
    """Counters plus the sum of squared gaps, from one scan.

    Squared gaps need an order, unlike all other counters. Packets are first added
    up per arrival instant, so copies do not matter; gaps are taken inside time
    slices in parallel and between neighbouring slices, of which a group has few.
    The sum is a DOUBLE: one gap of 4.3 s in ns squared already exceeds 64 bits.
    """
    inner = [*keys, *(["cpu"] if by_cpu else [])]
    counts = [c for c in SUM_COUNTERS if c != "iat_sum_us"]
    gap = "(unix_micros(ts) - unix_micros(_before))"
    jump = "(unix_micros(first_seen) - unix_micros(_left))"
    in_slice = Window.partitionBy(*inner, "_slice").orderBy("ts")
    over_slices = Window.partitionBy(*inner).orderBy("_slice")
    return (
        classify_protocol(packets)
        .groupBy(*inner, "ts")
        .agg(*counter_aggregates(counts))
        .withColumn("_slice", time_slice("ts", slice_us))
        .withColumn("_before", F.lag("ts").over(in_slice))
        .groupBy(*inner, "_slice")
        .agg(
            *[F.sum(c).alias(c) for c in counts],
            F.expr(f"sum({gap})").alias("_gaps"),
            F.expr(f"sum(double({gap}) * {gap})").alias("_squares"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .withColumn("_left", F.lag("last_seen").over(over_slices))
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in counts],
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.expr(f"sum(coalesce(_gaps, 0) + coalesce({jump}, 0))").alias("iat_sum_us"),
            F.expr(f"sum(coalesce(_squares, 0D) + coalesce(double({jump}) * {jump}, 0D))").alias("iat_sum_sq"),
        )
    )


def _stream_squares(packets: DataFrame, window: str) -> DataFrame:
    """`_count_with_squares` on a stream, as two chained aggregations.

    The first holds the different arrival instants of a source in one time slice, and is closed
    with that slice; the second holds one row per slice of an open window. Squares of gaps add
    up inside slices, and between neighbouring ones.
    """
    counts = [c for c in SUM_COUNTERS if c != "iat_sum_us"]
    narrow = F.window("ts", f"{_stream_slice_us(window)} microseconds")
    inside = "transform(slice(_at, 2, size(_at)), (x, i) -> double(x - _at[i]))"
    sliced = (
        classify_protocol(packets)
        .groupBy("src_ip", narrow.alias("_slice"))
        .agg(*counter_aggregates(counts), F.sort_array(F.collect_set(F.unix_micros("ts"))).alias("_at"))
        .select(
            "src_ip",
            "_slice",
            *counts,
            F.expr("named_struct('first', _at[0], 'last', element_at(_at, -1))").alias("_ends"),
            F.expr(f"aggregate({inside}, 0D, (a, g) -> a + g * g)").alias("_squares"),
        )
    )
    between = "transform(slice(_all, 2, size(_all)), (x, i) -> double(x.first - _all[i].last))"
    whole = sliced.groupBy("src_ip", F.window("_slice", to_interval(window)).alias("_w")).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.sum("_squares").alias("_squares"),
        F.sort_array(F.collect_list("_ends")).alias("_all"),
    )
    return whole.select(
        "src_ip",
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        *counts,
        F.expr("timestamp_micros(_all[0].first)").alias("first_seen"),
        F.expr("timestamp_micros(element_at(_all, -1).last)").alias("last_seen"),
        F.expr("element_at(_all, -1).last - _all[0].first").alias("iat_sum_us"),
        F.expr(f"_squares + aggregate({between}, 0D, (a, g) -> a + g * g)").alias("iat_sum_sq"),
    )


# Widest time slice that one task orders for one source: it bounds a flooding source's rows in
# a task by its packet rate, whatever the length of the history.
SLICE_US = 10_000_000


def source_counters(packets: DataFrame, by_cpu: bool = False, with_iat_sq: bool = False) -> DataFrame:
    """Counters per source over everything given.

    ``by_cpu`` measures gaps between packets seen by the same CPU and adds them
    up; the default measures true gaps per source.
    """
    if with_iat_sq:
        return _count_with_squares(packets, ["src_ip"], SLICE_US, by_cpu)
    return _count(packets, ["src_ip"], by_cpu)


def windowed_counters(
    packets: DataFrame, window: str = DEFAULT_WINDOW, by_cpu: bool = False, with_iat_sq: bool = False
) -> DataFrame:
    """Counters per source and tumbling window; gaps never cross a window border.

    Grouping is by the window struct itself, which keeps the event time of streams.
    ``with_iat_sq`` adds the sum of squared gaps.
    """
    if with_iat_sq and packets.isStreaming:
        if by_cpu:
            raise ValueError("squared gaps by CPU are for batches only")
        return _stream_squares(packets, window)
    if with_iat_sq:
        return _count_with_squares(add_window(packets, window), WINDOW_KEYS, _slice_us(window), by_cpu)
    counted = _count(packets, ["src_ip", F.window("ts", to_interval(window)).alias("_w")], by_cpu)
    others = [c for c in counted.columns if c not in ("src_ip", "_w")]
    return counted.select(
        "src_ip", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *others
    )


def _slice_us(window: str) -> int:
    """64 slices, or more where those would be longer than SLICE_US."""
    return min(max(to_micros(window) // 64, 1), SLICE_US)


def _stream_slice_us(window: str) -> int:
    """Slices of streams cut a window evenly: the width of 64 or the next possible number of them."""
    width = to_micros(window)
    least = max(64, -(-width // SLICE_US))
    return next((width // n for n in range(least, min(4 * least, width) + 1) if width % n == 0), width)


def merge_counters(counters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial counters: sums, earliest first_seen and latest last_seen.

    Also rolls small windows up when ``keys`` holds a coarser window. A first_seen
    at the epoch means "not set".
    """
    seen = F.when(F.unix_micros("first_seen") > 0, F.col("first_seen"))
    sums = [c for c in [*SUM_COUNTERS, "iat_sum_sq"] if c in counters.columns]
    return counters.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min(seen).alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def roll_up(counters: DataFrame, window: str) -> DataFrame:
    """Window counters merged into longer windows."""
    w = F.window("window_start", to_interval(window))
    coarse = (
        counters.withColumn("_w", w)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )
    return merge_counters(coarse, WINDOW_KEYS)


def inter_arrival(
    packets: DataFrame, window: str = DEFAULT_WINDOW, by_cpu: bool = False
) -> DataFrame:
    """Gap to the previous packet of the same source in the same window.

    One row per source, window and arrival instant with the number of packets at
    that instant; all packets after the first one at an instant have gap 0. The
    first instant of a window has no gap.
    """
    keys = [*WINDOW_KEYS, *(["cpu"] if by_cpu else [])]
    instants = (
        add_window(packets, window)
        .groupBy(*keys, "ts")
        .agg(F.count(F.lit(1)).alias("packets"))
        .withColumn("_slice", time_slice("ts", _slice_us(window)))
    )
    # Both sides of the stitch read the same columns, so Spark shuffles the instants
    # once and reuses them.
    lagged = lag_in_slices(instants, keys, "_slice", "ts", {"ts": "_before", "packets": "_seen"})
    gap = F.expr("CASE WHEN _seen > 0 THEN unix_micros(ts) - unix_micros(_before) END")
    return lagged.select(*keys, "ts", "packets", gap.alias("iat_us"))
