"""Time-limited blocks: filtering packets by them and deriving them from detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.durations import to_micros
from floodlens.schemas import DEFAULT_TTL, DEFAULT_WINDOW, PERMANENT_US, require
from floodlens.session import broadcast_if_small

# --- packets against a blacklist ---------------------------------------------


def _merged_intervals(entries: DataFrame) -> DataFrame:
    """Disjoint [start, stop) block intervals per source.

    Sorting is per source over blacklist entries, never over packets.
    """
    by_start = Window.partitionBy("src_ip").orderBy("_start", "_stop")
    reach = F.max("_stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("_start") > reach), 1).otherwise(0)
    island = F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        entries.withColumn("_opens", opens)
        .withColumn("_island", island)
        .groupBy("src_ip", "_island")
        .agg(F.min("_start").alias("_start"), F.max("_stop").alias("_stop"))
        .drop("_island")
    )


def mark_blacklisted(packets: DataFrame, blacklist: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Add ``dropped``: whether an entry of the source covers the packet.

    An entry holds during [blocked_at, blocked_at + ttl); ttl 0 never ends. The
    interval condition is turned into an equality by cutting entries into time
    buckets, so a source with many entries and most of the packets is spread over
    its buckets. Entries are merged first, hence at most one matches per packet.
    """
    require(blacklist, ["src_ip", "blocked_at", "ttl_us"])
    width = to_micros(bucket)
    start = F.unix_micros("blocked_at")
    permanent = (
        blacklist.where(F.col("ttl_us") == 0).groupBy("src_ip").agg(F.min(start).alias("_forever_from"))
    )
    limited = _merged_intervals(
        blacklist.where(F.col("ttl_us") > 0).select(
            "src_ip", start.alias("_start"), (start + F.col("ttl_us")).alias("_stop")
        )
    )
    pieces = limited.selectExpr(
        "src_ip AS _src",
        "_start",
        "_stop",
        f"explode(sequence(_start div {width}, (_stop - 1) div {width})) AS _bucket",
    )
    at = F.unix_micros("ts")
    covered = (
        (F.col("src_ip") == F.col("_src"))
        & (F.expr(f"unix_micros(ts) div {width}") == F.col("_bucket"))
        & (at >= F.col("_start"))
        & (at < F.col("_stop"))
    )
    joined = packets.join(broadcast_if_small(pieces), covered, "left").join(
        broadcast_if_small(permanent), "src_ip", "left"
    )
    dropped = F.col("_src").isNotNull() | F.coalesce(at >= F.col("_forever_from"), F.lit(False))
    return joined.select(*packets.columns, dropped.alias("dropped"))


def blacklist_filter(packets: DataFrame, blacklist: DataFrame, keep: str = "passed") -> DataFrame:
    """Packets that pass (or, with ``keep='dropped'``, that are dropped)."""
    if keep not in ("passed", "dropped"):
        raise ValueError("keep must be 'passed' or 'dropped'")
    marked = mark_blacklisted(packets, blacklist)
    wanted = F.col("dropped") if keep == "dropped" else ~F.col("dropped")
    return marked.where(wanted).drop("dropped")


# --- detections to blocks ----------------------------------------------------

NEVER = np.iinfo(np.int64).min


def judge_windows(
    starts: np.ndarray, ends: np.ndarray, flags: np.ndarray, until: int, ttl_us: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Windows of one source in time order, after a block until then: codes of their states (0 passed,
    1 blocks, 2 dropped), the block each is in (NEVER: none), and the end of the last block."""
    n = len(starts)
    state, blocked = np.zeros(n, dtype=np.int8), np.full(n, NEVER, dtype=np.int64)
    hits = np.flatnonzero(flags)
    at = int(np.searchsorted(starts, until))
    state[:at] = 2
    blocked[:at] = until
    while True:
        nxt = int(np.searchsorted(hits, at))
        if nxt == len(hits):
            return state, blocked, until
        hit = int(hits[nxt])
        until = PERMANENT_US if ttl_us == 0 else int(ends[hit]) + ttl_us
        at = max(int(np.searchsorted(starts, until)), hit + 1)
        state[hit] = 1
        state[hit + 1 : at] = 2
        blocked[hit:at] = until


def _fold(batches: Iterator[pa.RecordBatch], ttl_us: int) -> Iterator[pa.RecordBatch]:
    """Walk sorted windows of many sources, carrying only the end of the last block.

    Rows arrive ordered by (source, window), so memory is one Arrow batch however
    long a source's history is. Sources without an attack and without a block from
    before are skipped in bulk.
    """
    source, until = None, NEVER
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        src = batch.column("src_ip").to_numpy(zero_copy_only=False)
        start = batch.column("_start").to_numpy(zero_copy_only=False)
        end = batch.column("_end").to_numpy(zero_copy_only=False)
        flag = batch.column("is_attack").to_numpy(zero_copy_only=False).astype(bool)
        carried = batch.column("_carry").to_numpy(zero_copy_only=False)
        state = np.zeros(n, dtype=np.int8)
        blocked = np.full(n, NEVER, dtype=np.int64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(src)) + 1, [n]))
        attacks = np.concatenate(([0], np.cumsum(flag)))
        lows, highs = edges[:-1], edges[1:]
        busy = (attacks[highs] > attacks[lows]) | (carried[lows] > start[lows])
        continues = source is not None and src[0] == source
        busy[0] |= continues
        for segment in np.flatnonzero(busy):
            low, high = lows[segment], highs[segment]
            if segment > 0 or not continues:
                until = carried[low]
            own = slice(low, high)
            state[own], blocked[own], until = judge_windows(start[own], end[own], flag[own], until, ttl_us)
        if not busy[-1]:
            until = NEVER
        source = src[-1]
        passed_on = [c for c in batch.schema.names if c not in ("_start", "_end", "_carry")]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in passed_on],
                pa.array(state),
                pa.array(blocked, mask=blocked == NEVER),
            ],
            names=[*passed_on, "_code", "_until"],
        )


def block_sources(
    detections: DataFrame,
    ttl: str | int = DEFAULT_TTL,
    window: str = DEFAULT_WINDOW,
    blocking: bool = True,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Close the loop: an attack blocks its source, blocked windows are not scored.

    A flagged window blocks its source for ``ttl`` from the end of that window.
    Windows that start inside the block are DROPPED and do not renew it; the first
    one after it is judged again. ``ttl=0`` blocks for good. ``carry`` holds
    (src_ip, blocked_until) of earlier data.

    The rule is sequential per source and independent across sources: one shuffle
    by source of one row per source and window (packets are long aggregated), and
    a streamed pass over the sorted rows.
    """
    require(detections, ["src_ip", "window_start", "window_end", "is_attack"])
    ttl_us = checked_ttl(ttl, window)
    if not blocking:
        return without_blocks(detections)
    if carry is None:
        carried = detections.withColumn("_carry", F.lit(int(NEVER)).cast("long"))
    else:
        known = carry.groupBy("src_ip").agg(F.unix_micros(F.max("blocked_until")).alias("_carry"))
        carried = detections.join(known, "src_ip", "left").withColumn(
            "_carry", F.coalesce("_carry", F.lit(int(NEVER)).cast("long"))
        )
    ordered = (
        carried.withColumn("is_attack", F.coalesce("is_attack", F.lit(False)))
        .withColumn("_start", F.unix_micros("window_start"))
        .withColumn("_end", F.unix_micros("window_end"))
        .repartition("src_ip")
        .sortWithinPartitions("src_ip", "_start")
        .select(*detections.columns, "_start", "_end", "_carry")
    )
    schema = T.StructType(
        [f for f in detections.schema.fields]
        + [T.StructField("_code", T.ByteType()), T.StructField("_until", T.LongType())]
    )
    folded = ordered.mapInArrow(lambda batches: _fold(batches, ttl_us), schema)
    return folded.select(
        *detections.columns,
        state_name(F.col("_code")).alias("state"),
        F.timestamp_micros("_until").alias("blocked_until"),
    )


def checked_ttl(ttl: str | int, window: str) -> int:
    ttl_us = to_micros(ttl)
    if ttl_us % to_micros(window):
        raise ValueError("ttl must be a multiple of the window, or blocks would end inside one")
    return ttl_us


def without_blocks(detections: DataFrame) -> DataFrame:
    """Verdicts where attacks only raise alerts."""
    verdict = F.when(F.col("is_attack"), "ALERT").otherwise("PASS")
    return detections.withColumn("state", verdict).withColumn("blocked_until", F.lit(None).cast("timestamp"))


def state_name(code: Column) -> Column:
    return F.when(code == 1, "BLOCK").when(code == 2, "DROPPED").otherwise("PASS")


def blocks_of(verdicts: DataFrame) -> DataFrame:
    """Blacklist entries that the verdicts created."""
    started = F.col("window_end")
    span = F.unix_micros("blocked_until") - F.unix_micros(started)
    forever = F.unix_micros("blocked_until") == F.lit(PERMANENT_US)
    return verdicts.where(F.col("state") == "BLOCK").select(
        "src_ip", started.alias("blocked_at"), F.when(forever, 0).otherwise(span).cast("long").alias("ttl_us")
    )
