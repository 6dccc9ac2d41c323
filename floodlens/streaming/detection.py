"""Structured Streaming: the same operators on packets as they arrive.

Windows close by event time. A packet later than the watermark is dropped, all
others land in the window of their own timestamp.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from floodlens.durations import to_interval, to_micros
from floodlens.operators.blacklist import (
    NEVER,
    block_sources,
    checked_ttl,
    judge_windows,
    state_name,
    without_blocks,
)
from floodlens.operators.counters import windowed_counters
from floodlens.operators.detect import alerts_of_verdicts
from floodlens.operators.features import feature_vector
from floodlens.operators.telemetry import (
    accumulate_throughput,
    telemetry_detection,
    window_throughput,
)
from floodlens.plans.detection import Scorer, detections_of
from floodlens.schemas import DEFAULT_THRESHOLD, DEFAULT_TTL, DEFAULT_WINDOW, PERMANENT_US
from floodlens.sources.sinks import write_alerts

DEFAULT_WATERMARK = "2 seconds"


def stream_counters(
    packets: DataFrame,
    window: str = DEFAULT_WINDOW,
    watermark: str = DEFAULT_WATERMARK,
    with_iat_sq: bool = False,
) -> DataFrame:
    """Counters per source and closed window; state is one row per open pair. ``with_iat_sq`` adds
    squared gaps, for which the instants of open time slices are held too."""
    return windowed_counters(packets.withWatermark("ts", to_interval(watermark)), window, with_iat_sq=with_iat_sq)


def stream_features(
    packets: DataFrame, window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK
) -> DataFrame:
    return feature_vector(stream_counters(packets, window, watermark))


def stream_throughput(
    packets: DataFrame, window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK
) -> DataFrame:
    """Packets and bytes per closed window."""
    return window_throughput(packets.withWatermark("ts", to_interval(watermark)), window)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Append closed windows to files; ``once`` stops when the input is used up."""
    writer = (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def open_packets(query: StreamingQuery, packets: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Packets of the windows that a finished run left open, from the same input as a batch.

    A stream emits a window when the watermark passes its end, so a finite input leaves its
    last windows in state. The watermark of the last batch tells which: windows that end
    later. Packets that came too late belong to closed windows and stay out.
    """
    seen = (query.lastProgress or {}).get("eventTime", {}).get("watermark")
    if seen is None:
        return packets
    passed = F.lit(seen).cast("timestamp")
    # Windows that end after the watermark start after it less their width: this filter reaches the scan.
    recent = F.col("ts") >= passed - F.expr(f"INTERVAL '{to_interval(window)}'")
    return packets.where(recent & (F.window("ts", to_interval(window))["end"] > passed))


# Keyed state with timers needs this store; it keeps state on disk and writes only what changed.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Groups that sources are dealt to. A call into Python serves all sources of a group; the number
# bounds the tasks of a batch and is part of a checkpoint.
BUCKETS = 256


class SourceBlocks(StatefulProcessor):
    """The end of each source's block, as keyed state in a map per bucket of sources.

    A batch looks up the sources that have windows in it and writes those whose block changed.
    Blocks with an end are listed by that end too: a timer takes just these from the store when
    the watermark passes it, as windows that close later start later. Blocks for good stay, and
    are never read again without a window of their source, nor written.
    """

    def __init__(self, ttl_us: int, columns: list[str]) -> None:
        self.ttl_us, self.columns = ttl_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getMapState("until", "src_ip BIGINT", "until BIGINT")
        self.ending = handle.getMapState("ending", "until BIGINT", "sources ARRAY<BIGINT>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [x for x in rows if len(x)]
        if not frames:  # a batch that only moves the watermark
            yield self.nothing()
            return
        windows = pd.concat(frames).sort_values(["src_ip", "start_us"], ignore_index=True)
        starts, ends = windows["start_us"].to_numpy(), windows["end_us"].to_numpy()
        flags, source = windows["is_attack"].to_numpy(bool), windows["src_ip"].to_numpy()
        state, blocked = np.zeros(len(windows), np.int8), np.full(len(windows), NEVER)
        edges = [0, *(np.flatnonzero(np.diff(source)) + 1).tolist(), len(source)]
        attacked = np.logical_or.reduceat(flags, edges[:-1]).tolist()
        known, ending = self.until.exists(), {}
        for low, high, attack in zip(edges[:-1], edges[1:], attacked):
            held = self.until.getValue((int(source[low]),)) if known else None
            if not held and not attack:
                continue
            own, before = slice(low, high), held[0] if held else NEVER
            state[own], blocked[own], until = judge_windows(starts[own], ends[own], flags[own], before, self.ttl_us)
            if until != before:
                self.until.updateValue((int(source[low]),), (until,))
                ending.setdefault(until, []).append(int(source[low]))
        for until, sources in ending.items():
            if until != PERMANENT_US:
                listed = self.ending.getValue((until,))
                self.ending.updateValue((until,), ([*(listed[0] if listed else []), *sources],))
                self.handle.registerTimer(-(-until // 1000))
        yield windows[self.columns].assign(state_code=state, until_us=np.where(blocked == NEVER, 0, blocked))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        for until in [x[0] for x in self.ending.keys() if x[0] <= now]:
            for source in self.ending.getValue((until,))[0]:
                held = self.until.getValue((source,))
                # A source may be in a later block by now.
                if held and held[0] <= until:
                    self.until.removeKey((source,))
            self.ending.removeKey((until,))
        yield self.nothing()

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame(columns=[*self.columns, "state_code", "until_us"], dtype=object)

    def close(self) -> None:
        pass


def stream_verdicts(
    detections: DataFrame,
    ttl: str | int = DEFAULT_TTL,
    window: str = DEFAULT_WINDOW,
    blocking: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """`block_sources` on a stream of closed windows: a stream of verdicts, with blocks as keyed state.

    Closed windows leave the aggregation in time order over batches, so each source only needs the
    end of its last block. The state is part of the checkpoint, so a repeated batch finds it as it was.
    """
    ttl_us = checked_ttl(ttl, window)
    if not blocking:
        return without_blocks(detections)
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    # Rows pass Python one by one: measures as one array. NaN is how it gives back a null.
    measures = [f.name for f in detections.schema.fields if isinstance(f.dataType, T.DoubleType)]
    others = [c for c in detections.columns if c not in ("window_start", "window_end", *measures)]
    plain = detections.select(
        *others,
        F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"),
        F.array(*measures).alias("measures"),
        F.pmod(F.hash("src_ip"), F.lit(buckets)).alias("bucket"),
    ).withColumn("is_attack", F.coalesce("is_attack", F.lit(False)))
    more = [T.StructField("state_code", T.ByteType()), T.StructField("until_us", T.LongType())]
    judged = plain.groupBy("bucket").transformWithStateInPandas(
        SourceBlocks(ttl_us, plain.columns), T.StructType([*plain.schema.fields, *more]), "append", "eventtime"
    )
    back = {c: F.nanvl(F.col("measures")[i], F.lit(None).cast("double")).alias(c) for i, c in enumerate(measures)}
    back["window_start"] = F.timestamp_micros("start_us").alias("window_start")
    back["window_end"] = F.timestamp_micros("end_us").alias("window_end")
    return judged.select(
        *[back.get(c, c) for c in detections.columns],
        state_name(F.col("state_code")).alias("state"),
        F.when(F.col("state_code") > 0, F.timestamp_micros("until_us")).alias("blocked_until"),
    )


class VerdictLog:
    """Writes verdicts batch by batch, each under its number, so that a repeated batch overwrites itself.

    * ``verdicts/batch=N``  windows with state and blocked_until
    * ``alerts/batch=N``    JSON lines

    Telemetry and throughput are views of the verdicts (`read_stream_output`).
    """

    def __init__(
        self, path: str, window: str = DEFAULT_WINDOW, ttl: str | int = DEFAULT_TTL, blocking: bool = True
    ) -> None:
        self.path, self.window, self.ttl, self.blocking = path, window, ttl, blocking

    def __call__(self, verdicts: DataFrame, batch_id: int) -> None:
        verdict_path = f"{self.path}/verdicts/batch={batch_id}"
        verdicts.write.mode("overwrite").parquet(verdict_path)
        # Read back: the alerts must not repeat the aggregation.
        written = verdicts.sparkSession.read.schema(verdicts.schema).parquet(verdict_path)
        write_alerts(alerts_of_verdicts(written), f"{self.path}/alerts/batch={batch_id}", "overwrite")

    def finish(
        self,
        query: StreamingQuery,
        packets: DataFrame,
        scorer: Scorer | None = None,
        at: float = DEFAULT_THRESHOLD,
    ) -> None:
        """Judge the windows that a finished run left open, as one more batch.

        If the stream goes on later, its next batch takes this one's number and place.
        """
        rest = detections_of(windowed_counters(open_packets(query, packets, self.window), self.window), scorer, at)
        last = query.lastProgress
        number = last["batchId"] + 1 if last else 0
        carried = None
        if last and self.blocking:
            earlier = read_stream_output(packets.sparkSession, self.path, "verdicts", below=number)
            carried = earlier.where("state = 'BLOCK'").groupBy("src_ip").agg(F.max("blocked_until").alias("blocked_until"))
        self(block_sources(rest, self.ttl, self.window, self.blocking, carried), number)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_block(
    packets: DataFrame,
    path: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    window: str = DEFAULT_WINDOW,
    at: float = DEFAULT_THRESHOLD,
    ttl: str | int = DEFAULT_TTL,
    watermark: str = DEFAULT_WATERMARK,
    blocking: bool = True,
    once: bool = True,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Detection with blocks and alerts on a live stream; verdicts and alerts go below ``path``."""
    spark = packets.sparkSession
    if not _exists(spark, f"{checkpoint}/metadata") and _exists(spark, f"{path}/verdicts"):
        raise RuntimeError(f"{path} holds verdicts of another run; use the output folder of this checkpoint")
    detections = detections_of(stream_counters(packets, window, watermark), scorer, at)
    verdicts = stream_verdicts(detections, ttl, window, blocking)
    log = on_batch or VerdictLog(path, window, ttl, blocking)
    writer = verdicts.writeStream.outputMode("append").foreachBatch(log).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class LateSplit:
    """Keeps late packets as data: each batch is written once, with a mark on the rows whose window had
    closed by the watermark of the batches before, and how late they are."""

    def __init__(self, path: str, window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK) -> None:
        self.path, self.window, self.watermark = path, window, watermark

    def __call__(self, packets: DataFrame, batch_id: int) -> None:
        spark, seen = packets.sparkSession, f"{self.path}/seen/batch="
        before = spark.read.parquet(f"{seen}{batch_id - 1}").first()["latest"] if batch_id else None
        # Watermarks count in milliseconds.
        passed = None if before is None else before // 1000 * 1000 - to_micros(self.watermark)
        closes = F.unix_micros(F.window("ts", to_interval(self.window))["end"])
        lateness = F.when(closes <= F.lit(passed).cast("long"), F.lit(passed).cast("long") - F.unix_micros("ts"))
        rows = f"{self.path}/packets/batch={batch_id}"
        marked = packets.withColumn("lateness_us", lateness).withColumn("late", F.col("lateness_us").isNotNull())
        marked.write.mode("overwrite").parquet(rows)
        latest = spark.read.parquet(rows).agg(F.max(F.unix_micros("ts")).alias("latest"))
        if before is not None:
            latest = latest.select(F.greatest("latest", F.lit(before)).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{seen}{batch_id}")


def split_late(
    packets: DataFrame,
    path: str,
    checkpoint: str,
    window: str = DEFAULT_WINDOW,
    watermark: str = DEFAULT_WATERMARK,
    once: bool = True,
) -> StreamingQuery:
    """All packets of a stream below ``path/packets``, late ones marked, none lost."""
    split = LateSplit(path, window, watermark)
    writer = packets.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that a query's aggregations left out behind the watermark, from its recent progress."""
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    return sum(o["numRowsDroppedByWatermark"] for o in operators)


def window_totals(verdicts: DataFrame) -> DataFrame:
    """Passed packets and bytes, and dropped packets, per window. Packets of a source that is blocked at
    that moment are left out before anything is counted: their window is dropped as a whole."""
    dropped = F.col("state") == "DROPPED"
    zero = F.lit(0).cast("long")
    return verdicts.groupBy("window_start", "window_end").agg(
        F.sum(F.when(dropped, zero).otherwise(F.col("pkt_count").cast("long"))).alias("total_pkts"),
        F.sum(F.when(dropped, zero).otherwise(F.col("byte_count").cast("long"))).alias("total_bytes"),
        F.sum(F.when(dropped, F.col("pkt_count").cast("long")).otherwise(zero)).alias("total_dropped"),
    )


def dropped_packets(verdicts: DataFrame) -> DataFrame:
    """Packets and bytes that live blocks kept out, per source and window."""
    gone = verdicts.where(F.col("state") == "DROPPED")
    counts = [F.col(c).cast("long").alias(new) for c, new in (("pkt_count", "packets"), ("byte_count", "bytes"))]
    return gone.select("src_ip", "window_start", "window_end", *counts, "blocked_until")


def read_stream_output(spark: SparkSession, path: str, name: str, below: int | None = None) -> DataFrame:
    """All batches of one output: 'verdicts', or what follows from them, 'telemetry' (one point per
    scored source), 'throughput' (per window) and 'dropped'; below: only batches before that one."""
    found = spark.read.option("basePath", f"{path}/verdicts").parquet(f"{path}/verdicts/batch=*")
    verdicts = (found if below is None else found.where(F.col("batch") < below)).drop("batch")
    views = {
        "verdicts": lambda: verdicts,
        "telemetry": lambda: telemetry_detection(verdicts.where("state <> 'DROPPED'")),
        "throughput": lambda: window_totals(verdicts),
        "dropped": lambda: dropped_packets(verdicts),
    }
    return views[name]()


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    """Per window what passed and what was dropped, with totals since the beginning."""
    return accumulate_throughput(read_stream_output(spark, path, "throughput"))
