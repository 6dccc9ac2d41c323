"""Throughput and detection telemetry, and the fixed queries that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.durations import to_interval, to_micros
from floodlens.functions.network import int_to_ip
from floodlens.operators.ordered import lag_in_slices, running_totals, time_slice
from floodlens.schemas import DEFAULT_WINDOW, require

# --- fixed values: telemetry layout and dashboard bands -----------------------
GLOBAL_FIELDS = ["total_pkts", "total_bytes", "total_dropped"]
DETECTION_TAGS = ["src_ip", "is_attack"]
DETECTION_FIELDS = [
    "score",
    "pkt_count",
    "byte_count",
    "syn_count",
    "syn_ack_ratio",
    "pkt_size_mean",
    "flow_duration",
    "iat_mean",
]
DROP_BANDS = (100, 1000)
SCORE_BANDS = (0.5, 0.85)
# ---------------------------------------------------------------------------

_DAY = "1 day"


def window_throughput(packets: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Passed packets and bytes and dropped packets per window.

    Reads the ``dropped`` column of marked packets; without it nothing is dropped.
    """
    dropped = F.col("dropped") if "dropped" in packets.columns else F.lit(False)
    w = F.window("ts", to_interval(window))
    return (
        packets.groupBy(w.alias("w"))
        .agg(
            F.sum(F.when(dropped, 0).otherwise(1).cast("long")).alias("total_pkts"),
            F.sum(F.when(dropped, F.lit(0).cast("long")).otherwise(F.col("pkt_len"))).alias("total_bytes"),
            F.sum(F.when(dropped, 1).otherwise(0).cast("long")).alias("total_dropped"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *GLOBAL_FIELDS)
    )


def accumulate_throughput(per_window: DataFrame) -> DataFrame:
    """Add totals since the beginning; parallel over days."""
    sliced = per_window.withColumn("_slice", time_slice("window_start", to_micros(_DAY)))
    cumulative = {c: c.replace("total_", "cum_") for c in GLOBAL_FIELDS}
    return running_totals(sliced, "_slice", ["window_start"], cumulative).drop("_slice")


def global_throughput(packets: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    return accumulate_throughput(window_throughput(packets, window))


def telemetry_global(throughput: DataFrame) -> DataFrame:
    """One point per cycle: cumulative integers, stamped with the end of the window."""
    return throughput.select(
        F.lit("global_throughput").alias("measurement"),
        F.col("window_end").alias("ts"),
        *[F.col(c.replace("total_", "cum_")).cast("long").alias(c) for c in GLOBAL_FIELDS],
    )


def telemetry_detection(detections: DataFrame, at: str = "window_end") -> DataFrame:
    """One point per scored source and cycle, attack or not."""
    require(detections, ["src_ip", "is_attack", *DETECTION_FIELDS])
    return detections.select(
        F.lit("detection").alias("measurement"),
        F.col(at).alias("ts"),
        int_to_ip("src_ip").alias("src_ip"),
        F.col("is_attack").cast("string").alias("is_attack"),
        *[F.col(c).cast("double").alias(c) for c in DETECTION_FIELDS],
    )


def to_long(points: DataFrame) -> DataFrame:
    """Points as (measurement, ts, src_ip, is_attack, field, value)."""
    return points.unpivot(
        ["measurement", "ts", *DETECTION_TAGS], DETECTION_FIELDS, "field", "value"
    )


def from_long(long_points: DataFrame) -> DataFrame:
    """Fields back to columns; the list is fixed, so one aggregate does it."""
    return long_points.groupBy("measurement", "ts", *DETECTION_TAGS).agg(
        *[F.expr(f"max(CASE WHEN field = '{f}' THEN value END)").alias(f) for f in DETECTION_FIELDS]
    )


def in_range(points: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Points in [start, stop); also prunes date partitions where they exist."""
    if start is not None:
        since = F.lit(start).cast("timestamp")
        points = points.where(F.col("ts") >= since)
        if "date" in points.columns:
            points = points.where(F.col("date") >= F.to_date(since))
    if stop is not None:
        until = F.lit(stop).cast("timestamp")
        points = points.where(F.col("ts") < until)
        if "date" in points.columns:
            points = points.where(F.col("date") <= F.to_date(until))
    return points


def rate(
    series: DataFrame, value: str, unit: str = "1 second", reset: str = "null", slices: str = _DAY
) -> DataFrame:
    """Non-negative change of a cumulative value per unit of time.

    The first point gives no row. A falling value means the counter started again:
    NULL by default, or with ``reset='zero'`` the new value counts from zero.
    """
    if reset not in ("null", "zero"):
        raise ValueError("reset must be 'null' or 'zero'")
    points = series.select("ts", value).withColumn("_slice", time_slice("ts", to_micros(slices)))
    lagged = lag_in_slices(points, [], "_slice", "ts", {"ts": "_ts", value: "_value"})
    change = F.col(value).cast("double") - F.col("_value").cast("double")
    fallen = F.lit(None).cast("double") if reset == "null" else F.col(value).cast("double")
    elapsed = (F.unix_micros("ts") - F.unix_micros("_ts")).cast("double") / F.lit(float(to_micros(unit)))
    return lagged.where(F.col("_ts").isNotNull()).select(
        "ts", (F.when(change >= 0, change).otherwise(fallen) / elapsed).alias("rate")
    )


def band(value: Column, limits: tuple[float, float]) -> Column:
    """Colour of a value; a limit belongs to the band it opens."""
    return F.when(value >= limits[1], "red").when(value >= limits[0], "yellow").otherwise("green")


def last_value_of(series: DataFrame, value: str, limits: tuple[float, float] = DROP_BANDS) -> DataFrame:
    """Latest sample of a series with its band; no sort is needed."""
    return series.agg(F.max("ts").alias("ts"), F.max_by(value, "ts").alias(value)).select(
        "ts", value, band(F.col(value), limits).alias("band")
    )


def score_timeline(points: DataFrame, limits: tuple[float, float] = SCORE_BANDS) -> DataFrame:
    """Score per source over time with its band; each source's points together and in order."""
    banded = points.select("src_ip", "ts", "score", band(F.col("score"), limits).alias("band"))
    return banded.repartition("src_ip").sortWithinPartitions("src_ip", "ts")


def attack_log(points: DataFrame, n: int = 50, scope: str = "source") -> DataFrame:
    """Newest attack points: ``n`` per source, or ``n`` altogether.

    Both forms cut down to n rows per task before anything is shuffled.
    """
    attacks = points.where(F.col("is_attack") == "true")
    if scope == "all":
        return attacks.orderBy(F.desc("ts"), "src_ip").limit(n)
    if scope != "source":
        raise ValueError("scope must be 'source' or 'all'")
    newest = Window.partitionBy("src_ip").orderBy(F.desc("ts"))
    return attacks.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def detection_latency(
    alerts: DataFrame,
    attacks: DataFrame,
    limit: str = "2 seconds",
    timeout: str | None = None,
    by: tuple[str, ...] = ("src_ip",),
) -> DataFrame:
    """Time from the first attack packet to the first alert, per source or over all.

    ``status`` is PASS below the limit, FAIL above it, TIMEOUT without an alert (or
    with one later than ``timeout``). Both sides are reduced to one row per key
    before they are joined.
    """
    if by:
        first_attack = attacks.groupBy(*by).agg(F.min("ts").alias("attack_at"))
        fired = alerts.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("timestamp").alias("_alert"))
        same = [F.col(k) == F.col(f"_{k}") for k in by]
        joined = (
            first_attack.join(fired, [*same, F.col("_alert") >= F.col("attack_at")], "left")
            .groupBy(*by, "attack_at")
            .agg(F.min("_alert").alias("alert_at"))
        )
    else:
        start = attacks.agg(F.min("ts")).first()[0]  # one value
        since = F.lit(start).cast("timestamp")
        joined = alerts.where(F.col("timestamp") >= since).agg(
            since.alias("attack_at"), F.min("timestamp").alias("alert_at")
        )
    latency = F.unix_micros("alert_at") - F.unix_micros("attack_at")
    late = F.lit(False) if timeout is None else F.col("latency_us") > to_micros(timeout)
    status = (
        F.when(F.col("latency_us").isNull() | late, "TIMEOUT")
        .when(F.col("latency_us") < to_micros(limit), "PASS")
        .otherwise("FAIL")
    )
    return joined.withColumn("latency_us", latency).select(
        *by, "attack_at", "alert_at", "latency_us", status.alias("status")
    )
