"""Every operator as a query over whole benchmark tables.

Times are given as microseconds since the epoch and measures are rounded, so that
results can be compared with other engines value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floodlens.functions import text
from floodlens.functions.network import int_to_ip, ip_to_int
from floodlens.functions.traffic import DERIVED, derived
from floodlens.operators import blacklist as bl
from floodlens.operators import counters as ct
from floodlens.operators import detect, features, flows, metrics, models, scoring, sketch, split, telemetry
from floodlens.operators.smote import smote as balance
from floodlens.plans import detection, training, views
from floodlens.schemas import FEATURES, FLOW_FEATURES
from floodlens.session import materialize, release, scratch_dir, store
from floodlens.sources import flows as flow_files
from floodlens.sources import packets as packet_files
from floodlens.sources import sinks
from floodlens.streaming import detection as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The benchmark events are sparse (a packet per source in half a day), hence long
# windows and small rule limits.
DAY = "1 day"
RULE = {"ratio": 1.0, "packets": 2.0, "duration": 43200.0}
AT = 0.5
TTL = "3 days"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def us(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def rounded(names, digits: int = 6) -> list[Column]:
    return [F.expr(f"round(`{n}`, {digits}) AS `{n}`") for n in names]


def _day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.windowed_counters(views.packets(spark, sf_dir), DAY)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.detect(views.packets(spark, sf_dir), scoring.rule_score(**RULE), DAY, AT)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.block_sources(_detections(spark, sf_dir), TTL, DAY)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.alert_rows(detect.decide_action(_detections(spark, sf_dir)))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.telemetry_detection(_detections(spark, sf_dir))


def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = bl.mark_blacklisted(views.packets(spark, sf_dir), views.blacklist(spark, sf_dir))
    return telemetry.global_throughput(marked, "1 hour")


def _flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.select_features(flows.flow_features(views.flows(spark, sf_dir)), ["flow_id"])


# --- sources and sinks --------------------------------------------------------


def _flow_files(spark: SparkSession, raw: DataFrame) -> str:
    """CSV files whose headers differ in order and blanks, and where some write 3 as 3.0."""
    path = scratch_dir(spark, "flows-csv")
    raw = raw.withColumn("Flow ID", F.concat(F.lit("flow, "), "flow_id"))
    even, odd = (raw.where(f"`Total Backward Packets` % 2 = {r}") for r in (0, 1))
    odd = odd.withColumn("Total Fwd Packets", F.col("Total Fwd Packets").cast("double"))
    for part, names in ((even, raw.columns), (odd, raw.columns[::-1])):
        part.select(*[F.col(f"`{c}`").alias(f" {c}") for c in names]).write.mode("append").option(
            "header", True
        ).option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


@query
def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = flow_files.read_flows(spark, _flow_files(spark, views.broken_flows(spark, sf_dir)))
    duration = F.col("Flow Duration")
    endless = F.coalesce(duration == float("inf"), F.lit(False))
    return loaded.select(
        "flow_id",
        "Flow ID",
        F.col("Total Fwd Packets").alias("fwd"),
        F.col("ACK Flag Count").alias("ack"),
        F.round("Packet Length Mean", 9).alias("len_mean"),
        F.when(~endless, duration).alias("duration"),
        endless.alias("endless"),
        "Label",
    )


@query
def read_flows_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = flow_files.read_flows(spark, _flow_files(spark, views.broken_flows(spark, sf_dir)))
    return flows.cleaning_stats(loaded, flows.clean_flows(loaded))


@query
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.broken_flows(spark, sf_dir)
    said = F.expr("CASE WHEN `SYN Flag Count` = 3 THEN concat('n/a ', flow_id) ELSE string(`Flow Duration`) END")
    return flow_files.parse_errors(spark, _flow_files(spark, raw.withColumn("Flow Duration", said)))


@query
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_files.load_report(views.broken_flows(spark, sf_dir))


@query
def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "packets")
    views.packets(spark, sf_dir).write.parquet(path)
    return packet_files.read_packets(spark, path).select(
        "src_ip", us("ts"), "proto", "tcp_syn", "tcp_ack", "pkt_len"
    )


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a table, as a capture would leave them."""
    return materialize(views.frames(spark, sf_dir), "frames")


@query
def decode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_files.decode_frames(_captured(spark, sf_dir)).select(
        "event_id", "src_ip", us("ts"), "proto", "tcp_syn", "tcp_ack", "pkt_len"
    )


@query
def valid_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_files.valid_ipv4(_captured(spark, sf_dir)).select(
        "event_id", F.length("frame").alias("size")
    )


def _marked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded headers with the blacklist asked before the transport header is looked at."""
    return bl.mark_blacklisted(packet_files.decode_headers(_captured(spark, sf_dir)), views.blacklist(spark, sf_dir))


@query
def frames_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked_frames(spark, sf_dir).where("dropped OR l4_ok")
    return telemetry.global_throughput(marked, "1 hour").select(
        us("window_start"), *telemetry.GLOBAL_FIELDS, "cum_pkts", "cum_bytes", "cum_dropped"
    )


@query
def frames_to_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames, blacklist, counters, features, scores, blocks."""
    passed = packet_files.countable(_marked_frames(spark, sf_dir).where("NOT dropped").drop("dropped"))
    verdicts = detection.judge(passed, scoring.rule_score(**RULE), DAY, AT, TTL)
    return verdicts.select(
        "src_ip", us("window_start"), "is_attack", "state", F.coalesce(F.unix_micros("blocked_until"), F.lit(-1)).alias("blocked_until")
    )


@query
def write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = training.prepare(views.broken_flows(spark, sf_dir), balance=False)
    path = scratch_dir(spark, "splits")
    sinks.write_splits(ready.train, ready.test, ready.scaler, path)
    train, test, _ = sinks.read_splits(spark, path)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("part", "flow_id", *rounded(FLOW_FEATURES), "label")


@query
def write_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "alerts")
    sinks.write_alerts(_alerts(spark, sf_dir), path)
    return sinks.read_alerts(spark, path).select(us("timestamp"), *sinks.ALERTS.fieldNames()[1:])


@query
def telemetry_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "telemetry")
    sinks.write_telemetry(telemetry.telemetry_global(_throughput(spark, sf_dir)), path)
    points = telemetry.in_range(sinks.read_telemetry(spark, path), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return points.select("measurement", us("ts"), *telemetry.GLOBAL_FIELDS)


@query
def telemetry_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select(
        "measurement", us("ts"), "src_ip", "is_attack", *rounded(telemetry.DETECTION_FIELDS)
    )


@query
def telemetry_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.to_long(_points(spark, sf_dir)).select(
        us("ts"), "src_ip", "is_attack", "field", F.round("value", 6).alias("value")
    )


@query
def telemetry_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = telemetry.from_long(telemetry.to_long(_points(spark, sf_dir)))
    return wide.select(us("ts"), "src_ip", "is_attack", *rounded(telemetry.DETECTION_FIELDS))


@query
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "report")
    sinks.write_report(metrics.classification_report(views.predictions(spark, sf_dir)), path)
    schema = "class STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support BIGINT"
    return spark.read.schema(schema).option("header", True).csv(path)


# --- packet and window expressions --------------------------------------------


@query
def classify_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.classify_protocol(views.packets(spark, sf_dir)).select(
        "src_ip", us("ts"), "proto_class", "is_syn", "is_ack"
    )


@query
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_vector(_day_counters(spark, sf_dir)).select(
        "src_ip", us("window_start"), *rounded(FEATURES)
    )


def _one_feature(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = _day_counters(spark, sf_dir)
        return counted.select("src_ip", us("window_start"), F.round(derived(name), 6).alias(name))

    return run


for _name in DERIVED:
    QUERIES[_name] = _one_feature(_name)


@query
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = features.feature_vector(_day_counters(spark, sf_dir))
    return scoring.score(vectors, scoring.rule_score(**RULE)).select("src_ip", us("window_start"), "score")


@query
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).select("src_ip", us("window_start"), "score", "is_attack")


@query
def decide_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocking = detect.decide_action(_detections(spark, sf_dir))
    return blocking.select(
        "src_ip",
        us("window_start"),
        F.coalesce("action", F.lit("-")).alias("action"),
        F.coalesce(detect.action_of(blocking=False), F.lit("-")).alias("without_blocking"),
    )


@query
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select(us("timestamp"), *text.ALERT_FIELDS[1:])


@query
def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select(us("timestamp"), "src_ip", text.alert_text().alias("line"))


@query
def webhook_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _alerts(spark, sf_dir).select("timestamp", "src_ip", text.webhook_payload().alias("body"))
    return body.select(
        us("timestamp"),
        "src_ip",
        F.get_json_object("body", "$.text").alias("text"),
        F.get_json_object("body", "$.alert.action").alias("action"),
        F.get_json_object("body", "$.alert.pkt_count").cast("double").alias("pkt_count"),
    )


@query
def int_to_ip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spread the users over the address space so that all four bytes vary.
    spread = views.packets(spark, sf_dir).selectExpr("ts", "(src_ip * 2654435761) % 4294967296 AS address")
    return spread.withColumn("text", int_to_ip("address")).select(
        us("ts"), "address", "text", ip_to_int("text").alias("back")
    )


@query
def ip_to_int_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = views.packets(spark, sf_dir).withColumn("text", int_to_ip("src_ip"))
    mixed = dotted.withColumn("text", F.expr("CASE proto WHEN 1 THEN text || '.9' WHEN 17 THEN '0' || text ELSE text END"))
    return mixed.select(us("ts"), "text", ip_to_int("text").alias("value"))


# --- flow expressions ---------------------------------------------------------

_SHORT = {
    "Total Fwd Packets": "fwd",
    "Total Backward Packets": "bwd",
    "Flow Duration": "duration",
    "Packet Length Mean": "len_mean",
}


def _brief(df: DataFrame) -> DataFrame:
    return df.select(
        "flow_id", *[F.round(F.col(f"`{c}`").cast("double"), 9).alias(a) for c, a in _SHORT.items()], "Label"
    )


@query
def clean_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(flows.clean_flows(views.broken_flows(spark, sf_dir)))


@query
def clean_flows_keep_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(flows.clean_flows(views.broken_flows(spark, sf_dir), dedup=False))


@query
def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.broken_flows(spark, sf_dir)
    return flows.cleaning_stats(raw, flows.clean_flows(raw))


@query
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flow_features(views.flows(spark, sf_dir)).select(
        "flow_id", *rounded(["SYN_ACK_Ratio", "Proto_Entropy"])
    )


@query
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_table(spark, sf_dir).select("flow_id", *rounded(FLOW_FEATURES, 9), "label")


@query
def class_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.class_of(views.flows(spark, sf_dir)).select("flow_id", "Label", "class")


@query
def concat_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = views.flows(spark, sf_dir)
    parts = [whole.where("Label = 'BENIGN'"), whole.where("Label <> 'BENIGN'")]
    return _brief(flows.concat_flows(*parts))


@query
def fit_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.fit_minmax(_flow_table(spark, sf_dir)).select(
        "feature", *rounded(["min", "max", "data_range"]), F.round("scale", 9).alias("scale")
    )


@query
def apply_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _flow_table(spark, sf_dir)
    train, test = split.stratified_split(table, "flow_id")
    scaled = flows.apply_minmax(test, flows.fit_minmax(train))
    return scaled.select("flow_id", *rounded(FLOW_FEATURES), "label")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split.stratified_split(_flow_table(spark, sf_dir), "flow_id")
    return _parts(train, test)


@query
def stratified_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split.stratified_split(_flow_table(spark, sf_dir), "flow_id", exact=True)
    return _parts(train, test)


def _parts(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("flow_id", "label", F.lit("train").alias("part")).unionByName(
        test.select("flow_id", "label", F.lit("test").alias("part"))
    )


@query
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten inputs: every row with its label, and whether it lies between the extremes of its class."""
    train, _ = split.stratified_split(_flow_table(spark, sf_dir), "flow_id")
    balanced = balance(train, "flow_id", written=True)
    bounds = train.groupBy("label").agg(
        *[f(f"`{c}`").alias(f"{n}_{i}") for i, c in enumerate(FLOW_FEATURES) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    between = " AND ".join(f"`{c}` BETWEEN lo_{i} AND hi_{i}" for i, c in enumerate(FLOW_FEATURES))
    # One row per class.
    return balanced.join(F.broadcast(bounds), "label").selectExpr("flow_id", "label", f"({between}) AS inside")


@query
def smote_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs with few distinct points: the neighbours of a row are its own copies."""
    train, _ = split.stratified_split(_flow_table(spark, sf_dir), "flow_id")
    return balance(train, "flow_id", ["SYN Flag Count", "ACK Flag Count"])


# --- joins --------------------------------------------------------------------


@query
def blacklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = bl.blacklist_filter(views.packets(spark, sf_dir), views.blacklist(spark, sf_dir))
    return passed.select("src_ip", us("ts"), "pkt_len")


@query
def blacklist_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = bl.blacklist_filter(views.packets(spark, sf_dir), views.blacklist(spark, sf_dir), "dropped")
    return dropped.select("src_ip", us("ts"), "pkt_len")


@query
def compare_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.predictions(spark, sf_dir)
    b = a.select("id", "prediction", F.round("score", 2).alias("score")).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int")
    )
    some = b.dropDuplicates(["id"]).where("id NOT LIKE '%7'")  # the other scorer lost rows
    return metrics.compare_predictions(a, some, "id").select(
        "rows", "missing", *rounded(["match_rate", "max_abs_diff"]), "passed"
    )


@query
def join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = views.predictions(spark, sf_dir)
    truth = made.select("id", "label").dropDuplicates().where("id NOT LIKE '%7'")
    judged = made.drop("label").where("id NOT LIKE '%3'")
    joined = metrics.join_truth(judged, truth, "id")
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("label", "prediction", "score")]
    return joined.select("id", *known, "matched")


@query
def detection_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).withColumn("src_ip", ip_to_int("src_ip"))
    attacks = views.packets(spark, sf_dir).where("tcp_syn")
    found = telemetry.detection_latency(alerts, attacks, "5 days", "10 days")
    return found.select(
        "src_ip", us("attack_at"), us("alert_at"), "latency_us", "status"
    )


@query
def detection_latency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    attacks = views.packets(spark, sf_dir).where("tcp_syn")
    found = telemetry.detection_latency(_alerts(spark, sf_dir), attacks, by=())
    return found.select(us("attack_at"), us("alert_at"), "latency_us", "status")


# --- aggregations -------------------------------------------------------------

_COUNTS = [
    "pkt_count",
    "byte_count",
    "syn_count",
    "ack_count",
    "udp_count",
    "icmp_count",
    "tcp_count",
    "other_proto",
    "pkt_size_sum_sq",
    "iat_sum_us",
]


@query
def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.source_counters(views.packets(spark, sf_dir), with_iat_sq=True).select(
        "src_ip", *_COUNTS, us("first_seen"), us("last_seen"), F.round(F.col("iat_sum_sq") / 1e18, 6).alias("iat_sq")
    )


@query
def windowed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_counters(spark, sf_dir).select(
        "src_ip", us("window_start"), us("window_end"), *_COUNTS, us("first_seen"), us("last_seen")
    )


@query
def windowed_counters_iat_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ct.windowed_counters(views.packets(spark, sf_dir), DAY, with_iat_sq=True)
    return counted.select(
        "src_ip", us("window_start"), "iat_sum_us", F.round(F.col("iat_sum_sq") / 1e18, 6).alias("iat_sq")
    )


@query
def windowed_counters_by_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ct.windowed_counters(views.packets(spark, sf_dir), DAY, by_cpu=True)
    return counted.select("src_ip", us("window_start"), *_COUNTS, us("first_seen"), us("last_seen"))


@query
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = ct.windowed_counters(views.packets(spark, sf_dir), "1 hour")
    return ct.roll_up(hourly, "5 days").select(
        "src_ip", us("window_start"), *_COUNTS, us("first_seen"), us("last_seen")
    )


@query
def global_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throughput(spark, sf_dir).select(
        us("window_start"),
        us("window_end"),
        *telemetry.GLOBAL_FIELDS,
        *[c.replace("total_", "cum_") for c in telemetry.GLOBAL_FIELDS],
    )


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.class_distribution(views.broken_flows(spark, sf_dir))


@query
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.describe_features(_flow_table(spark, sf_dir))


@query
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.correlation_matrix(_flow_table(spark, sf_dir)).select("a", "b", F.round("r", 6).alias("r"))


@query
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = flows.flow_features(views.flows(spark, sf_dir))
    return flows.box_stats(raw).select(
        "class", "feature", "count", *rounded(["q25", "q50", "q75", "whisker_low", "whisker_high"], 8), "outliers"
    )


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(views.predictions(spark, sf_dir))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_metrics(views.predictions(spark, sf_dir))


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(views.predictions(spark, sf_dir))


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    return metrics.latency_summary(lines, "l_quantity", 25.0).select(
        "count", *rounded(["mean", "std", "median", "p95", "p99", "max", "pct_under_target"])
    )


@query
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(views.table(spark, sf_dir, "events"), "value").select(
        "bin", *rounded(["low", "high"]), "count"
    )


# --- ordered analyses ---------------------------------------------------------


@query
def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.inter_arrival(views.packets(spark, sf_dir), DAY).select(
        "src_ip", us("window_start"), us("ts"), "packets", "iat_us"
    )


@query
def rate_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = telemetry.telemetry_global(_throughput(spark, sf_dir))
    return telemetry.rate(points, "total_pkts").select(us("ts"), F.round("rate", 9).alias("rate"))


@query
def rate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = telemetry.telemetry_global(_throughput(spark, sf_dir))
    return telemetry.rate(points, "total_bytes").select(us("ts"), F.round("rate", 9).alias("rate"))


@query
def rate_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-window counts rise and fall, so they act like a counter that restarts."""
    points = telemetry.window_throughput(views.packets(spark, sf_dir), "1 hour").select(
        F.col("window_end").alias("ts"), "total_pkts"
    )
    strict = telemetry.rate(points, "total_pkts", "1 hour")
    zero = telemetry.rate(points, "total_pkts", "1 hour", reset="zero").withColumnRenamed("rate", "from_zero")
    return strict.join(zero, "ts").select(us("ts"), *rounded(["rate", "from_zero"]))


@query
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = telemetry.telemetry_global(_throughput(spark, sf_dir))
    return telemetry.last_value_of(points, "total_dropped").select(us("ts"), "total_dropped", "band")


@query
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_curve(views.predictions(spark, sf_dir)).select(*rounded(["threshold", "fpr", "tpr"]))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(views.predictions(spark, sf_dir)).select(*rounded(["roc_auc"]))


@query
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(views.predictions(spark, sf_dir)).select(
        *rounded(["threshold", "precision", "recall"])
    )


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(views.predictions(spark, sf_dir)).select(*rounded(["average_precision"]))


@query
def score_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.score_timeline(_points(spark, sf_dir)).select("src_ip", us("ts"), "score", "band")


@query
def attack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.attack_log(_points(spark, sf_dir), 3).select(
        us("ts"), "src_ip", *rounded(telemetry.DETECTION_FIELDS)
    )


DASHBOARD = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")


def _stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time range of a dashboard, read from telemetry stored by date."""
    path = scratch_dir(spark, "telemetry-points")
    sinks.write_telemetry(_points(spark, sf_dir), path)
    return telemetry.in_range(sinks.read_telemetry(spark, path), *DASHBOARD)


@query
def dashboard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.score_timeline(_stored_points(spark, sf_dir)).select("src_ip", us("ts"), "score", "band")


@query
def dashboard_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.attack_log(_stored_points(spark, sf_dir), 3).select(
        us("ts"), "src_ip", *rounded(telemetry.DETECTION_FIELDS)
    )


@query
def dashboard_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "telemetry-global")
    sinks.write_telemetry(telemetry.telemetry_global(_throughput(spark, sf_dir)), path)
    points = telemetry.in_range(sinks.read_telemetry(spark, path), *DASHBOARD)
    return telemetry.rate(points, "total_pkts").select(us("ts"), *rounded(["rate"], 9))


@query
def attack_log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.attack_log(_points(spark, sf_dir), 50, scope="all").select(
        us("ts"), "src_ip", *rounded(telemetry.DETECTION_FIELDS)
    )


@query
def rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cut-offs on one score stand for four models."""
    rows = [
        metrics.binary_metrics(views.predictions(spark, sf_dir, cut)).select(
            F.lit(f"cut-{cut}").alias("model"), "f1", F.lit(cut).alias("inference_us")
        )
        for cut in (0.2, 0.4, 0.6, 0.8)
    ]
    report = reduce(lambda a, b: a.unionByName(b), rows)
    ranked = models.rank_models(report)
    # One row per model.
    place = F.row_number().over(Window.orderBy(F.desc("f1"), "inference_us", "model"))
    return ranked.withColumn("place", place)


@query
def rank_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each feature's correlation with the label."""
    table = _flow_table(spark, sf_dir)
    pairs = flows.correlations(table, [(f, "label") for f in FLOW_FEATURES])
    strength = pairs.select(F.col("a").alias("feature"), F.round(F.abs("r"), 6).alias("importance"))
    return models.rank_importance(strength)


# --- block loop and replay ----------------------------------------------------


@query
def block_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(
        "src_ip", us("window_start"), "is_attack", "state", F.coalesce(F.unix_micros("blocked_until"), F.lit(-1)).alias("blocked_until")
    )


@query
def block_sources_for_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = bl.block_sources(_detections(spark, sf_dir), 0, DAY)
    return verdicts.select("src_ip", us("window_start"), "state")


@query
def replay_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = materialize(_verdicts(spark, sf_dir), "verdicts")
    left = detection.replay(views.packets(spark, sf_dir), verdicts, DAY)
    return left["alerts"].select(us("timestamp"), *text.ALERT_FIELDS[1:])


@query
def replay_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = materialize(_verdicts(spark, sf_dir), "verdicts")
    left = detection.replay(views.packets(spark, sf_dir), verdicts, DAY)
    return left["throughput"].select(us("window_start"), *telemetry.GLOBAL_FIELDS)


# --- models -------------------------------------------------------------------


class Parts(NamedTuple):
    """Written rows, balanced and scaled."""

    train: DataFrame
    test: DataFrame


def _prepare(spark: SparkSession, sf_dir: str) -> Parts:
    ready = training.prepare(views.separable_flows(spark, sf_dir))
    parts = Parts(store(ready.train, "train"), store(ready.test, "test"))
    ready.release()
    return parts


_PREPARED: dict[tuple[str, str], Parts] = {}


def _ready(spark: SparkSession, sf_dir: str) -> Parts:
    """Written train and test parts, made once per session and folder, so that the time of a model
    query is that of its model; ``prepare_training`` always makes them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        _PREPARED[key] = _prepare(spark, sf_dir)
    return _PREPARED[key]


def _prediction_rows(ready: Parts, model) -> DataFrame:
    return models.predict(ready.test, model, ["flow_id", "label"])


@query
def prepare_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning, features, split, balancing and scaling, without a model."""
    ready = _prepare(spark, sf_dir)
    parts = ready.train.withColumn("part", F.lit("train")).unionByName(ready.test.withColumn("part", F.lit("test")))
    counts = materialize(parts.groupBy("part", "label").agg(F.count(F.lit(1)).alias("rows")), "part-sizes")
    release(*ready)
    return counts


@query
def train_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    return _prediction_rows(ready, models.train_tree(ready.train, maxDepth=5))


@query
def train_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree may use every input, so that each finds the column that decides."""
    ready = _ready(spark, sf_dir)
    params = {"maxDepth": 10, "numTrees": 50, "featureSubsetStrategy": "all"}
    return _prediction_rows(ready, models.train_forest(ready.train, **params))


@query
def train_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    return _prediction_rows(ready, models.train_boosted(ready.train, maxDepth=4, maxIter=10)).drop("score")


@query
def train_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    return _prediction_rows(ready, models.train_leafwise(ready.train, maxDepth=4, maxIter=10, numLeaves=15)).drop("score")


def _specs() -> list[models.ModelSpec]:
    """All kinds of models, with grids small enough for a query, and one that cannot learn."""
    tree, forest, boosted, leafwise = models.model_specs()
    return [
        models.ModelSpec("Constant", tree.estimator, {"maxDepth": [0]}),
        models.ModelSpec(tree.name, tree.estimator, {"maxDepth": [5, 10], "minInstancesPerNode": [1]}),
        models.ModelSpec(
            forest.name, forest.estimator, {"numTrees": [10], "maxDepth": [10], "featureSubsetStrategy": ["all"]}
        ),
        models.ModelSpec(boosted.name, boosted.estimator, {"maxIter": [3], "maxDepth": [4]}),
        models.ModelSpec(leafwise.name, leafwise.estimator, {"maxIter": [3], "maxDepth": [4], "numLeaves": [31]}),
    ]


@query
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole quick grid of the tree."""
    ready = _ready(spark, sf_dir)
    found = models.grid_search(ready.train, models.model_specs()[0].quick(), "flow_id")
    return _prediction_rows(ready, found.bestModel)


@query
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and sizes vary from run to run, so they are left out."""
    ready = _ready(spark, sf_dir)
    report = models.compare_models(_specs(), ready.train, ready.test, "flow_id", scratch_dir(spark, "models"))
    return report.select("model", "accuracy", "precision", "recall", "f1", "fpr", "best_params")


@query
def save_and_load_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, path = _ready(spark, sf_dir), scratch_dir(spark, "models")
    report = models.compare_models(_specs()[:2], ready.train, ready.test, "flow_id", path)
    models.save_best(report, path)
    model, name = models.load_model(spark, path)
    return _prediction_rows(ready, model).withColumn("model", F.lit(name))


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    return models.feature_importance(spark, models.train_tree(ready.train, maxDepth=5))


@query
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _ready(spark, sf_dir)
    model = models.train_tree(ready.train, maxDepth=5)
    found = models.permutation_importance(ready.test, model, "flow_id")
    return found.select("feature", *rounded(["importance"]))


@query
def evaluate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From labelled flows to the saved best model, and its report on unseen flows."""
    path = scratch_dir(spark, "run")
    whole = views.separable_flows(spark, sf_dir)
    name, _ = training.train_and_select(whole, path, _specs()[:2])
    model, _ = models.load_model(spark, f"{path}/models")
    found = training.evaluate(spark.read.parquet(f"{path}/unseen"), model)
    return found["classification_report"].withColumn("model", F.lit(name))


@query
def score_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that learns the rule's verdict from window features, then scores them."""
    labelled = materialize(
        _detections(spark, sf_dir).withColumn("label", F.col("is_attack").cast("int")), "labelled"
    )
    model = models.train_tree(labelled, FEATURES, maxDepth=5)
    windows = labelled.select("src_ip", "window_start", "window_end", *FEATURES)
    scored = scoring.threshold(scoring.score(windows, model), AT)
    return scored.select("src_ip", us("window_start"), "score", "is_attack")


# --- streaming ----------------------------------------------------------------


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    folder = scratch_dir(spark, name)
    run = live.write_stream(stream, f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), run


@query
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, run = _streamed(spark, live.stream_features(views.packet_stream(spark, sf_dir), DAY, "1 hour"), "features")
    rest = live.open_packets(run, views.packets(spark, sf_dir), DAY)
    whole = closed.unionByName(features.feature_vector(ct.windowed_counters(rest, DAY)))
    return whole.select("src_ip", us("window_start"), *rounded(FEATURES))


@query
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.stream_throughput(views.packet_stream(spark, sf_dir), "1 hour", "1 hour")
    closed, run = _streamed(spark, stream, "throughput")
    rest = live.open_packets(run, views.packets(spark, sf_dir), "1 hour")
    whole = closed.unionByName(telemetry.window_throughput(rest, "1 hour"))
    return whole.select(us("window_start"), *telemetry.GLOBAL_FIELDS)


def _arrivals(spark: SparkSession, packets: DataFrame, path: str) -> DataFrame:
    """A stream of the packets in three batches by ``late``, each of as many files as there are cores."""
    files = spark.sparkContext.defaultParallelism
    for late in range(3):
        packets.where(F.col("late") == late).drop("late").repartition(files).write.mode("append").parquet(path)
    schema = packets.drop("late").schema
    return packet_files.read_packets(spark, path, stream=True, schema=schema, maxFilesPerTrigger=str(files))


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrivals with late packets kept: per hour how many were on time and late, and the latest."""
    path = scratch_dir(spark, "late-rows")
    turn = "CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS late"
    packets = views.table(spark, sf_dir, "events").selectExpr(*views.PACKET_COLUMNS, turn)
    run = live.split_late(_arrivals(spark, packets, f"{path}/in"), f"{path}/out", f"{path}/checkpoint", "1 hour", "1 hour")
    run.awaitTermination()
    kept = spark.read.parquet(f"{path}/out/packets/batch=*")
    counted = kept.groupBy(F.window("ts", "1 hour")["start"].alias("window_start")).agg(
        F.count_if(~F.col("late")).alias("on_time"),
        F.count_if("late").alias("late"),
        F.coalesce(F.max("lateness_us"), F.lit(0).cast("long")).alias("latest_us"),
    )
    return counted.select(us("window_start"), "on_time", "late", "latest_us")


@query
def stream_gap_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared gaps between packets on a stream; open windows are closed from the same packets."""
    stream = live.stream_counters(views.packet_stream(spark, sf_dir), DAY, "1 hour", with_iat_sq=True)
    closed, run = _streamed(spark, stream, "gap-squares")
    rest = live.open_packets(run, views.packets(spark, sf_dir), DAY)
    whole = closed.unionByName(ct.windowed_counters(rest, DAY, with_iat_sq=True).select(closed.columns))
    return whole.select(
        "src_ip", us("window_start"), "iat_sum_us", F.round(F.col("iat_sum_sq") / 1e18, 6).alias("iat_sq")
    )


@query
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the packets arrive last: only those of windows that were open then count.

    Lateness is judged by the watermark of the batch before, hence three batches.
    """
    path = scratch_dir(spark, "late-packets")
    turn = "CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS late"
    packets = views.table(spark, sf_dir, "events").selectExpr(*views.PACKET_COLUMNS, turn)
    arriving = _arrivals(spark, packets, path)
    stream = live.stream_throughput(arriving, "1 hour", "1 hour")
    closed, run = _streamed(spark, stream, "late")
    rest = live.open_packets(run, packet_files.read_packets(spark, path, schema=arriving.schema), "1 hour")
    whole = closed.unionByName(telemetry.window_throughput(rest, "1 hour"))
    return whole.select(us("window_start"), *telemetry.GLOBAL_FIELDS)


def _block_stream(spark: SparkSession, sf_dir: str) -> str:
    folder, scorer = scratch_dir(spark, "blocks"), scoring.rule_score(**RULE)
    log = live.VerdictLog(folder, DAY, TTL)
    run = live.stream_block(
        views.packet_stream(spark, sf_dir),
        folder,
        f"{folder}/checkpoint",
        scorer,
        DAY,
        AT,
        TTL,
        "1 hour",
        on_batch=log,
    )
    run.awaitTermination()
    log.finish(run, views.packets(spark, sf_dir), scorer, AT)
    return folder


@query
def stream_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = live.read_stream_output(spark, _block_stream(spark, sf_dir), "verdicts")
    return verdicts.select(
        "src_ip", us("window_start"), "state", F.coalesce(F.unix_micros("blocked_until"), F.lit(-1)).alias("blocked_until")
    )


@query
def stream_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that the blocks of a live stream keep out, per source and window."""
    dropped = live.read_stream_output(spark, _block_stream(spark, sf_dir), "dropped")
    return dropped.select("src_ip", us("window_start"), "packets", "bytes")


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _block_stream(spark, sf_dir)
    return sinks.read_alerts(spark, f"{folder}/alerts/batch=*").select(us("timestamp"), *text.ALERT_FIELDS[1:])


@query
def stream_global_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passed and what was dropped by blocks, with running totals."""
    found = live.read_throughput(spark, _block_stream(spark, sf_dir))
    return found.select(us("window_start"), *telemetry.GLOBAL_FIELDS, "cum_pkts", "cum_bytes", "cum_dropped")


# --- sketches and key statistics ----------------------------------------------


@query
def count_min_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.count_min_sketch(views.packets(spark, sf_dir), "src_ip", d=4, w=64)


@query
def cms_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sketch_accuracy(views.packets(spark, sf_dir), "src_ip", d=4, w=64)


@query
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.heavy_hitters(views.packets(spark, sf_dir), 20, weight="pkt_len")


@query
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sketch.distinct_sources(views.packets(spark, sf_dir), DAY, exact=True)
    return counted.select(us("window_start"), "sources")


@query
def distinct_sources_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch is within three of its standard errors of the exact number."""
    packets, error = views.packets(spark, sf_dir), 0.02
    exact = sketch.distinct_sources(packets, DAY, exact=True).withColumnRenamed("sources", "exact")
    both = sketch.distinct_sources(packets, DAY, rsd=error).join(exact, ["window_start", "window_end"])
    close = F.abs(F.col("sources") - F.col("exact")) <= 3 * error * F.col("exact")
    return both.select(us("window_start"), close.alias("close"))


@query
def distinct_sources_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hourly sketches merged into days: within three of their standard errors of the exact number."""
    packets = views.packets(spark, sf_dir)
    stored = materialize(sketch.key_sketches(packets, "1 hour"), "sketches")
    merged = sketch.sketch_counts(sketch.roll_up_sketches(stored, DAY)).withColumnRenamed("sources", "merged")
    both = sketch.distinct_sources(packets, DAY, exact=True).join(merged, ["window_start", "window_end"])
    error = 1.04 / 2**7  # one over the root of 2^14 buckets
    close = F.abs(F.col("merged") - F.col("sources")) <= 3 * error * F.col("sources")
    return both.select(us("window_start"), close.alias("close"))


@query
def key_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.key_entropy(views.packets(spark, sf_dir), DAY)
    return found.select(us("window_start"), "keys", F.round("entropy", 6).alias("entropy"))


@query
def rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = sketch.rate_threshold(_day_counters(spark, sf_dir), 2 / 86400)
    return flagged.select("src_ip", us("window_start"), F.round("syn_rate", 9).alias("syn_rate"), "is_attack")
