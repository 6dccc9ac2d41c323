"""Packet, frame, flow and prediction views over the benchmark tables.

The tables hold no network traffic; these projections give every operator whole
tables of the right shape. All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.session import use_utc

PACKET_COLUMNS = [
    "167772160 + user_id AS src_ip",
    "CAST(ts AS TIMESTAMP) AS ts",
    "CAST(event_id % 4 AS INT) AS cpu",
    "CAST(CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'signup' THEN 17"
    " WHEN 'error' THEN 1 ELSE 47 END AS INT) AS proto",
    "event_type = 'click' AS tcp_syn",
    "event_type = 'view' AS tcp_ack",
    "least(1500, 40 + CAST(floor(value * 3) AS BIGINT)) AS pkt_len",
]

FLOW_COLUMNS = [
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id",
    "CAST(l_quantity AS BIGINT) AS `Total Fwd Packets`",
    "CAST(l_linenumber - 1 AS BIGINT) AS `Total Backward Packets`",
    "l_extendedprice AS `Total Length of Fwd Packets`",
    "CAST(l_linenumber AS BIGINT) AS `SYN Flag Count`",
    "CAST(round(l_discount * 100) AS BIGINT) % 4 AS `ACK Flag Count`",
    "l_extendedprice / l_quantity AS `Packet Length Mean`",
    "l_tax * 10000 + CAST(0.0 AS DOUBLE) AS `Packet Length Variance`",
    "CAST(l_suppkey AS DOUBLE) * 1000 AS `Flow Duration`",
    "CAST(l_partkey % 1000 AS DOUBLE) * 10 AS `Flow IAT Mean`",
    "CASE WHEN l_returnflag = 'R' THEN 'DDoS' ELSE 'BENIGN' END AS Label",
]

# Missing and infinite values for the cleaning operators.
BROKEN_DURATION = (
    "CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 89 = 0 THEN NULL"
    " ELSE CAST(l_suppkey AS DOUBLE) * 1000 END AS `Flow Duration`"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*PACKET_COLUMNS)


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as a stream over the table's file."""
    use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.selectExpr(*PACKET_COLUMNS)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*FLOW_COLUMNS)


def broken_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with infinite and missing durations and with repeated rows."""
    columns = [BROKEN_DURATION if "`Flow Duration`" in c else c for c in FLOW_COLUMNS]
    lines = table(spark, sf_dir, "lineitem")
    once = lines.selectExpr(*columns)
    again = lines.where("l_partkey % 50 = 0").selectExpr(*columns)
    return once.unionByName(again)


def separable_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken flows with a label that one few-valued column decides.

    A tree that learns it has pure leaves, whatever it makes of the other nine inputs, so
    predictions, reports and importances have a definite value to be compared with.
    """
    attack = F.expr("CASE WHEN `SYN Flag Count` > 3 THEN 'DDoS' ELSE 'BENIGN' END")
    return broken_flows(spark, sf_dir).withColumn("Label", attack)


def predictions(spark: SparkSession, sf_dir: str, at: float = 0.5) -> DataFrame:
    """(id, label, score, prediction) with many tied scores."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
        "CAST(l_returnflag = 'R' AS INT) AS label",
        "CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / 1000 AS score",
        f"CAST(CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / 1000 > CAST({at} AS DOUBLE) AS INT)"
        " AS prediction",
    )


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A six-hour block per signup; one without end where the value is 70 or more."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr(
        "167772160 + user_id AS src_ip",
        "CAST(ts AS TIMESTAMP) AS blocked_at",
        "CAST(CASE WHEN value >= 70 THEN 0 ELSE 21600000000 END AS BIGINT) AS ttl_us",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethernet frames (event_id, ts, frame) built from events.

    The event number decides the shape: some are IPv6, some are cut short, and some
    have IP options. Everything is padded to the packet length where that is longer.
    """
    events = table(spark, sf_dir, "events")
    source = F.lpad(F.hex(F.lit(167772160) + F.col("user_id")), 8, "0")
    ether_type = F.when(F.col("event_id") % 11 == 3, "86DD").otherwise("0800")
    options = F.col("event_id") % 5 == 2
    number = (
        F.when(F.col("event_type").isin("click", "view"), 6)
        .when(F.col("event_type") == "signup", 17)
        .when(F.col("event_type") == "error", 1)
        .otherwise(47)
    )
    ip = F.concat(
        F.when(options, "46").otherwise("45"),
        F.lit("00002800000000FF"),
        F.lpad(F.hex(number.cast("long")), 2, "0"),
        F.lit("0000"),
        source,
        F.lit("0A0000FE"),
        F.when(options, "01010101").otherwise(""),
    )
    flags = F.when(F.col("event_type") == "click", "02").when(F.col("event_type") == "view", "12").otherwise("00")
    transport = F.concat(F.lit("30390050000000010000000050"), flags, F.lit("200000000000"))
    header = F.concat(F.lit("02000000000102000000000A"), ether_type, ip, transport)
    padded = F.rpad(header, (2 * F.expr("least(1500, 40 + CAST(floor(value * 3) AS INT))")).cast("int"), "0")
    full = F.when(F.length(padded) > F.length(header), padded).otherwise(header)
    cut = F.when(F.col("event_id") % 13 == 5, F.substring(full, 1, 26)).when(
        F.col("event_id") % 13 == 7, F.substring(full, 1, 84)
    )
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unhex(F.coalesce(cut, full)).alias("frame"))
