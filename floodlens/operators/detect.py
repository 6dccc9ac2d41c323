"""From detections to actions and alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.network import int_to_ip
from floodlens.schemas import BENIGN, LABEL


def action_of(blocking: bool = True) -> Column:
    """'BLOCK' or 'ALERT' for attacks, NULL otherwise."""
    return F.when(F.col("is_attack"), F.lit("BLOCK" if blocking else "ALERT"))


def decide_action(detections: DataFrame, blocking: bool = True) -> DataFrame:
    return detections.withColumn("action", action_of(blocking))


def alert_rows(decided: DataFrame, at: str = "window_end") -> DataFrame:
    """One alert per row that has an action, stamped with the end of its window."""
    return decided.where(F.col("action").isNotNull()).select(
        F.col(at).alias("timestamp"),
        int_to_ip("src_ip").alias("src_ip"),
        "score",
        "pkt_count",
        "byte_count",
        "syn_count",
        "action",
    )


def alerts_of_verdicts(verdicts: DataFrame) -> DataFrame:
    """Alert rows after the block loop: dropped windows were never scored."""
    fired = F.when(F.col("state").isin("ALERT", "BLOCK"), F.col("state"))
    return alert_rows(verdicts.withColumn("action", fired))


def class_of(flows: DataFrame) -> DataFrame:
    """Two-valued class next to the label text."""
    return flows.withColumn("class", F.when(F.col(LABEL) == BENIGN, "Benign").otherwise("Attack"))
