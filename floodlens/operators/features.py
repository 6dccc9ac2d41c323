"""Counters to the ten model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from floodlens.functions.traffic import DERIVED
from floodlens.schemas import FEATURES, require

_NEEDED = ["pkt_count", "byte_count", "syn_count", "ack_count", "pkt_size_sum_sq", "iat_sum_us"]


def feature_vector(counters: DataFrame) -> DataFrame:
    """Identity columns plus ten DOUBLE features; all zero without packets."""
    require(counters, _NEEDED)
    identity = [c for c in ("src_ip", "window_start", "window_end") if c in counters.columns]
    values = {f: DERIVED.get(f, f"double({f})") for f in FEATURES}
    return counters.selectExpr(
        *identity, *[f"CASE WHEN pkt_count > 0 THEN {v} ELSE 0D END AS {f}" for f, v in values.items()]
    )
