"""Packets to detections, verdicts, alerts and telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame

from floodlens.operators.blacklist import block_sources, blocks_of, mark_blacklisted
from floodlens.operators.counters import windowed_counters
from floodlens.operators.detect import alerts_of_verdicts
from floodlens.operators.features import feature_vector
from floodlens.operators.scoring import rule_score, score, threshold
from floodlens.operators.telemetry import global_throughput
from floodlens.schemas import DEFAULT_THRESHOLD, DEFAULT_TTL, DEFAULT_WINDOW

Scorer = PipelineModel | Column | Callable[..., Column]


def detections_of(
    counters: DataFrame, scorer: Scorer | None = None, at: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Window counters to scored and thresholded feature rows."""
    chosen = rule_score() if scorer is None else scorer
    return threshold(score(feature_vector(counters), chosen), at)


def detect(
    packets: DataFrame,
    scorer: Scorer | None = None,
    window: str = DEFAULT_WINDOW,
    at: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    return detections_of(windowed_counters(packets, window), scorer, at)


def judge(
    packets: DataFrame,
    scorer: Scorer | None = None,
    window: str = DEFAULT_WINDOW,
    at: float = DEFAULT_THRESHOLD,
    ttl: str | int = DEFAULT_TTL,
    blocking: bool = True,
) -> DataFrame:
    """Detections with the block loop applied: state and blocked_until per window."""
    return block_sources(detect(packets, scorer, window, at), ttl, window, blocking)


def replay(packets: DataFrame, verdicts: DataFrame, window: str = DEFAULT_WINDOW) -> dict[str, DataFrame]:
    """What a live run would have left behind: alerts, blacklist, throughput.

    ``verdicts`` should be a written table, since three results read it.
    """
    blacklist = blocks_of(verdicts)
    marked = mark_blacklisted(packets, blacklist)
    return {
        "alerts": alerts_of_verdicts(verdicts),
        "blacklist": blacklist,
        "throughput": global_throughput(marked, window),
    }
