"""Sketches against exact answers."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from floodlens.operators import sketch as sk

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def keys(spark, n=3000):
    # One key has a third of all rows.
    return spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 211 END AS src_ip", "id % 5 + 1 AS w")


@pytest.mark.parametrize("w", [8, 64, 4096])
def test_sketch_never_underestimates(spark, w):
    got = sk.sketch_accuracy(keys(spark), "src_ip", d=3, w=w)
    assert got.where("estimate < exact").count() == 0
    if w == 4096:
        assert got.where("estimate > exact").count() == 0


def test_sketch_size_is_bounded(spark):
    built = sk.count_min_sketch(keys(spark), "src_ip", "w", d=4, w=16)
    assert built.count() <= 64
    assert built.groupBy("row").sum("count").select("sum(count)").distinct().count() == 1


def test_unknown_key_is_zero_or_more(spark):
    built = sk.count_min_sketch(keys(spark), "src_ip", d=2, w=4096)
    unknown = spark.createDataFrame([(10_000_000,)], "src_ip BIGINT")
    assert sk.cms_estimate(unknown, built, "src_ip", d=2, w=4096).first()["estimate"] == 0


def test_heavy_hitters(spark):
    got = sk.heavy_hitters(keys(spark), 2).collect()
    assert got[0]["src_ip"] == 7 and got[0]["total"] > 1000
    assert sk.heavy_hitters(keys(spark), 1, weight="w").first()["src_ip"] == 7


def test_entropy_and_distinct(spark):
    rows = [(s, START + timedelta(seconds=t)) for s, t in [(1, 0), (2, 1), (3, 2), (4, 3), (1, 60), (1, 61), (2, 62)]]
    df = spark.createDataFrame(rows, "src_ip BIGINT, ts TIMESTAMP")
    got = sk.key_entropy(df, "1 minute").orderBy("window_start").collect()
    p = np.array([2 / 3, 1 / 3])
    assert [r["entropy"] for r in got] == pytest.approx([2.0, -(p * np.log2(p)).sum()])
    for exact in (True, False):
        assert [r["sources"] for r in sk.distinct_sources(df, "1 minute", exact).orderBy("window_start").collect()] == [4, 2]


def test_rate_threshold(spark):
    df = spark.createDataFrame([(1, 2000, START, START + timedelta(seconds=2)), (2, 2001, START, START + timedelta(seconds=2))],
                               "src_ip BIGINT, syn_count BIGINT, window_start TIMESTAMP, window_end TIMESTAMP")
    assert {r["src_ip"]: r["is_attack"] for r in sk.rate_threshold(df).collect()} == {1: False, 2: True}


def test_stored_sketches_merge_into_longer_windows(spark):
    rows = [(src, START + timedelta(hours=h)) for h in range(48) for src in range(h * 10, h * 10 + 300)]
    packets = spark.createDataFrame(rows, "src_ip BIGINT, ts TIMESTAMP")
    hours = sk.key_sketches(packets, "1 hour")
    days = sk.sketch_counts(sk.roll_up_sketches(hours, "1 day")).orderBy("window_start").collect()
    assert len(days) == 2
    for row in days:
        assert abs(row["sources"] - 530) <= 3 * 1.04 / 2**7 * 530
