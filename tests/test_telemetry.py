"""Telemetry queries on literal series."""

from datetime import datetime, timedelta, timezone

import pytest

from floodlens.operators import telemetry as tm
from floodlens.sources import sinks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def series(spark, points):
    rows = [(START + timedelta(hours=h), v) for h, v in points]
    return spark.createDataFrame(rows, "ts TIMESTAMP, total_dropped BIGINT")


def test_rate_handles_resets_and_slices(spark):
    # The points lie on three days, one of them a gap.
    points = series(spark, [(0, 0), (1, 3600), (30, 3600 + 29 * 7200), (80, 50), (81, 3650)])
    null = tm.rate(points, "total_dropped").orderBy("ts").collect()
    assert [r["rate"] for r in null] == pytest.approx([1.0, 2.0, None, 1.0])
    zero = tm.rate(points, "total_dropped", reset="zero").orderBy("ts").collect()
    assert zero[2]["rate"] == pytest.approx(50 / (50 * 3600))
    with pytest.raises(ValueError):
        tm.rate(points, "total_dropped", reset="guess")


@pytest.mark.parametrize("value,band", [(0, "green"), (99, "green"), (100, "yellow"), (999, "yellow"), (1000, "red")])
def test_last_value_band(spark, value, band):
    got = tm.last_value_of(series(spark, [(2, value), (1, 5000)]), "total_dropped").first()
    assert (got["total_dropped"], got["band"]) == (value, band)


def test_running_totals_over_days(spark):
    rows = [(START + timedelta(hours=7 * i), START + timedelta(hours=7 * i + 1), i, 10 * i, 1) for i in range(40)]
    df = spark.createDataFrame(
        rows, "window_start TIMESTAMP, window_end TIMESTAMP, total_pkts BIGINT, total_bytes BIGINT, total_dropped BIGINT"
    )
    got = tm.accumulate_throughput(df).orderBy("window_start").collect()
    assert [r["cum_pkts"] for r in got] == [i * (i + 1) // 2 for i in range(40)]
    assert [r["cum_dropped"] for r in got] == list(range(1, 41))


def alerts_and_attacks(spark, alerts, attacks):
    a = spark.createDataFrame([(s, START + timedelta(seconds=t)) for s, t in alerts], "src_ip BIGINT, timestamp TIMESTAMP")
    p = spark.createDataFrame([(s, START + timedelta(seconds=t)) for s, t in attacks], "src_ip BIGINT, ts TIMESTAMP")
    return a, p


def test_detection_latency(spark):
    a, p = alerts_and_attacks(spark, [(1, 5), (1, 11), (2, 13), (4, 90)], [(1, 10), (1, 12), (2, 10), (3, 10), (4, 10)])
    got = {r["src_ip"]: (r["latency_us"], r["status"]) for r in tm.detection_latency(a, p, timeout="1 minute").collect()}
    assert got == {
        1: (1_000_000, "PASS"),
        2: (3_000_000, "FAIL"),
        3: (None, "TIMEOUT"),
        4: (80_000_000, "TIMEOUT"),
    }
    overall = tm.detection_latency(a, p, by=()).collect()
    assert [(r["latency_us"], r["status"]) for r in overall] == [(1_000_000, "PASS")]


def points(spark):
    rows = [
        ("detection", START + timedelta(hours=h), src, str(attack).lower(), *[float(h + i) for i in range(8)])
        for h, src, attack in [(0, "a", True), (1, "a", True), (2, "a", True), (3, "b", True), (30, "b", False)]
    ]
    names = ["measurement STRING", "ts TIMESTAMP", "src_ip STRING", "is_attack STRING"]
    return spark.createDataFrame(rows, ", ".join(names + [f"{f} DOUBLE" for f in tm.DETECTION_FIELDS]))


def test_attack_log_limits(spark):
    per_source = tm.attack_log(points(spark), 2).collect()
    assert sorted((r["src_ip"], r["ts"].hour) for r in per_source) == [("a", 1), ("a", 2), ("b", 3)]
    assert [r["src_ip"] for r in tm.attack_log(points(spark), 2, scope="all").collect()] == ["b", "a"]


def test_attack_log_is_cut_before_the_shuffle(spark):
    plan = tm.attack_log(points(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_form_round_trip(spark):
    wide = points(spark)
    back = tm.from_long(tm.to_long(wide)).select(*wide.columns)
    assert back.exceptAll(wide).count() == 0 and wide.exceptAll(back).count() == 0


def test_telemetry_is_pruned_by_date(spark, tmp_path):
    sinks.write_telemetry(points(spark), str(tmp_path / "t"))
    read = tm.in_range(sinks.read_telemetry(spark, str(tmp_path / "t")), "2024-01-02 00:00:00")
    assert read.count() == 1
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan


def test_alert_lines_round_trip(spark, tmp_path):
    rows = [(START, "10.0.0.1", 0.95, 10.0, 600.0, 9.0, "BLOCK")]
    sinks.write_alerts(spark.createDataFrame(rows, sinks.ALERTS), str(tmp_path / "a"))
    sinks.write_alerts(spark.createDataFrame(rows, sinks.ALERTS), str(tmp_path / "a"))
    assert sinks.read_alerts(spark, str(tmp_path / "a")).where("action = 'BLOCK'").count() == 2
