"""Blacklists and the block loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from floodlens.operators.blacklist import blacklist_filter, block_sources, blocks_of, mark_blacklisted
from floodlens.schemas import BLACKLIST, PERMANENT_US

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_block_is_half_open(spark):
    packets = spark.createDataFrame(
        [(1, at(t), 60) for t in (9, 10, 69, 70, 5000)] + [(2, at(t), 60) for t in (9, 10, 99999)] + [(3, at(10), 60)],
        "src_ip BIGINT, ts TIMESTAMP, pkt_len BIGINT",
    )
    entries = spark.createDataFrame([(1, at(10), 60_000_000), (2, at(10), 0)], BLACKLIST)
    kept = {(r["src_ip"], r["ts"].replace(tzinfo=timezone.utc)) for r in blacklist_filter(packets, entries).collect()}
    assert len(kept) == 5
    dropped = blacklist_filter(packets, entries, keep="dropped")
    got = sorted((r["src_ip"], r["s"]) for r in dropped.selectExpr("src_ip", "unix_micros(ts) AS s").collect())
    base = int(START.timestamp() * 1e6)
    assert [(s, (t - base) / 1e6) for s, t in got] == [(1, 10), (1, 69), (2, 10), (2, 99999)]


def test_overlapping_entries_drop_a_packet_once(spark):
    rng = random.Random(5)
    entries = [(rng.randrange(3), at(rng.randrange(20000)), rng.choice([1, 30, 4000, 9000]) * 1_000_000) for _ in range(60)]
    times = [(rng.randrange(4), at(rng.randrange(30000))) for _ in range(400)]
    packets = spark.createDataFrame([(s, t, 60) for s, t in times], "src_ip BIGINT, ts TIMESTAMP, pkt_len BIGINT")
    marked = mark_blacklisted(packets, spark.createDataFrame(entries, BLACKLIST), bucket="10 minutes")
    want = sum(
        any(s == e[0] and e[1] <= t < e[1] + timedelta(microseconds=e[2]) for e in entries) for s, t in times
    )
    assert marked.count() == len(times)
    assert marked.where("dropped").count() == want


def test_big_blacklist_is_not_broadcast(spark, monkeypatch):
    import floodlens.operators.blacklist as module
    from floodlens.session import broadcast_if_small

    monkeypatch.setattr(module, "broadcast_if_small", lambda df: broadcast_if_small(df, 1))
    packets = spark.createDataFrame([(i % 5, at(i), 60) for i in range(100)], "src_ip BIGINT, ts TIMESTAMP, pkt_len BIGINT")
    entries = spark.createDataFrame([(i, at(0), 50_000_000) for i in range(4)], BLACKLIST)
    assert blacklist_filter(packets, entries, "dropped").count() == 40


def test_buckets_of_a_small_file_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark guesses sizes from files, and knows nothing of the buckets that long blocks are cut into."""
    import floodlens.operators.blacklist as module
    from floodlens.session import broadcast_if_small

    monkeypatch.setattr(module, "broadcast_if_small", lambda df: broadcast_if_small(df, 100))
    hours = 400 * 3600
    spark.createDataFrame([(s, at(s), hours * 1_000_000) for s in range(20)], BLACKLIST).write.parquet(f"{tmp_path}/b")
    packets = spark.createDataFrame(
        [(s % 30, at(3600 * s), 60) for s in range(500)], "src_ip BIGINT, ts TIMESTAMP, pkt_len BIGINT"
    )
    marked = mark_blacklisted(packets, spark.read.parquet(f"{tmp_path}/b"))
    plan = marked._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_bucket" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    want = sum(s % 30 < 20 and s % 30 <= 3600 * s < s % 30 + hours for s in range(500))
    assert marked.where("dropped").count() == want


def windows(spark, rows):
    return spark.createDataFrame(rows, "src_ip BIGINT, n BIGINT, is_attack BOOLEAN").selectExpr(
        "src_ip",
        f"timestamp_micros({int(START.timestamp() * 1e6)} + n * 1000000) AS window_start",
        f"timestamp_micros({int(START.timestamp() * 1e6)} + (n + 1) * 1000000) AS window_end",
        "is_attack",
        "n",
    )


def walk(rows, ttl):
    out, until = {}, {}
    for src, n, attack in sorted(rows):
        if n < until.get(src, -1):
            out[(src, n)] = "DROPPED"
        elif attack:
            out[(src, n)] = "BLOCK"
            until[src] = n + 1 + ttl if ttl else 10**9
        else:
            out[(src, n)] = "PASS"
    return out


@pytest.mark.parametrize("ttl", [0, 3, 20])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_block_loop_matches_a_plain_walk(spark, ttl, batch):
    rng = random.Random(ttl * 31 + batch)
    rows = [
        (src, n, rng.random() < p)
        for src, p in ((1, 0.9), (2, 0.1), (3, 0.0), (4, 0.4), (5, 0.02))
        for n in range(120)
        if rng.random() < 0.7
    ]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        verdicts = block_sources(windows(spark, rows), f"{ttl} seconds" if ttl else 0, "1 second")
        got = {(r["src_ip"], r["n"]): r["state"] for r in verdicts.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == walk(rows, ttl)


def test_carried_blocks_and_entries(spark):
    rows = [(1, 0, True), (1, 4, True), (2, 0, False)]
    carry = spark.createDataFrame([(1, at(3)), (2, at(1))], "src_ip BIGINT, blocked_until TIMESTAMP")
    verdicts = block_sources(windows(spark, rows), "5 seconds", "1 second", carry=carry)
    got = {(r["src_ip"], r["n"]): r["state"] for r in verdicts.collect()}
    assert got == {(1, 0): "DROPPED", (1, 4): "BLOCK", (2, 0): "DROPPED"}
    entry = blocks_of(verdicts).selectExpr("src_ip", "unix_micros(blocked_at) AS b", "ttl_us").collect()
    assert [(r["src_ip"], r["b"] - int(START.timestamp() * 1e6), r["ttl_us"]) for r in entry] == [(1, 5_000_000, 5_000_000)]
    forever = blocks_of(block_sources(windows(spark, rows), 0, "1 second")).collect()
    assert [r["ttl_us"] for r in forever] == [0]


def test_alert_only_mode_and_checks(spark):
    rows = [(1, 0, True), (1, 1, True), (1, 2, False)]
    got = block_sources(windows(spark, rows), "5 seconds", "1 second", blocking=False)
    assert [r["state"] for r in got.orderBy("n").collect()] == ["ALERT", "ALERT", "PASS"]
    with pytest.raises(ValueError, match="multiple"):
        block_sources(windows(spark, rows), "1500 milliseconds", "1 second")


def test_permanent_block_is_marked(spark):
    got = block_sources(windows(spark, [(1, 0, True)]), 0, "1 second").select(F.unix_micros("blocked_until")).first()[0]
    assert got == PERMANENT_US
