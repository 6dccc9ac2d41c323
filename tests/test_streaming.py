"""Streams give what batches give."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from floodlens.operators import scoring
from floodlens.operators.blacklist import blocks_of, mark_blacklisted
from floodlens.plans.detection import judge
from floodlens.sources.packets import read_packets
from floodlens.sources.sinks import read_alerts
from floodlens.streaming import detection as live
from floodlens.operators.counters import windowed_counters
from floodlens.operators.features import feature_vector

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "src_ip BIGINT, ts TIMESTAMP, proto INT, tcp_syn BOOLEAN, tcp_ack BOOLEAN, pkt_len BIGINT"


def rule():
    return scoring.rule_score(ratio=2.0, packets=3.0, duration=60.0)


def second(src, sec, n, ack=False):
    return [(src, START + timedelta(seconds=sec, milliseconds=10 * i), 6, True, ack, 60) for i in range(n)]


def minute():
    """Source 1 floods without pause, source 2 twice, source 3 never."""
    rows = []
    for sec in range(60):
        rows += second(1, sec, 5) + second(3, sec, 2, ack=True)
        if sec in (7, 40):
            rows += second(2, sec, 9)
    return rows


def write_in_order(spark, rows, folder, pieces):
    rows = sorted(rows, key=lambda r: r[1])
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        part = rows[i * step : (i + 1) * step]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_block_stream_equals_batch_over_many_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    write_in_order(spark, minute(), source, 6)
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    live.stream_block(
        stream, out, str(tmp_path / "cp"), rule(), "1 second", 0.5, "10 seconds", "1 second"
    ).awaitTermination()
    got = live.read_stream_output(spark, out, "verdicts").select("src_ip", "window_start", "state", "blocked_until")
    closed = START + timedelta(seconds=58)
    want = judge(read_packets(spark, source), rule(), "1 second", 0.5, "10 seconds")
    want = want.where(want.window_end <= closed).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    states = {(r["src_ip"], r["state"]): r["count"] for r in got.groupBy("src_ip", "state").count().collect()}
    assert states == {(1, "BLOCK"): 6, (1, "DROPPED"): 52, (2, "BLOCK"): 2, (3, "PASS"): 58}
    assert read_alerts(spark, f"{out}/alerts/batch=*").count() == 8
    points = live.read_stream_output(spark, out, "telemetry")
    assert points.count() == got.where("state <> 'DROPPED'").count()


def states_of(spark, out):
    found = live.read_stream_output(spark, out, "verdicts").select("src_ip", "window_start", "state", "blocked_until")
    return sorted(tuple(r) for r in found.collect())


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that fails after its verdicts are written is run again from the checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write_in_order(spark, minute(), source, 5)
    scorer = rule()

    class Failing(live.VerdictLog):
        def __call__(self, verdicts, batch_id):
            super().__call__(verdicts, batch_id)
            if batch_id == 3:
                raise RuntimeError("lost")

    def start(log):
        stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
        return live.stream_block(stream, out, checkpoint, scorer, "1 second", 0.5, "10 seconds", "1 second", on_batch=log)

    failed = start(Failing(out, "1 second", "10 seconds"))
    with pytest.raises(Exception, match="lost"):
        failed.awaitTermination()
    before = states_of(spark, out)
    log = live.VerdictLog(out, "1 second", "10 seconds")
    run = start(log)
    run.awaitTermination()
    log.finish(run, read_packets(spark, source), scorer, 0.5)
    want = judge(read_packets(spark, source), scorer, "1 second", 0.5, "10 seconds")
    assert set(before) < set(states_of(spark, out))
    assert states_of(spark, out) == sorted(tuple(r) for r in want.select("src_ip", "window_start", "state", "blocked_until").collect())
    with pytest.raises(RuntimeError, match="another run"):
        live.stream_block(read_packets(spark, source, stream=True), out, str(tmp_path / "new"), scorer)


def held_state(spark, checkpoint):
    found = spark.read.format("statestore").option("stateVarName", "until").load(checkpoint)
    return {r[0]: r[1] for r in found.selectExpr("user_map_key.src_ip", "user_map_value.until").collect()}


def test_state_holds_open_blocks_only(spark, tmp_path):
    """Ended blocks leave the store; blocks for good are written once."""
    source = str(tmp_path / "in")
    write_in_order(spark, [r for r in minute() if r[0] != 1], source, 3)
    for ttl, left in (("10 seconds", 0), (0, 1)):
        checkpoint = str(tmp_path / f"cp{left}")
        stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
        run = live.stream_block(stream, str(tmp_path / f"out{left}"), checkpoint, rule(), "1 second", 0.5, ttl, "1 second")
        run.awaitTermination()
        assert len(held_state(spark, checkpoint)) == left
        judged = [o for p in run.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
        if ttl == 0:
            # The flood in second 40 finds its source blocked since second 7.
            assert [o["numRowsUpdated"] for o in judged].count(0) >= len(judged) - 1


def test_live_drops_equal_a_replay_of_packets(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_in_order(spark, minute(), source, 4)
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    log = live.VerdictLog(out, "1 second", "10 seconds")
    run = live.stream_block(stream, out, str(tmp_path / "cp"), rule(), "1 second", 0.5, "10 seconds", "1 second", on_batch=log)
    run.awaitTermination()
    log.finish(run, read_packets(spark, source), rule(), 0.5)
    packets = read_packets(spark, source)
    verdicts = judge(packets, rule(), "1 second", 0.5, "10 seconds")
    marked = mark_blacklisted(packets, blocks_of(verdicts)).where("dropped")
    want = {r["src_ip"]: (r["n"], r["b"]) for r in marked.groupBy("src_ip").agg(F.count("*").alias("n"), F.sum("pkt_len").alias("b")).collect()}
    got = live.read_stream_output(spark, out, "dropped").groupBy("src_ip").agg(F.sum("packets").alias("n"), F.sum("bytes").alias("b"))
    assert {r["src_ip"]: (r["n"], r["b"]) for r in got.collect()} == want and want


def test_late_packets_are_left_out(spark, tmp_path):
    source = str(tmp_path / "in")
    # A watermark counts from the batch after the one that moved it.
    parts = [(5, 3), (50, 3), (60, 2), (5, 4), (90, 1), (95, 1)]
    for part in [second(1, sec, n) for sec, n in parts]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    features = live.stream_features(stream, "1 second", "2 seconds")
    live.write_stream(features, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r["pkt_count"] for r in got] == [3.0, 3.0, 2.0, 1.0]


def test_stream_features_and_throughput_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    write_in_order(spark, minute(), source, 2)
    stream = read_packets(spark, source, stream=True)
    features = live.stream_features(stream, "5 seconds", "1 second")
    live.write_stream(features, str(tmp_path / "f"), str(tmp_path / "cf")).awaitTermination()
    got = spark.read.schema(features.schema).parquet(str(tmp_path / "f"))
    batch = feature_vector(windowed_counters(read_packets(spark, source), "5 seconds"))
    want = batch.where(batch.window_end <= START + timedelta(seconds=58))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    totals = live.stream_throughput(read_packets(spark, source, stream=True), "5 seconds", "1 second")
    live.write_stream(totals, str(tmp_path / "t"), str(tmp_path / "ct")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).agg({"total_pkts": "sum"}).first()[0] == 7 * 55 + 18


def test_last_windows_of_a_finite_run_are_closed(spark, tmp_path):
    source = str(tmp_path / "in")
    write_in_order(spark, minute(), source, 4)
    out, scorer = str(tmp_path / "out"), rule()
    loop = live.VerdictLog(out, "1 second", "10 seconds")
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    run = live.stream_block(stream, out, str(tmp_path / "cp"), scorer, "1 second", 0.5, "10 seconds", "1 second", on_batch=loop)
    run.awaitTermination()
    loop.finish(run, read_packets(spark, source), scorer, 0.5)
    got = live.read_stream_output(spark, out, "verdicts").select("src_ip", "window_start", "state")
    want = judge(read_packets(spark, source), scorer, "1 second", 0.5, "10 seconds").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    totals = live.read_throughput(spark, out).orderBy("window_start").collect()
    assert len(totals) == 60 and totals[-1]["cum_pkts"] + totals[-1]["cum_dropped"] == len(minute())
    assert totals[-1]["cum_dropped"] == 5 * 54


def test_squared_gaps_of_a_stream_equal_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = minute() + [(5, START + timedelta(seconds=s, microseconds=7 * s), 17, False, False, 90) for s in range(0, 60, 3)]
    write_in_order(spark, rows + rows[:40], source, 5)
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    counted = live.stream_counters(stream, "10 seconds", "1 second", with_iat_sq=True)
    run = live.write_stream(counted, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    got = spark.read.schema(counted.schema).parquet(str(tmp_path / "out"))
    batch = windowed_counters(read_packets(spark, source), "10 seconds", with_iat_sq=True).select(got.columns)
    want = batch.where(batch.window_end <= START + timedelta(seconds=58))
    assert got.count() == want.count() == 5 * 3 + 2
    assert got.exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="CPU"):
        windowed_counters(stream, "10 seconds", by_cpu=True, with_iat_sq=True)


def test_late_packets_are_kept_with_their_lateness(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [(5, 3), (50, 3), (5, 4), (49, 1), (90, 1), (51, 2)]
    for part in [second(1, sec, n) for sec, n in parts]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = read_packets(spark, source, stream=True, maxFilesPerTrigger="1")
    live.split_late(stream, out, str(tmp_path / "cp"), "1 second", "2 seconds").awaitTermination()
    kept = spark.read.parquet(f"{out}/packets/batch=*")
    assert kept.count() == sum(n for _, n in parts)
    late = {r["at"]: (r["n"], r["most"]) for r in kept.where("late").groupBy(F.unix_seconds("ts").alias("at")).agg(F.count("*").alias("n"), F.max("lateness_us").alias("most")).collect()}
    first = int(START.timestamp())
    # After second 50.02 the watermark stands at 48.02: the window of second 49 is open, that of 5 is not.
    assert late == {first + 5: (4, 43_020_000), first + 51: (2, 37_000_000)}
    # A batch that is run again reads the same watermark.
    split = live.LateSplit(out, "1 second", "2 seconds")
    split(read_packets(spark, source).where(F.unix_seconds("ts") == first + 51), 5)
    assert spark.read.parquet(f"{out}/packets/batch=*").where("late").count() == 6
