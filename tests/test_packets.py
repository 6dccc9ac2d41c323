"""Frames, addresses and counters."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from floodlens.durations import to_interval, to_micros
from floodlens.functions.network import int_to_ip, ip_to_int
from floodlens.operators import counters as ct
from floodlens.sources.packets import decode_frames

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "src_ip BIGINT, ts TIMESTAMP, proto INT, tcp_syn BOOLEAN, tcp_ack BOOLEAN, pkt_len BIGINT, cpu INT"


def eth(kind=0x0800):
    return b"\x02" * 12 + kind.to_bytes(2, "big")


def ipv4(proto, words=5, src=0x0A000001):
    head = bytes([0x40 | words]) + b"\x00" * 8 + bytes([proto]) + b"\x00\x00" + src.to_bytes(4, "big")
    return head + b"\x0a\x00\x00\xfe" + b"\x01" * (4 * (words - 5))


def tcp(flags):
    return b"\x00" * 12 + b"\x50" + bytes([flags]) + b"\x00" * 6


FRAMES = [
    ("syn", eth() + ipv4(6) + tcp(0x02), (6, True, False)),
    ("syn_ack", eth() + ipv4(6) + tcp(0x12), (6, True, True)),
    ("ack_options", eth() + ipv4(6, words=6) + tcp(0x10), (6, False, True)),
    ("high_source", eth() + ipv4(6, src=0xFFFEFDFC) + tcp(0x02), (6, True, False)),
    ("udp", eth() + ipv4(17) + b"\x00" * 8, (17, False, False)),
    ("icmp", eth() + ipv4(1) + b"\x00" * 8, (1, False, False)),
    ("gre", eth() + ipv4(47), (47, False, False)),
    ("ipv6", eth(0x86DD) + b"\x60" + b"\x00" * 60, None),
    ("runt", b"\x02" * 13, None),
    ("empty", b"", None),
    ("cut_ip", eth() + ipv4(6)[:19], None),
    ("cut_tcp", eth() + ipv4(6) + tcp(2)[:19], None),
    ("cut_udp", eth() + ipv4(17, words=6) + b"\x00" * 7, None),
    ("cut_icmp", eth() + ipv4(1) + b"\x00" * 7, None),
]


def test_every_frame_kind(spark):
    rows = [(name, bytearray(raw), START) for name, raw, _ in FRAMES]
    df = spark.createDataFrame(rows, "name STRING, frame BINARY, ts TIMESTAMP")
    got = {r["name"]: r for r in decode_frames(df).collect()}
    want = {name: (raw, parts) for name, raw, parts in FRAMES if parts}
    assert set(got) == set(want)
    for name, (raw, parts) in want.items():
        r = got[name]
        assert (r["proto"], r["tcp_syn"], r["tcp_ack"]) == parts, name
        assert r["pkt_len"] == len(raw)
        assert r["src_ip"] == (0xFFFEFDFC if name == "high_source" else 0x0A000001)


def test_addresses(spark):
    rows = [("10.0.0.1",), ("255.255.255.255",), ("0.0.0.0",), ("256.1.1.1",), ("::1",), ("1.2.3",), ("",), ("10.0.0.07",), ("010.1.1.1",)]
    df = spark.createDataFrame(rows, "t STRING").withColumn("v", ip_to_int("t"))
    got = {r["t"]: r["v"] for r in df.collect()}
    assert got == {
        "10.0.0.1": 0x0A000001,
        "255.255.255.255": 0xFFFFFFFF,
        "0.0.0.0": 0,
        "256.1.1.1": 0,
        "::1": 0,
        "1.2.3": 0,
        "": 0,
        "10.0.0.07": 0,
        "010.1.1.1": 0,
    }
    back = spark.createDataFrame([(0x0A000001,), (0xFFFFFFFF,)], "v BIGINT").withColumn("t", int_to_ip("v"))
    assert [r["t"] for r in back.collect()] == ["10.0.0.1", "255.255.255.255"]


def test_durations():
    assert to_micros("500ms") == to_micros("500 milliseconds") == 500_000
    assert to_micros("1m30s") == 90_000_000
    assert to_micros("0") == 0
    assert to_interval("2 seconds") == "2000000 microseconds"
    for wrong in ("", "ten seconds", "5 parsecs", "5"):
        with pytest.raises(ValueError):
            to_micros(wrong)


def make_packets(seed, n=300, sources=4, span=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        src = 1 if rng.random() < 0.4 else rng.randrange(2, 2 + sources)
        at = START + timedelta(milliseconds=rng.randrange(span * 100) * 10)
        proto = rng.choice([6, 6, 17, 1, 47])
        rows.append((src, at, proto, rng.random() < 0.5, rng.random() < 0.5, rng.randrange(40, 1500), rng.randrange(3)))
    return rows


def brute_force(rows, width_us, by_cpu=False):
    groups = defaultdict(list)
    for r in rows:
        us = (r[1] - START) // timedelta(microseconds=1)
        groups[(r[0], us // width_us)].append((us, r))
    out = {}
    for key, members in groups.items():
        parts = defaultdict(list)
        for us, r in members:
            parts[r[6] if by_cpu else 0].append(us)
        gaps = [b - a for times in parts.values() for a, b in zip(sorted(times), sorted(times)[1:])]
        packets = [r for _, r in members]
        out[key] = {
            "pkt_count": len(packets),
            "byte_count": sum(r[5] for r in packets),
            "syn_count": sum(r[2] == 6 and r[3] for r in packets),
            "ack_count": sum(r[2] == 6 and r[4] for r in packets),
            "udp_count": sum(r[2] == 17 for r in packets),
            "icmp_count": sum(r[2] == 1 for r in packets),
            "tcp_count": sum(r[2] == 6 for r in packets),
            "other_proto": sum(r[2] == 47 for r in packets),
            "pkt_size_sum_sq": sum(r[5] ** 2 for r in packets),
            "iat_sum_us": sum(gaps),
            "iat_sum_sq": float(sum(g * g for g in gaps)),
        }
    return out


@pytest.mark.parametrize("by_cpu", [False, True])
def test_windowed_counters_match_brute_force(spark, by_cpu):
    rows = make_packets(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ct.windowed_counters(df, "5 seconds", by_cpu=by_cpu, with_iat_sq=True)
    want = brute_force(rows, 5_000_000, by_cpu)
    epoch = int(START.timestamp() * 1e6)
    seen = {}
    for r in got.selectExpr("*", "unix_micros(window_start) AS ws").collect():
        seen[(r["src_ip"], (r["ws"] - epoch) // 5_000_000)] = {k: r[k] for k in next(iter(want.values()))}
    assert seen == want


@settings(
    max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate]
)
@given(st.integers(0, 10_000), st.integers(2, 5))
def test_merging_any_partition_gives_the_whole(spark, seed, pieces):
    rows = make_packets(seed, n=120)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r["src_ip"]: r.asDict() for r in ct.source_counters(df).collect()}
    parts = [ct.source_counters(spark.createDataFrame(rows[i::pieces], SCHEMA)) for i in range(pieces)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    for r in ct.merge_counters(union, ["src_ip"]).collect():
        merged, full = r.asDict(), whole[r["src_ip"]]
        # Gap sums add up per part; parts that overlap in time see other gaps.
        del merged["iat_sum_us"], full["iat_sum_us"]
        assert merged == full


def test_unset_first_seen_is_ignored(spark):
    df = spark.createDataFrame(
        [(1, 50, 3000, 0), (1, 30, 1800, 7_000_000), (1, 20, 1200, 5_000_000)],
        "src_ip BIGINT, pkt_count BIGINT, byte_count BIGINT, f BIGINT",
    ).selectExpr("*", "timestamp_micros(f) AS first_seen", "timestamp_micros(f + 1) AS last_seen")
    got = ct.merge_counters(df, ["src_ip"]).selectExpr("*", "unix_micros(first_seen) AS fs").first()
    assert (got["pkt_count"], got["byte_count"], got["fs"]) == (100, 6000, 5_000_000)


def test_gaps_cross_slices_but_not_windows(spark):
    times = [0, 0, 1, 3000, 4999, 5000, 9000]
    rows = [(1, START + timedelta(milliseconds=t), 6, True, False, 60, 0) for t in times]
    got = ct.inter_arrival(spark.createDataFrame(rows, SCHEMA), "5 seconds").orderBy("ts").collect()
    assert [(r["packets"], r["iat_us"]) for r in got] == [
        (2, None),
        (1, 1000),
        (1, 2_999_000),
        (1, 1_999_000),
        (1, None),
        (1, 4_000_000),
    ]
