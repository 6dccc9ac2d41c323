"""The ten features on literal counters."""

import pytest

from floodlens.operators.features import feature_vector
from floodlens.schemas import FEATURES

COLUMNS = (
    "src_ip BIGINT, pkt_count BIGINT, byte_count BIGINT, syn_count BIGINT, ack_count BIGINT, udp_count BIGINT, "
    "icmp_count BIGINT, tcp_count BIGINT, other_proto BIGINT, pkt_size_sum_sq BIGINT, first_us BIGINT, "
    "last_us BIGINT, iat_sum_us BIGINT"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def vector(spark, **given):
    row = tuple(given.get(n, 0) for n in NAMES)
    counters = spark.createDataFrame([row], COLUMNS).selectExpr(
        "*", "timestamp_micros(first_us) AS first_seen", "timestamp_micros(last_us) AS last_seen"
    )
    return feature_vector(counters).first().asDict()


def test_basic_flood(spark):
    got = vector(
        spark,
        src_ip=0x0A000001,
        pkt_count=100,
        byte_count=15000,
        syn_count=80,
        ack_count=20,
        tcp_count=100,
        pkt_size_sum_sq=2500000,
        first_us=1_000_000,
        last_us=3_000_000,
        iat_sum_us=2_000_000,
    )
    want = [100, 15000, 80, 20, 4.0, 150, 2500, 2.0, 0.0, 20202.0202]
    assert [got[f] for f in FEATURES] == pytest.approx(want, abs=1e-4)


def test_zero_counters_give_zero_vector(spark):
    got = vector(spark)
    assert [got[f] for f in FEATURES] == [0.0] * 10


def test_ratio_without_acks_is_syn_count(spark):
    got = vector(spark, pkt_count=50, byte_count=3000, syn_count=50, tcp_count=50, first_us=1_000_000, last_us=1_500_000)
    assert got["syn_ack_ratio"] == 50.0
    assert got["flow_duration"] == pytest.approx(0.5)


def test_entropy(spark):
    two = vector(spark, pkt_count=100, byte_count=10000, tcp_count=50, udp_count=50)
    four = vector(spark, pkt_count=100, byte_count=1, tcp_count=25, udp_count=25, icmp_count=25, other_proto=25)
    assert two["proto_entropy"] == pytest.approx(1.0)
    assert four["proto_entropy"] == pytest.approx(2.0)


def test_single_packet_has_no_spread(spark):
    got = vector(spark, pkt_count=1, byte_count=60, tcp_count=1, pkt_size_sum_sq=3600, first_us=5, last_us=5)
    assert (got["pkt_size_var"], got["flow_duration"], got["iat_mean"]) == (0.0, 0.0, 0.0)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="iat_sum_us"):
        feature_vector(spark.range(1).selectExpr("id AS pkt_count"))
