"""Column contracts and defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The order of the ten model inputs is a contract between training and serving.
FEATURES = [
    "pkt_count",
    "byte_count",
    "syn_count",
    "ack_count",
    "syn_ack_ratio",
    "pkt_size_mean",
    "pkt_size_var",
    "flow_duration",
    "proto_entropy",
    "iat_mean",
]

# The same ten inputs under the column names of labelled flow tables.
FLOW_FEATURES = [
    "Total Fwd Packets",
    "Total Length of Fwd Packets",
    "SYN Flag Count",
    "ACK Flag Count",
    "SYN_ACK_Ratio",
    "Packet Length Mean",
    "Packet Length Variance",
    "Flow Duration",
    "Proto_Entropy",
    "Flow IAT Mean",
]

# IANA protocol numbers and the IPv4 EtherType.
PROTO_ICMP, PROTO_TCP, PROTO_UDP = 1, 6, 17
ETHERTYPE_IPV4 = 0x0800

# Detection defaults.
DEFAULT_WINDOW = "500 milliseconds"
DEFAULT_THRESHOLD = 0.85
DEFAULT_TTL = "60 seconds"
LABEL = "Label"
BENIGN = "BENIGN"

# End of a block that never expires (9999-12-31 23:59:59.999999 UTC).
PERMANENT_US = 253402300799999999
# ---------------------------------------------------------------------------

# Counters that merge by plain addition.
SUM_COUNTERS = [
    "pkt_count",
    "byte_count",
    "syn_count",
    "ack_count",
    "udp_count",
    "icmp_count",
    "tcp_count",
    "other_proto",
    "pkt_size_sum_sq",
    "iat_sum_us",
]

PACKETS = T.StructType(
    [
        T.StructField("src_ip", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("tcp_syn", T.BooleanType()),
        T.StructField("tcp_ack", T.BooleanType()),
        T.StructField("pkt_len", T.LongType()),
    ]
)

BLACKLIST = T.StructType(
    [
        T.StructField("src_ip", T.LongType()),
        T.StructField("blocked_at", T.TimestampType()),
        T.StructField("ttl_us", T.LongType()),
    ]
)

# Labelled flow tables: whole-number columns first, then measured ones.
_FLOW_COUNTS = [
    "Total Fwd Packets",
    "Total Backward Packets",
    "SYN Flag Count",
    "ACK Flag Count",
]
_FLOW_MEASURES = [
    "Flow Duration",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Min",
    "Fwd Packet Length Max",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Min",
    "Bwd Packet Length Max",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Fwd IAT Mean",
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Packet Length Mean",
    "Packet Length Std",
    "Packet Length Variance",
    "Average Packet Size",
    "Fwd Segment Size Avg",
]
FLOW_TYPES: dict[str, T.DataType] = {
    **{name: T.LongType() for name in _FLOW_COUNTS},
    **{name: T.DoubleType() for name in _FLOW_MEASURES},
    LABEL: T.StringType(),
}


def require(df, columns) -> None:
    """Fail early, with names, when an input lacks columns an operator reads."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
