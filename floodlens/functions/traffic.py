"""The derived traffic features, each a guarded expression over mergeable sums.

Division is guarded because ANSI mode raises on a zero divisor. Expressions are
SQL text: Python then hands over one string per feature instead of one call per
operator, and Catalyst sees the same tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodlens.schemas import PROTO_ICMP, PROTO_TCP, PROTO_UDP


def protocol_class(proto: str = "proto") -> Column:
    """'tcp', 'udp', 'icmp' or 'other' for an IP protocol number."""
    return F.expr(
        f"CASE {proto} WHEN {PROTO_TCP} THEN 'tcp' WHEN {PROTO_UDP} THEN 'udp'"
        f" WHEN {PROTO_ICMP} THEN 'icmp' ELSE 'other' END"
    )


def entropy_sql(counts: Sequence[str]) -> str:
    """Shannon entropy in bits of a set of counts; empty counts add nothing."""
    total = "(" + " + ".join(f"double({c})" for c in counts) + ")"
    terms = [f"CASE WHEN {c} > 0 THEN {c} / {total} * log2({c} / {total}) ELSE 0D END" for c in counts]
    return f"CASE WHEN {total} > 0 THEN 0D - ({' + '.join(terms)}) ELSE 0D END"


# SYN per ACK; with no ACK at all, the SYN count itself.
_RATIO = "CASE WHEN ack_count > 0 THEN double(syn_count) / ack_count ELSE double(syn_count) END"
_MEAN = "CASE WHEN pkt_count > 0 THEN double(byte_count) / pkt_count ELSE 0D END"
# Population variance from sums; a result below zero is rounding.
_VARIANCE = (
    "CASE WHEN pkt_count > 1 THEN greatest(double(pkt_size_sum_sq) / pkt_count"
    " - (double(byte_count) / pkt_count) * (double(byte_count) / pkt_count), 0D) ELSE 0D END"
)
# Seconds between the first and the last packet.
_DURATION = (
    "CASE WHEN last_seen > first_seen"
    " THEN double(unix_micros(last_seen) - unix_micros(first_seen)) / 1000000D ELSE 0D END"
)
# Mean gap between packets in microseconds.
_GAP = "CASE WHEN pkt_count > 1 THEN double(iat_sum_us) / (pkt_count - 1) ELSE 0D END"

DERIVED = {
    "syn_ack_ratio": _RATIO,
    "pkt_size_mean": _MEAN,
    "pkt_size_var": _VARIANCE,
    "flow_duration": _DURATION,
    "proto_entropy": entropy_sql(["tcp_count", "udp_count", "icmp_count", "other_proto"]),
    "iat_mean": _GAP,
}


def derived(name: str) -> Column:
    """One derived feature over counter columns, under its own name."""
    return F.expr(DERIVED[name]).alias(name)
