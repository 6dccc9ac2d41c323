"""Packet sources: tables, streams of files, and raw frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from floodlens.functions.network import unsigned_sql
from floodlens.schemas import ETHERTYPE_IPV4, PACKETS, PROTO_ICMP, PROTO_TCP, PROTO_UDP

# --- fixed values: Ethernet, IPv4 and transport header layout (bytes) ---------
ETH_HEADER = 14
ETHERTYPE_AT = 12
IP_HEADER = 20
IP_PROTOCOL_AT = ETH_HEADER + 9
IP_SOURCE_AT = ETH_HEADER + 12
TCP_HEADER = 20
TCP_FLAGS_AT = 13
UDP_HEADER = 8
ICMP_HEADER = 8
TCP_SYN_BIT = 0x02
TCP_ACK_BIT = 0x10
# ---------------------------------------------------------------------------


def read_packets(
    spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = PACKETS, **options: str
) -> DataFrame:
    """Packet table from Parquet, as a batch or as a stream of arriving files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(**options).parquet(path)


def _probe(df: DataFrame, frame: str) -> DataFrame:
    """Frames with a complete IPv4 header: their size, protocol, transport offset, and whether the
    transport header is complete."""
    # Low half of the first IP byte counts the header length in 4-byte words.
    words = f"({unsigned_sql(frame, ETH_HEADER)} & 15)"
    needed = (
        f"CASE _proto WHEN {PROTO_TCP} THEN {TCP_HEADER} WHEN {PROTO_UDP} THEN {UDP_HEADER}"
        f" WHEN {PROTO_ICMP} THEN {ICMP_HEADER} END"
    )
    return (
        df.where(f"length({frame}) >= {ETH_HEADER + IP_HEADER}")
        .where(f"{unsigned_sql(frame, ETHERTYPE_AT, 2)} = {ETHERTYPE_IPV4}")
        .selectExpr(
            *df.columns,
            f"CAST(length({frame}) AS BIGINT) AS _size",
            f"CAST({unsigned_sql(frame, IP_PROTOCOL_AT)} AS INT) AS _proto",
            f"CAST({ETH_HEADER} + {words} * 4 AS INT) AS _l4",
        )
        .selectExpr("*", f"coalesce(_size >= _l4 + {needed}, true) AS _l4_ok")
    )


def valid_ipv4(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Keep frames with a complete IPv4 header and a complete transport header.

    Everything else passes through the network uncounted. Protocols other than
    TCP, UDP and ICMP need no transport header.
    """
    return _probe(df, frame).where("_l4_ok").select(*df.columns)


def decode_frames(df: DataFrame, frame: str = "frame", ts: str = "ts") -> DataFrame:
    """Raw Ethernet frames to packet rows, as one projection without any UDF.

    Frames that cannot be counted are dropped; other columns are kept. The packet
    length is the length of the whole frame, link header included.
    """
    return countable(decode_headers(df, frame, ts))


def countable(headers: DataFrame) -> DataFrame:
    """Decoded frames whose transport header is complete."""
    return headers.where("l4_ok").drop("l4_ok")


def decode_headers(df: DataFrame, frame: str = "frame", ts: str = "ts") -> DataFrame:
    """As decode_frames, with every frame that has a complete IPv4 header and ``l4_ok``.

    A blacklist is asked at this point: a frame of a blocked source counts as dropped even
    if its transport header is cut. Only ``countable`` rows go on to the counters.
    """
    kept = [c for c in df.columns if c not in (frame, ts)]
    flags = unsigned_sql(frame, f"_l4 + {TCP_FLAGS_AT}")
    return _probe(df, frame).selectExpr(
        f"{unsigned_sql(frame, IP_SOURCE_AT, 4)} AS src_ip",
        f"{ts} AS ts",
        "_proto AS proto",
        f"_l4_ok AND _proto = {PROTO_TCP} AND ({flags} & {TCP_SYN_BIT}) > 0 AS tcp_syn",
        f"_l4_ok AND _proto = {PROTO_TCP} AND ({flags} & {TCP_ACK_BIT}) > 0 AS tcp_ack",
        "_size AS pkt_len",
        "_l4_ok AS l4_ok",
        *kept,
    )
