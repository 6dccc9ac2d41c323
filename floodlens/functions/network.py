"""IPv4 addresses and raw frame bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four decimal octets without leading zeros.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"^{_OCTET}([.]{_OCTET}){{3}}$"


def int_to_ip(value: str) -> Column:
    """Dotted text of an unsigned 32-bit address held in a BIGINT column."""
    octets = ", ".join(f"shiftright({value}, {shift}) & 255" for shift in (24, 16, 8, 0))
    return F.expr(f"concat_ws('.', {octets})")


def ip_to_int(text: str) -> Column:
    """Unsigned value of a dotted address column; 0 when the text is not IPv4."""
    octets = " + ".join(
        f"CAST(split_part({text}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)
    )
    return F.expr(f"CASE WHEN {text} RLIKE r'{DOTTED}' THEN {octets} ELSE 0L END")


def unsigned_sql(frame: str, pos: str | int, width: int = 1) -> str:
    """Big-endian unsigned integer of ``width`` bytes at a 0-based offset, as SQL."""
    return f"CAST(conv(hex(substring({frame}, {pos} + 1, {width})), 16, 10) AS BIGINT)"
