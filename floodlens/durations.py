"""Durations as text ("500 milliseconds", "60s") and as microseconds."""

from __future__ import annotations

import re

# --- fixed values: microseconds per unit ------------------------------------
_UNIT_US = {
    "us": 1,
    "microsecond": 1,
    "ms": 1_000,
    "millisecond": 1_000,
    "s": 1_000_000,
    "second": 1_000_000,
    "m": 60_000_000,
    "minute": 60_000_000,
    "h": 3_600_000_000,
    "hour": 3_600_000_000,
    "d": 86_400_000_000,
    "day": 86_400_000_000,
}
# ---------------------------------------------------------------------------
_PART = re.compile(r"(\d+(?:\.\d+)?)\s*([a-z]+)")


def to_micros(text: str | int) -> int:
    """Microseconds in a duration; whole numbers are already microseconds."""
    if isinstance(text, int):
        return text
    cleaned = text.strip().lower()
    if cleaned == "0":
        return 0
    parts = _PART.findall(cleaned)
    if not parts or _PART.sub("", cleaned).strip():
        raise ValueError(f"not a duration: {text!r}")
    total = 0.0
    for number, unit in parts:
        key = unit if unit in _UNIT_US else unit.removesuffix("s")
        if key not in _UNIT_US:
            raise ValueError(f"not a duration: {text!r}")
        total += float(number) * _UNIT_US[key]
    return round(total)


def to_interval(text: str | int) -> str:
    """The same duration in the wording that F.window and watermarks accept."""
    return f"{to_micros(text)} microseconds"
