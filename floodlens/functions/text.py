"""Alert wording as column expressions (delivery is left to the caller)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: message formats -------------------------------------------
ALERT_LINE = "[%s] %s src=%s score=%.4f pkts=%.0f bytes=%.0f syns=%.0f"
WEBHOOK_TEXT = "🚨 DDoS Alert: %s from %s (score: %.2f, pkts: %.0f)"
RFC3339_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ALERT_FIELDS = ["timestamp", "src_ip", "score", "pkt_count", "byte_count", "syn_count", "action"]
# ---------------------------------------------------------------------------


def alert_text() -> Column:
    """One console line per alert row."""
    return F.format_string(
        ALERT_LINE,
        F.date_format("timestamp", RFC3339_UTC),
        "action",
        "src_ip",
        "score",
        "pkt_count",
        "byte_count",
        "syn_count",
    )


def webhook_payload() -> Column:
    """JSON body with a summary text and the alert itself."""
    text = F.format_string(WEBHOOK_TEXT, "action", "src_ip", "score", "pkt_count")
    return F.to_json(F.struct(text.alias("text"), F.struct(*ALERT_FIELDS).alias("alert")))
