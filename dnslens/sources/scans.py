"""Port-scan replies as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.text import fill
from dnslens.operators.normalize import build_events

SYN_ACK = 0x12


def scan_events(replies: DataFrame) -> DataFrame:
    """One event per open port: replies with flags SYN-ACK.

    Needs ``seq``, ``event_ts``, ``source_ip``, ``destination_ip``, ``port`` and ``flags``.
    """
    port = F.col("port").cast("int")
    protocol = F.when(port == 53, "DNS/TCP").when(port == 443, "DoH").otherwise("DoT")
    raw = replies.filter(F.col("flags") == SYN_ACK).select(
        "seq",
        "event_ts",
        F.concat(F.lit("scan-"), port.cast("string")).alias("domain"),
        "source_ip",
        "destination_ip",
        F.lit("SCAN").alias("qtype_raw"),
        F.lit("tcp").alias("transport"),
        port.cast("string").alias("destination_port"),
        F.lit(None).cast("string").alias("rcode_raw"),
        F.lit(None).cast("bigint").alias("ttl"),
        F.array(fill(dims.NOTE_OPEN_PORT, protocol)).alias("answers"),
        F.lit(None).cast("boolean").alias("is_response"),
    )
    return build_events(raw, tool="scapy-scanner", mode="scan")
