"""Packet reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.session import held


def packet_counts(frames: DataFrame) -> DataFrame:
    """All packets and those with a DNS layer."""
    return frames.agg(
        F.count("*").alias("packet_count"), F.count_if(F.col("dns_id").isNotNull()).alias("dns_event_count")
    )


def _decimal_text(col: Column) -> Column:
    """A number without exponent and with at least one decimal (``1700000000.25``)."""
    digits = F.rtrim(col.cast("decimal(30,12)").cast("string"), F.lit("0"))
    return F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)


def packet_csv_rows(report: DataFrame) -> DataFrame:
    """The 13 report columns as text; lists joined by comma and blank."""
    shown = {
        "timestamp": _decimal_text(F.col("timestamp")),
        "is_response": F.initcap(F.col("is_response").cast("string")),
        "answers": F.array_join("answers", ", "),
        "ttls": F.array_join(F.col("ttls").cast("array<string>"), ", "),
    }
    return report.select(
        *[shown.get(name, F.col(name).cast("string")).alias(name) for name in dims.PACKET_HEADER]
    )


def export_packets_csv(report: DataFrame, path: str) -> bool:
    """Write the report as CSV (cells quoted where needed); nothing when it is empty. The report is worked out once."""
    with held(report) as (rows, count):
        if not count:
            return False
        lines = packet_csv_rows(rows.orderBy("timestamp"))
        lines.write.mode("overwrite").option("escape", '"').option("emptyValue", "").csv(path, header=True)
    return True


def export_packets_json(report: DataFrame, frames: DataFrame, path: str) -> None:
    """Write ``path/events`` (one record per line) and ``path/metadata``. The report is worked out once."""
    with held(report) as (rows, _):
        rows.orderBy("timestamp").write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/events")
    metadata = packet_counts(frames).withColumn("generated_at", F.current_timestamp())
    metadata.write.mode("overwrite").json(f"{path}/metadata")
