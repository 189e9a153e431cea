"""Stored session records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, status string, tool string, note string, startedAt timestamp, endedAt timestamp, "
    "lastEventAt timestamp, eventsSeen bigint, errors array<string>, "
    "config struct<mode:string, preferredTool:string, interface:string, pcapPath:string, mongoUri:string, "
    "mongoDb:string, mongoCollection:string, limit:bigint, sinkholeIp:string, scanTarget:string>"
)
RENAMED = {
    "startedAt": "started_at",
    "endedAt": "ended_at",
    "lastEventAt": "last_event_at",
    "eventsSeen": "events_seen",
}


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session records of a ledger; a missing or unreadable ledger has none."""
    try:
        records = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        records = spark.createDataFrame([], SCHEMA)
    return records.filter(F.col("id").isNotNull()).withColumnsRenamed(RENAMED)
