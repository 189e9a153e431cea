"""The event store: date-partitioned Parquet, in batch or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DATE = "event_date"


def _dated(events: DataFrame) -> DataFrame:
    return events.withColumn(DATE, F.to_date("event_ts"))


def write_events(events: DataFrame, path: str) -> None:
    """Append events, partitioned by date, in order of arrival.

    The rebalance hint lets AQE cut a heavy day into several files of good size and
    put small days together. Rows are sorted by arrival number within a file, so that row groups hold
    narrow ranges of it and a bounded range (``windows.newest_before``) reads few of them.
    """
    dated = _dated(events).hint("rebalance", DATE)
    dated.sortWithinPartitions(DATE, "seq").write.mode("append").partitionBy(DATE).parquet(path)


def stream_to_store(
    events: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds"
) -> StreamingQuery:
    """Persist a stream in micro-batches, exactly once; ``every=None`` drains what is there and stops."""
    writer = _dated(events).writeStream.format("parquet").outputMode("append").partitionBy(DATE)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
