"""Streams of events: enrichment, running summary, traffic, alerts and sessions.

Enrichment, focus alerts, breakdowns, counters and status are the batch operators
themselves, applied to a streaming frame. Alert suppression, the activity feed and the series without
gaps keep state of their own (``states``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.operators.alerts import DEFAULT_GAP, alert_candidates, gap_micros, traffic_counts
from dnslens.operators.normalize import build_events
from dnslens.operators.sessions import FEED_SCHEMA, SAMPLED_EVERY, SAMPLED_FIRST, feed_notes
from dnslens.operators.summary import breakdowns
from dnslens.operators.windows import latest
from dnslens.streaming.states import BucketSuppression, Feed, Suppression, ZeroFill, transform

ALERT_SCHEMA = "seq bigint, event_ts timestamp, domain string, threat_level string, message string"
ALERT_BUCKETS = 1024


def enrich(raw: DataFrame, tool: str, mode: str) -> DataFrame:
    """Per-record enrichment (stateless, append mode)."""
    return build_events(raw, tool, mode)


def running_breakdowns(events: DataFrame) -> DataFrame:
    """Counts per dimension value (update or complete mode); state grows with distinct values."""
    return breakdowns(events)


def running_totals(events: DataFrame) -> DataFrame:
    """Events, approximate distinct names and last event time (update or complete mode).

    A stream cannot count distinct names exactly without keeping them; the exact
    number is the row count of ``running_breakdowns`` for the dimension ``domain``.
    """
    name = F.when(F.col("domain") != "unknown", F.col("domain"))
    return events.agg(
        F.count("*").alias("total_events"),
        F.approx_count_distinct(name).alias("unique_domains_approx"),
        F.max_by("event_ts", "seq").alias("last_event_at"),
    )


def traffic(events: DataFrame, bucket: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Events per time bucket. ``delay`` bounds how late events may come (append mode)."""
    return traffic_counts(events.withWatermark("event_ts", delay), bucket)


def traffic_series(events: DataFrame, bucket: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """``traffic`` without gaps: idle buckets follow with 0 as the watermark passes them (append mode).

    Counting is Spark's own windowed aggregate; only closed buckets, one row each, reach the state that
    fills the gaps. Buckets of a millisecond at least.
    """
    counted = events.withWatermark("event_ts", delay).groupBy(F.window("event_ts", bucket)).agg(F.count("*").alias("events"))
    closed = counted.select(F.lit(0).alias("series"), F.window_time("window").alias("at"), "events")
    return transform(closed, ["series"], ZeroFill(gap_micros(bucket)), "bucket_start timestamp, events bigint", "append", timed=True)


def alerts(events: DataFrame, gap: str = DEFAULT_GAP, delay: str = "10 seconds", buckets: int | None = ALERT_BUCKETS) -> DataFrame:
    """Alerts per name with suppression across micro-batches (append mode).

    The state is the time of each name's last alert, until the watermark has left it behind by the gap. It is kept in ``buckets``
    of names by hash; ``None`` keeps a variable and a timer of its own for each name, at the price of several calls a name and
    micro-batch. Events later than ``delay`` behind the newest are dropped; those without a time all alert.
    """
    columns = [part.split()[0] for part in ALERT_SCHEMA.split(", ")]
    candidates = alert_candidates(events.withWatermark("event_ts", delay))
    if buckets is None:
        return transform(candidates, ["domain"], Suppression(gap_micros(gap), columns), ALERT_SCHEMA, "append", timed=True)
    dealt = candidates.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int"))
    return transform(dealt, ["bucket"], BucketSuppression(gap_micros(gap), columns), ALERT_SCHEMA, "append", timed=True)


def activity_feed(messages: DataFrame) -> DataFrame:
    """``sessions.activity_feed`` on a stream of messages with ``seq`` (update mode): the newest row per
    (session_id, first_seq) is the run as it stands."""
    noted = feed_notes(messages)
    return transform(noted, ["session_id"], Feed(SAMPLED_FIRST, SAMPLED_EVERY), FEED_SCHEMA, "update", timed=False)


def consume(spark: SparkSession, store: str, rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """What a new consumer reads: the newest events now, and a stream of those that arrive from then on.

    The hand-over is the snapshot's highest arrival number: the stream passes later events
    only, each once, and none that the store held already.
    """
    now = spark.read.parquet(store)
    last = now.agg(F.max("seq")).first()[0]
    later = spark.readStream.schema(now.schema).parquet(store)
    return latest(now, rows), later if last is None else later.filter(F.col("seq") > last)
