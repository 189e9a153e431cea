"""The tables the plans start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.operators.normalize import build_events
from dnslens.plans.dns_raw import DNS_RAW
from dnslens.session import ship_package, spread, written

TOOL, MODE = "tshark", "live"
TASK_ROWS = 250_000  # events that one task should parse, or score and write


def task_count(rows: int, cores: int) -> int:
    """Tasks to deal ``rows`` events out to: one a core, and more where those would get over ``TASK_ROWS``."""
    return max(cores, -(-rows // TASK_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_from(events: DataFrame) -> DataFrame:
    """Raw DNS records from the ``events`` table (batch or stream)."""
    raw = events.sparkSession.sql(DNS_RAW, events=events)
    return raw.withColumns(
        {"event_ts": F.col("event_ts").cast("timestamp"), "answers": F.split("answers_raw", ";")}
    )


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return raw_from(spread(table(spark, folder, "events")))


def raw_dealt(spark: SparkSession, folder: str) -> DataFrame:
    """The raw records laid down in files of at most ``TASK_ROWS`` rows, one a core at least.

    What is costly in a filter (parsing) is then shared out evenly; Spark would push it below the shuffle of ``spread``,
    into the few tasks that hold the table's row groups.
    """
    given = table(spark, folder, "events")
    return written(raw_from(given.repartition(task_count(given.count(), spark.sparkContext.defaultParallelism))))


def events(spark: SparkSession, folder: str, score: bool = True, **scoring) -> DataFrame:
    """Normalised (and scored) DNS events."""
    return build_events(raw(spark, folder), TOOL, MODE, score, **scoring)


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same records as a stream over the table's file."""
    events = table(spark, folder, "events")
    files = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    # the rows are counted from the file's footer; a table with as many splits already is not dealt out
    tasks = task_count(events.count(), spark.sparkContext.defaultParallelism)
    return raw_from(files.repartition(tasks) if events.rdd.getNumPartitions() < tasks else files)
