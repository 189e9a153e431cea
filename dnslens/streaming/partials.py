"""Running summaries as partial aggregates: every micro-batch leaves its own, readers add them up.

The stream keeps no state, however many names there are; a batch writes one row per value that it saw.
``compact`` folds the partials of many batches into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.operators.filters import known
from dnslens.operators.summary import DIMENSIONS, breakdowns
from dnslens.operators.windows import top_k
from dnslens.session import delete_folder, folder_exists
from dnslens.streaming.run import drain_batches, new_folder

#: log2 of the buckets of the name sketch: estimates are off by 1.04 / sqrt(2^14), 0.8 %, in one standard deviation.
SKETCH_LG = 14
VALUES = "dimension string, value string, events bigint, first_seq bigint, last_seq bigint, batch bigint"
TOTALS = "total_events bigint, last_seq bigint, last_event_at timestamp, names binary, batch bigint"


def _values(rows: DataFrame) -> DataFrame:
    """Counts of equal values added up."""
    return rows.groupBy("dimension", "value").agg(
        F.sum("events").alias("events"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"), F.max("last_seq").alias("last_seq"),
        F.max_by("last_event_at", "last_seq").alias("last_event_at"), F.hll_union_agg("names").alias("names"))


def _batch_totals(events: DataFrame) -> DataFrame:
    name = F.when(known("domain"), F.col("domain"))
    return events.agg(
        F.count("*").alias("total_events"), F.max("seq").alias("last_seq"), F.max_by("event_ts", "seq").alias("last_event_at"),
        F.hll_sketch_agg(name, SKETCH_LG).alias("names"))


class Partials:
    """The partial aggregates of a stream under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def record(self, events: DataFrame, batch: int) -> None:
        """Write a micro-batch's partials; a repeated batch replaces its own."""
        held = events.persist()
        dimensions = [name for name in DIMENSIONS if name in events.columns]
        breakdowns(held, dimensions).write.mode("overwrite").parquet(f"{self._path}/values/batch={batch}")
        _batch_totals(held).write.mode("overwrite").parquet(f"{self._path}/totals/batch={batch}")
        held.unpersist()

    def _read(self, name: str, schema: str) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._path}/{name}")

    def breakdowns(self) -> DataFrame:
        """``summary.breakdowns`` of everything recorded."""
        return _values(self._read("values", VALUES))

    def top(self, dimension: str, k: int) -> DataFrame:
        """The ``k`` most frequent known values of a dimension, exactly, with counts; ties go to the newest seen."""
        counted = self.breakdowns().filter(F.col("dimension") == dimension)
        return top_k(counted, k).select(F.col("value").alias(dimension), "events")

    def totals(self, exact: bool = True) -> DataFrame:
        """One row: total_events, unique_domains, last_event_at. ``exact`` counts the names of the
        breakdown; otherwise their sketches are united, one small row a batch, with the error of ``SKETCH_LG``."""
        row = _totals(self._read("totals", TOTALS))
        if exact:
            names = self.breakdowns().filter("dimension = 'domain'").agg(F.count("*").alias("n")).select("n").scalar()
        else:
            names = F.hll_sketch_estimate("names")
        return row.select("total_events", names.alias("unique_domains"), "last_event_at")

    def compact(self, before: int) -> None:
        """Fold the batches below ``before`` into one. Not while a stream repeats one of them, nor while others read.

        The folded rows are written first, as the newest batch among those they replace; if this ends half-way,
        calling it again finishes: a batch that has been folded in is named by the folder.
        """
        for name, schema, fold in (("values", VALUES, _values), ("totals", TOTALS, _totals)):
            old = self._read(name, schema).filter(F.col("batch") < before)
            numbers = sorted(row["batch"] for row in old.select("batch").distinct().collect())
            target = f"{self._path}/folded-{name}-{before}"
            if not folder_exists(self._spark, f"{target}/_SUCCESS"):
                if len(numbers) < 2:
                    continue
                fold(old.drop("batch")).write.mode("overwrite").parquet(target)
            for number in numbers:
                delete_folder(self._spark, f"{self._path}/{name}/batch={number}")
            self._spark.read.parquet(target).write.mode("overwrite").parquet(f"{self._path}/{name}/batch={before - 1}")
            delete_folder(self._spark, target)


def drain_partials(events: DataFrame, arrivals: Iterable[Callable[[], None]] = ()) -> Partials:
    """Record a stream of events over what its source has now and after each arrival."""
    spark = events.sparkSession
    folder = new_folder(spark, "partials")
    partials = Partials(spark, folder)
    drain_batches(events, partials.record, f"{folder}/checkpoint", arrivals)
    return partials
