"""Running streams into tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dnslens.operators.ordered import newest_per_key
from dnslens.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(start: Callable[[], StreamingQuery], arrivals: Iterable[Callable[[], None]] = ()) -> None:
    """Run a query over what its source has, and again after each arrival of more.

    ``start`` starts it with a trigger that ends when the source is read; it goes on from its checkpoint each time.
    """
    start().awaitTermination()
    for arrive in arrivals:
        arrive()
        start().awaitTermination()


LANDING_ROWS = 250_000  # rows a landing's file should hold: a file is often read by one task


def landings(spark: SparkSession, rows: DataFrame, order: Column, parts: int = 4, files: int = 2, text: bool = False) -> tuple[str, list[Callable[[], None]]]:
    """A folder into which ``rows`` land in ``parts`` ranges of ``order`` (a whole number): the first is
    there already, each call lands the next one, in ``files`` files, or more of a large table, whose names keep the order.

    The bounds are even steps from the least to the greatest ``order``.
    """
    path = new_folder(spark, "landing")
    low, high, count = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    files = max(files, -(-count // (parts * LANDING_ROWS)))
    low, high = (0, 0) if low is None else (low, high)
    bounds = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]

    def land(k: int) -> None:
        part = rows.filter((order >= bounds[k]) & (order < bounds[k + 1]))
        ordered = part.withColumn("_order", order).repartitionByRange(files, "_order").sortWithinPartitions("_order").drop("_order")
        if text:
            ordered.select("value").write.mode("append").text(f"{path}/part={k}")
        else:
            ordered.write.mode("append").parquet(f"{path}/part={k}")

    land(0)
    return path, [partial(land, k) for k in range(1, parts)]


def drain_append(stream: DataFrame, name: str, arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run an append-mode stream over what its source has now and after each arrival; the written table."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    drain(writer.start, arrivals)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def drain_update(stream: DataFrame, name: str, keys: Sequence[str], arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run an update-mode stream over what its source has now and after each arrival; the newest row per key.

    Every batch writes its updates into a folder of its own number, so a repeated
    batch replaces itself.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    drain_batches(stream, write, f"{folder}/checkpoint", arrivals, "update")
    updates = spark.read.parquet(f"{folder}/table")
    return newest_per_key(updates, keys, 1, [F.col("batch").desc()]).drop("batch")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  arrivals: Iterable[Callable[[], None]] = (), mode: str = "append") -> None:
    """Give ``handle`` every micro-batch and its number, for what the source has now and after each arrival."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    drain(writer.start, arrivals)
