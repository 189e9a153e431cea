"""Arrival numbers for streams of lines: one sequence over all micro-batches, the same on a retry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.operators.normalize import number_placed
from dnslens.streaming.run import drain_batches, new_folder


def follow_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the text lines of a folder and its subfolders that knows each line's file and block."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered_batches(handle: Callable[[DataFrame, int], None], counts: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives ``handle`` each batch of ``follow_lines`` with ``seq``.

    Lines are numbered in file and line order within a batch, on top of the lines of all batches before.
    Their total after each batch is kept under ``counts``, in a folder of the batch's number, so a batch reads
    one row, and a repeated batch gets the same numbers again. If the row of the batch before is gone the
    batch fails: numbers would be given twice.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("total bigint").parquet(f"{counts}/batch={number - 1}").first()["total"] if number else 0
        numbered = number_placed(batch).withColumn("seq", F.col("seq") + F.lit(before))
        handle(numbered, number)
        total = numbered.agg(F.coalesce(F.max("seq"), F.lit(before)).cast("bigint").alias("total"))
        total.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return step


def drain_numbered(lines: DataFrame, build: Callable[[DataFrame], DataFrame], name: str,
                   arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run a stream of ``follow_lines`` over what its source has now and after each arrival: ``build`` of each numbered batch, as one table."""
    spark = lines.sparkSession
    folder = new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    drain_batches(lines, numbered_batches(write, f"{folder}/counts"), f"{folder}/checkpoint", arrivals)
    return spark.read.parquet(f"{folder}/table").drop("batch")
