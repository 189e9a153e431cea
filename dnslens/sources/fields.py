"""Delimited decoded-packet lines, in batch and as a stream.

One packet per line, 16 fields separated by ``|``, several values inside a field
separated by ``;``, no quoting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.functions.codes import collect_answers, first_ttl, pick_address, pick_port, pick_transport
from dnslens.functions.text import clean_domain, non_empty, rstrip
from dnslens.functions.times import epoch_to_ts
from dnslens.operators.normalize import number_lines

FIELDS = (
    "epoch",
    "source_v4",
    "source_v6",
    "destination_v4",
    "destination_v6",
    "name",
    "qtype",
    "udp_port",
    "tcp_port",
    "rcode",
    "ttl",
    "a",
    "aaaa",
    "cname",
    "mx",
    "txt",
)


def parse_fields(lines: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Raw records from a frame with ``value`` (and ``seq``, if numbered).

    Short lines are padded, extra fields ignored, lines without a name dropped.
    Unreadable times are null unless ``default_ts`` is given.
    """
    keep = [name for name in lines.columns if name != "value"]
    parts = F.split(rstrip(F.col("value")), r"\|", -1)
    split = lines.select(*keep, parts.alias("_parts"))
    fields = split.select(
        *keep,
        *[F.coalesce(F.get("_parts", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(FIELDS)],
    )
    answers = collect_answers(*[F.col(name) for name in ("a", "aaaa", "cname", "mx", "txt")])
    order = [] if "seq" in keep else [F.lit(None).cast("bigint").alias("seq")]
    raw = fields.select(
        *keep,
        *order,
        epoch_to_ts(F.col("epoch"), default_ts).alias("event_ts"),
        clean_domain(F.col("name")).alias("domain"),
        pick_address(F.col("source_v4"), F.col("source_v6")).alias("source_ip"),
        pick_address(F.col("destination_v4"), F.col("destination_v6")).alias("destination_ip"),
        F.coalesce(non_empty(F.col("qtype")), F.lit("A")).alias("qtype_raw"),
        pick_transport(F.col("tcp_port")).alias("transport"),
        pick_port(F.col("tcp_port"), F.col("udp_port")).alias("destination_port"),
        non_empty(F.col("rcode")).alias("rcode_raw"),
        first_ttl(F.col("ttl")).alias("ttl"),
        answers.alias("answers"),
        F.lit(None).cast("boolean").alias("is_response"),
    )
    return raw.filter(F.col("domain").isNotNull())


def read_fields(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Read field files. ``numbered`` adds ``seq``, the place of the line over all files."""
    lines = spark.read.text(path)
    return parse_fields(number_lines(lines) if numbered else lines)


def stream_fields(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Follow a landing directory of field files."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_fields(reader.text(path))
