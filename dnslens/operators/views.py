"""Row projections for tables, the detail panel and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.codes import method_class
from dnslens.functions.text import non_empty
from dnslens.functions.times import iso_millis


def _or(name: str, default: str) -> Column:
    return F.coalesce(non_empty(F.col(name)), F.lit(default))


def table_view(df: DataFrame) -> DataFrame:
    """Ten display columns (and the method class) with their defaults."""
    protocol, transport = _or("protocol", "DNS"), _or("transport", "udp")
    spoofed = F.coalesce(F.col("action") == dims.ACTION_REDIRECTED, F.lit(False))
    return df.select(
        "seq",
        F.col("event_ts").alias("time"),
        _or("domain", "unknown").alias("domain"),
        _or("record_type", "A").alias("type"),
        F.upper(protocol).alias("method"),
        F.when(spoofed, "SPOOFED").otherwise(F.upper(_or("threat_level", "low"))).alias("threat"),
        _or("source_ip", "unknown").alias("client"),
        _or("destination_ip", "unknown").alias("resolver"),
        F.concat(transport, F.lit(" / "), protocol).alias("carrier"),
        _or("tool", "auto").alias("tool"),
        _or("mode", "live").alias("mode"),
        method_class(F.col("protocol"), F.col("transport")).alias("method_class"),
    )


def detail_view(df: DataFrame, event_id: str | None = None) -> DataFrame:
    """The labelled fields of events (of one event, when ``event_id`` is given)."""
    if event_id is not None:
        df = df.filter(F.col("id") == event_id)
    score = F.coalesce("threat_score", F.lit(0))
    return df.select(
        "id",
        _or("domain", "unknown").alias("domain"),
        _or("record_type", "A").alias("record_type"),
        _or("protocol", "DNS").alias("protocol"),
        _or("transport", "udp").alias("transport"),
        _or("rcode", "NOERROR").alias("response_code"),
        _or("source_ip", "unknown").alias("client_ip"),
        _or("destination_ip", "unknown").alias("resolver_ip"),
        _or("destination_port", "53").alias("port"),
        F.coalesce(F.concat(F.col("ttl").cast("string"), F.lit("s")), F.lit("N/A")).alias("ttl"),
        _or("tool", "auto").alias("tool"),
        _or("mode", "live").alias("mode"),
        F.col("event_ts").alias("timestamp"),
        _or("confidence", "observed").alias("confidence"),
        F.concat(score.cast("string"), F.lit("/100")).alias("score_label"),
        F.least(score, F.lit(100)).alias("bar_width"),
        _or("threat_level", "low").alias("threat_level"),
        F.coalesce("threat_reasons", F.array().cast("array<string>")).alias("threat_reasons"),
        F.coalesce("answers", F.array().cast("array<string>")).alias("answers"),
    )


def _time(df: DataFrame) -> Column:
    """Export time; numeric times are epoch seconds."""
    kind = dict(df.dtypes)["event_ts"]
    if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal"):
        return iso_millis(F.timestamp_micros(F.rint(F.col("event_ts") * F.lit(1e6)).cast("bigint")))
    return iso_millis(F.col("event_ts").cast("timestamp"))


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def csv_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 13 CSV columns as text, in header order, and the columns to ``keep``; a TTL of 0 is empty like a missing one."""
    empty = F.array().cast("array<string>")
    return df.select(
        _time(df).alias("Time"),
        _plain("domain").alias("Domain"),
        _plain("record_type").alias("Type"),
        _or("protocol", "DNS/UDP").alias("Method"),
        _or("threat_level", "low").alias("Threat"),
        F.array_join(F.coalesce("threat_reasons", empty), "; ").alias("Threat Reasons"),
        _plain("source_ip").alias("Client"),
        _plain("destination_ip").alias("Resolver"),
        _plain("transport").alias("Transport"),
        F.array_join(F.coalesce("answers", empty), "; ").alias("Answers"),
        F.coalesce(F.nullif("ttl", F.lit(0)).cast("string"), F.lit("")).alias("TTL"),
        _plain("tool").alias("Tool"),
        _plain("mode").alias("Mode"),
        *keep,
    )


def json_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 14 fields of a JSON export record, and the columns to ``keep``; a TTL of 0 is null like a missing one."""
    empty = F.array().cast("array<string>")
    return df.select(
        _time(df).alias("time"),
        _plain("domain").alias("domain"),
        _plain("record_type").alias("type"),
        _or("protocol", "DNS/UDP").alias("method"),
        _or("threat_level", "low").alias("threat"),
        F.coalesce("threat_score", F.lit(0)).alias("threatScore"),
        F.coalesce("threat_reasons", empty).alias("threatReasons"),
        _plain("source_ip").alias("client"),
        _plain("destination_ip").alias("resolver"),
        _plain("transport").alias("transport"),
        F.coalesce("answers", empty).alias("answers"),
        F.nullif("ttl", F.lit(0)).alias("ttl"),
        _plain("tool").alias("tool"),
        _plain("mode").alias("mode"),
        *keep,
    )
