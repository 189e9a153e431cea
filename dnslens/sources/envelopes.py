"""JSON-lines envelopes, routed by kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens import dims
from dnslens.functions.text import fill, non_empty, strip
from dnslens.operators.normalize import normalize_events, number_lines
from dnslens.operators.sessions import error_messages, status_messages

TEXT_FIELDS = (
    "kind",
    "timestamp",
    "domain",
    "queryName",
    "sourceIp",
    "destinationIp",
    "resolverIp",
    "destinationPort",
    "recordType",
    "type",
    "protocol",
    "transport",
    "rcode",
    "tool",
    "mode",
    "confidence",
    "source",
    "threatLevel",
    "action",
    "status",
    "note",
    "message",
    "ttl",
    "answerCount",
    "threatScore",
)
LIST_FIELDS = ("answers", "threatReasons")
_BAD = "_corrupt_record"

# Scalars are read as text, so a number where a text is usual is no error.
SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in TEXT_FIELDS]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in LIST_FIELDS]
    + [T.StructField(_BAD, T.StringType())]
)


class Envelopes(NamedTuple):
    events: DataFrame
    status: DataFrame
    errors: DataFrame


def parse_envelopes(
    lines: DataFrame, tool: str | None = None, mode: str | None = None, extra: bool = False,
    hold: Callable[[DataFrame], DataFrame] | None = None,
) -> Envelopes:
    """Route lines (``value``, and ``seq`` if numbered) by ``kind``.

    Unreadable lines become error records of kind ``stderr`` (they leave the session
    status alone); lines without a known kind are dropped. ``extra`` keeps unknown
    event keys in a map column. ``hold`` (in batch, such as ``session.written``) keeps the parsed lines, which all kinds
    are taken from; without it every kind parses the lines again.
    """
    keep = [name for name in lines.columns if name != "value"]
    text = lines.withColumn("value", strip(F.col("value"))).filter("value <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = text.withColumn("_j", F.from_json("value", SCHEMA, options))
    parsed = parsed if hold is None else hold(parsed)
    unreadable = F.col("_j").isNull() | F.col(f"_j.{_BAD}").isNotNull()
    good = parsed.filter(~unreadable)

    event_fields = [name for name in (*TEXT_FIELDS, *LIST_FIELDS) if name not in ("status", "note", "message")]
    columns = [f"_j.{name}" for name in event_fields]
    if extra:
        every = F.from_json("value", "map<string,string>")
        columns.append(F.map_filter(every, lambda k, _: ~k.isin(list(SCHEMA.names))).alias("extra"))
    # the event's own tool, before the default is put in: only that one becomes the session's
    events = good.filter(F.col("_j.kind") == "event").select(*keep, *columns, F.col("_j.tool").alias("reported_tool"))
    events = events.withColumns(
        {
            "ttl": F.col("ttl").try_cast("bigint"),
            "answerCount": F.col("answerCount").try_cast("int"),
            "threatScore": F.col("threatScore").try_cast("int"),
        }
    )
    status = good.filter(F.col("_j.kind") == "status").select(*keep, "_j.status", "_j.note", "_j.tool")
    reported = good.filter(F.col("_j.kind") == "error").select(*keep, F.lit("error").alias("kind"), "_j.message")
    broken = parsed.filter(unreadable).select(
        *keep,
        F.lit("stderr").alias("kind"),
        fill(dims.ERROR_UNREADABLE, F.col("value")).alias("message"),
    )
    return Envelopes(
        normalize_events(events, tool, mode),
        status_messages(status),
        error_messages(reported).unionByName(broken),
    )


def read_envelopes(spark: SparkSession, path: str, by_file: bool = False, **options) -> Envelopes:
    """Read envelope files; ``seq`` is the place of the line over all files. ``by_file`` makes each
    file a session, with the file's name before its first dot as ``session_id``."""
    lines = spark.read.text(path)
    if by_file:
        lines = lines.withColumn("session_id", F.substring_index("_metadata.file_name", ".", 1))
    return parse_envelopes(number_lines(lines), **options)


def stream_envelopes(spark: SparkSession, path: str, **options) -> Envelopes:
    """Follow a landing directory of envelope files."""
    return parse_envelopes(spark.readStream.text(path), **options)


def session_messages(envelopes: Envelopes) -> DataFrame:
    """All records of sessions in one frame, as the ledger wants them."""
    missing = {"status": "string", "message": "string", "event_ts": "timestamp", "tool": "string",
               "note": "string", "record_type": "string", "domain": "string"}

    def shaped(df: DataFrame, kind=None) -> DataFrame:
        if kind:
            df = df.withColumn("kind", F.lit(kind))
        for name, dtype in missing.items():
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(dtype))
        session = F.col("session_id") if "session_id" in df.columns else F.lit("session")
        return df.select(
            session.alias("session_id"), "seq", "kind", "event_ts",
            non_empty(F.col("reported_tool" if "reported_tool" in df.columns else "tool")).alias("tool"), "status", "message", "note", "record_type", "domain",
        )

    return (
        shaped(envelopes.events, "event")
        .unionByName(shaped(envelopes.status, "status"))
        .unionByName(shaped(envelopes.errors))
    )
