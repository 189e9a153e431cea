"""From decoded fields or payloads to the event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.codes import detect_protocol, lookup, resolve_rcode, resolve_record_type
from dnslens.functions.text import first_non_empty, non_empty, strip
from dnslens.functions.times import iso_micros, parse_iso
from dnslens.operators.threat import score_events
from dnslens.session import broadcast_if_small, written

# Decoded fields of one packet, as sources hand them to ``build_events``.
RAW_COLUMNS = (
    "seq",
    "event_ts",
    "domain",
    "source_ip",
    "destination_ip",
    "qtype_raw",
    "transport",
    "destination_port",
    "rcode_raw",
    "ttl",
    "answers",
    "is_response",
)


def _or(col: Column, default: str) -> Column:
    return F.coalesce(non_empty(col), F.lit(default))


def orient(df: DataFrame) -> DataFrame:
    """Swap the addresses of responses, so the source is the client. Ports stay."""
    response = F.coalesce(F.col("is_response"), F.lit(False))
    source, destination = F.col("source_ip"), F.col("destination_ip")
    return df.withColumns(
        {
            "source_ip": F.when(response, destination).otherwise(source),
            "destination_ip": F.when(response, source).otherwise(destination),
        }
    )


def build_events(
    df: DataFrame, tool: str, mode: str, score: bool = True, max_answers: int | None = dims.MAX_ANSWERS, **scoring
) -> DataFrame:
    """Events from decoded fields (``RAW_COLUMNS``); further columns are dropped, except ``session_id``.

    An event lists its first ``max_answers`` answers (``None``: all); ``answer_count`` counts all of them.
    """
    transport = F.lower(F.col("transport"))
    port = _or(F.col("destination_port").cast("string"), "53")
    answers = F.when(F.size("answers") > 0, F.col("answers"))
    carried = [name for name in ("session_id",) if name in df.columns]
    events = df.select(
        *carried,
        F.col("seq").cast("bigint").alias("seq"),
        F.concat(F.lit("evt-"), F.col("seq").cast("string")).alias("id"),
        F.col("event_ts").cast("timestamp").alias("event_ts"),
        _or(F.col("domain"), "unknown").alias("domain"),
        _or(F.col("source_ip"), "unknown").alias("source_ip"),
        _or(F.col("destination_ip"), "unknown").alias("destination_ip"),
        port.alias("destination_port"),
        resolve_record_type(F.col("qtype_raw")).alias("record_type"),
        detect_protocol(transport, port).alias("protocol"),
        transport.alias("transport"),
        resolve_rcode(F.col("rcode_raw")).alias("rcode"),
        F.lit(tool).alias("tool"),
        F.lit(mode).alias("mode"),
        F.lit(dims.CONFIDENCE).alias("confidence"),
        F.lit(dims.EVENT_SOURCE).alias("source"),
        F.col("ttl").cast("bigint").alias("ttl"),
        (answers if max_answers is None else F.slice(answers, 1, max_answers)).alias("answers"),
        F.when(answers.isNotNull(), F.size(answers)).cast("int").alias("answer_count"),
        F.col("is_response").alias("is_response"),
    )
    return score_events(events, **scoring) if score else events


def _text(df: DataFrame, name: str) -> Column:
    """A payload field as text; null when the payload has no such column."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def normalize_events(df: DataFrame, tool: str | None = None, mode: str | None = None) -> DataFrame:
    """Events from payload records with their original field names.

    Aliases (``queryName``, ``resolverIp``, ``type``) fill in for missing fields;
    ``tool`` and ``mode`` are the session's, used when the record has none. Fields
    not named here are carried through; ``kind`` is dropped.
    """

    def cleaned(default: str, *names: str) -> Column:
        value = first_non_empty(*[_text(df, name) for name in names])
        return _or(strip(F.coalesce(value, F.lit(default))), default)

    known = {
        "domain": cleaned("unknown", "domain", "queryName"),
        "source_ip": cleaned("unknown", "sourceIp"),
        "destination_ip": cleaned("unknown", "destinationIp", "resolverIp"),
        "record_type": F.upper(cleaned("A", "recordType", "type")),
        "protocol": _or(_text(df, "protocol"), "DNS"),
        "transport": F.lower(_or(_text(df, "transport"), "udp")),
        "tool": _or(_text(df, "tool"), tool or "auto"),
        "mode": _or(_text(df, "mode"), mode or "live"),
        "confidence": _or(_text(df, "confidence"), dims.CONFIDENCE),
        "source": _or(_text(df, "source"), dims.EVENT_SOURCE),
        "event_ts": parse_iso(_text(df, "timestamp")),
    }
    renamed = {
        "destinationPort": "destination_port",
        "answerCount": "answer_count",
        "threatScore": "threat_score",
        "threatLevel": "threat_level",
        "threatReasons": "threat_reasons",
    }
    used = {"queryName", "sourceIp", "destinationIp", "resolverIp", "recordType", "type", "timestamp", "kind"}
    extra = []
    for name in df.columns:
        if name in known or name in used:
            continue
        extra.append(F.col(name).alias(renamed.get(name, name)))
    return df.select(*[value.alias(name) for name, value in known.items()], *extra)


def with_event_id(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Add ``id`` (``evt-N``) from the arrival number."""
    return df.withColumn("id", F.concat(F.lit("evt-"), F.col(seq).cast("string")))


def number_lines(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Number the rows of a file source 1, 2, … in file and line order.

    Expects a frame straight from a file reader. The rows are laid down once, with file, block and place in
    the block; totals per block and the numbered rows both come from there, so it does not matter how the
    files would be split later. The running sum over the totals (one small row per block) gives each block's
    first number. No row moves between tasks, except for the join with the small totals.
    """
    return number_placed(
        df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")), seq
    )


def number_placed(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``number_lines`` for rows that carry ``_file`` and ``_block`` already (a stream's micro-batch)."""
    placed = written(df.withColumn("_place", F.monotonically_increasing_id()))
    totals = placed.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    # one row per file block: a window without a partition over these is tolerable (a million of them for 128 TB)
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_file",
        "_block",
        (F.coalesce(F.sum("_rows").over(order), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
    )
    # counted before it is broadcast, so that the lines themselves need no exchange
    numbered = placed.join(broadcast_if_small(starts), ["_file", "_block"])
    return numbered.withColumn(seq, F.col("_place") + F.col("_shift")).drop("_file", "_block", "_place", "_shift")


def packet_metadata(frames: DataFrame) -> DataFrame:
    """Packet report rows from decoded frames.

    Needs ``epoch``, ``source_ip``, ``dest_ip``, ``transport``, ``packet_length``,
    ``dns_id``, ``is_response``, ``domain``, ``qtype`` (number), ``rcode`` (number),
    ``answers`` and ``ttls``; frames without a DNS layer have a null ``dns_id``.
    """
    number = F.coalesce(F.col("qtype"), F.lit(0)).cast("string")
    epoch = F.coalesce(F.col("epoch"), F.lit(0.0)).cast("double")
    moment = F.timestamp_micros(F.rint(epoch * F.lit(1e6)).cast("bigint"))
    response = F.col("is_response")

    def from_response(name: str, kind: str) -> Column:
        return F.coalesce(F.when(response, F.col(name)), F.array().cast(kind))

    return frames.filter(F.col("dns_id").isNotNull()).select(
        F.when(epoch != 0, iso_micros(moment)).otherwise("").alias("iso_time"),
        epoch.alias("timestamp"),
        "source_ip",
        "dest_ip",
        F.upper(F.col("transport")).alias("transport"),
        F.col("packet_length").cast("int").alias("packet_length"),
        F.col("dns_id").cast("int").alias("dns_id"),
        response.alias("is_response"),
        F.coalesce(F.rtrim(F.col("domain"), F.lit(".")), F.lit("")).alias("domain"),
        F.coalesce(lookup(number, dims.PACKET_QTYPES), number).alias("qtype"),
        F.col("rcode").cast("int").alias("rcode"),
        from_response("answers", "array<string>").alias("answers"),
        from_response("ttls", "array<bigint>").alias("ttls"),
    )
