"""Inputs in the sources' own formats, derived from the ``events`` table by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def field_lines(raw: DataFrame) -> DataFrame:
    """Delimited field lines: ``(seq, value)``. Every seventh time is unreadable."""
    v6 = F.contains(F.col("destination_ip"), F.lit(":"))
    tcp = F.col("transport") == "tcp"
    epoch = (F.unix_micros("event_ts") / F.lit(1e6)).cast("decimal(20,6)").cast("string")
    return raw.select(
        "seq",
        F.concat_ws(
            "|",
            F.when(F.col("seq") % 7 == 6, "bad-epoch").otherwise(epoch),
            F.col("source_ip"),
            F.lit(""),
            F.when(v6, "").otherwise(F.col("destination_ip")),
            F.when(v6, F.col("destination_ip")).otherwise(""),
            F.coalesce(F.concat("domain", F.lit(".")), F.lit("")),
            _digits(F.col("qtype_raw")),
            F.when(tcp, "").otherwise(F.col("destination_port")),
            F.when(tcp, F.col("destination_port")).otherwise(""),
            _digits(F.col("rcode_raw")),
            F.coalesce(F.concat(F.col("ttl").cast("string"), F.lit(";60")), F.lit("")),
            F.coalesce("answers_raw", F.lit("")),
            F.lit(""),
            F.when(F.col("seq") % 3 == 0, F.lit("alias.example.net;")).otherwise(""),
        ).alias("value"),
    )


def payloads(raw: DataFrame) -> DataFrame:
    """Event payloads with their original field names; aliases and blanks take turns."""
    turn = F.col("seq") % 5
    return raw.select(
        "session_id",
        "seq",
        F.lit("event").alias("kind"),
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(turn == 0, F.lit("")).when(turn == 1, F.lit("  ")).otherwise(F.col("domain")).alias("domain"),
        F.col("domain").alias("queryName"),
        F.concat(F.lit(" "), F.col("source_ip")).alias("sourceIp"),
        F.when(turn == 2, F.col("destination_ip")).alias("destinationIp"),
        F.col("destination_ip").alias("resolverIp"),
        F.col("qtype_raw").alias("type"),
        F.upper("transport").alias("transport"),
        F.when(turn == 3, F.lit("scapy")).alias("tool"),
        F.col("rcode_raw").alias("rcode"),
        "ttl",
    )


def envelope_lines(raw: DataFrame) -> DataFrame:
    """JSON lines of all kinds, some cut off, without kind or with an unknown one: ``(session_id, seq, value)``."""
    record = payloads(raw)
    event = F.to_json(F.struct(*[F.col(name) for name in record.columns if name not in ("session_id", "seq")]))
    number = F.col("seq").cast("string")
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("running", " completed ", "", "stopping", "interrupted")]),
        (F.col("seq") % 5 + 1).cast("int"),
    )
    status = F.to_json(
        F.struct(F.lit("status").alias("kind"), state.alias("status"), F.concat(F.lit(" note "), number).alias("note"))
    )
    error = F.to_json(F.struct(F.lit("error").alias("kind"), F.concat(F.lit(" failure "), number).alias("message")))
    empty_error = F.to_json(F.struct(F.lit("error").alias("kind"), F.lit("").alias("message")))
    turn = F.col("seq") % 11
    value = (
        F.when(turn == 3, status)
        .when(turn == 5, error)
        .when(turn == 6, empty_error)
        .when(turn == 7, F.concat(F.lit('{"kind": "event", "domain": "cut-'), number))
        .when(turn == 8, F.lit('{"domain": "no-kind.example.org"}'))
        .when(turn == 9, F.lit('{"kind": "other", "domain": "x.example.org"}'))
        .otherwise(event)
    )
    return record.select("session_id", "seq", value.alias("value"))


def session_messages(raw: DataFrame) -> DataFrame:
    """Session records of all kinds: ``(session_id, seq, kind, event_ts, tool, status, message)``."""
    turn = F.col("seq") % 13
    kind = (
        F.when(turn == 4, "error").when(turn == 5, "stderr").when(turn.isin(6, 7, 8), "status").otherwise("event")
    )
    stop = (F.col("user_id") % 8 > 3) & (F.col("seq") % 97 == 3)
    states = F.array(*[F.lit(s) for s in ("running", "completed", "stopping", "starting", "interrupted")])
    return raw.select(
        "session_id",
        "seq",
        F.when(stop, "stop").otherwise(kind).alias("kind"),
        "event_ts",
        F.when(F.col("seq") % 3 == 0, "tshark").when(F.col("seq") % 3 == 1, "scapy").alias("tool"),
        F.element_at(states, (F.col("seq") % 5 + 1).cast("int")).alias("status"),
        F.concat(F.lit("failure "), F.col("seq").cast("string")).alias("message"),
    )


def session_ends(messages: DataFrame) -> DataFrame:
    """An exit code per session, except for the last one, which still runs."""
    number = F.substring_index("session_id", "-", -1).cast("int")
    return messages.select("session_id").distinct().select("session_id", (number % 3).alias("exit_code")).filter(number < 7)


def session_closings(messages: DataFrame) -> DataFrame:
    """``session_ends`` with the time of the session's last event as its end."""
    last = messages.groupBy("session_id").agg(F.max("event_ts").alias("ended_at"))
    return session_ends(messages).join(last, "session_id")


def activities(raw: DataFrame) -> DataFrame:
    """Activity entries with repeats: ``(session_id, seq, event_ts, level, message)``."""
    return raw.select(
        "session_id",
        "seq",
        "event_ts",
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("seen "), "event_type")).alias("message"),
    )


def stored_sessions(raw: DataFrame) -> DataFrame:
    """One stored session per user."""
    return raw.groupBy("user_id").agg(
        F.min("event_ts").alias("started_at"),
        F.max("event_ts").alias("ended_at"),
        F.count("*").alias("events_seen"),
    ).select(
        F.concat(F.lit("session-"), F.unix_millis("started_at").cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("user_id") % 3 == 0, "stopped").otherwise("completed").alias("status"),
        F.when(F.col("user_id") % 2 == 0, "manual").alias("mode"),
        "started_at",
        "ended_at",
        "events_seen",
    )


def frames(raw: DataFrame) -> DataFrame:
    """Decoded packet records as the capture reader gives them; signups carry no DNS layer."""
    dns = F.col("event_type") != "signup"
    answers = F.coalesce("answers", F.array().cast("array<string>"))
    return raw.select(
        "seq",
        (F.unix_micros("event_ts") / F.lit(1e6)).alias("epoch"),
        "source_ip",
        F.col("destination_ip").alias("dest_ip"),
        "transport",
        (F.lit(40000) + F.col("seq") % 1000).cast("int").alias("source_port"),
        F.col("destination_port").cast("int").alias("destination_port"),
        (F.lit(60) + F.col("seq") % 400).cast("int").alias("packet_length"),
        F.when(dns, (F.col("seq") % 65536).cast("int")).alias("dns_id"),
        F.when(dns, F.col("is_response")).alias("is_response"),
        F.when(dns, F.concat("domain", F.lit("."))).alias("domain"),
        F.when(dns, F.col("qtype_raw").try_cast("int")).alias("qtype"),
        F.when(dns, F.coalesce(F.col("rcode_raw"), F.lit("0")).cast("int")).alias("rcode"),
        answers.alias("answers"),
        F.transform(answers, lambda _: F.col("ttl")).alias("ttls"),
    )


def scan_replies(raw: DataFrame) -> DataFrame:
    """Port-scan replies; half of them accept."""
    ports = F.array(F.lit(53), F.lit(443), F.lit(853))
    return raw.select(
        "seq",
        "event_ts",
        "source_ip",
        "destination_ip",
        F.element_at(ports, (F.col("seq") % 3 + 1).cast("int")).alias("port"),
        F.when(F.col("user_id") % 2 == 0, 0x12).otherwise(0x14).alias("flags"),
    )


def _byte(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2, "0"))


def _short(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 4, "0"))


def _octets(address: Column) -> Column:
    parts = F.transform(F.split(address, "[.]"), lambda part: F.lpad(F.hex(part.cast("int")), 2, "0"))
    return F.unhex(F.array_join(parts, ""))


def wire_frames(raw: DataFrame) -> DataFrame:
    """Ethernet frames with one DNS message each, as a capture file would hold them.

    IPv4 (or IPv6, as the resolver is) over UDP or TCP port 53, one question, and the
    answers as compressed A records. A missing name is the root.
    """
    v6 = F.contains(F.col("destination_ip"), F.lit(":"))
    tcp = F.col("transport") == "tcp"
    labels = F.transform(
        F.split("domain", "[.]"), lambda label: F.concat(F.lpad(F.hex(F.length(label)), 2, "0"), F.hex(label))
    )
    question = F.concat(F.unhex(F.coalesce(F.array_join(labels, ""), F.lit(""))), F.unhex(F.lit("00")), F.unhex(F.lit("00010001")))
    answers = F.coalesce("answers", F.array().cast("array<string>"))
    ttl = F.lpad(F.hex(F.coalesce("ttl", F.lit(0))), 8, "0")
    records = F.transform(
        answers,
        lambda address: F.concat(
            F.lit("C00C00010001"), ttl, F.lit("0004"),
            F.array_join(
                F.transform(F.split(address, "[.]"), lambda part: F.lpad(F.hex(part.cast("int")), 2, "0")), ""
            ),
        ),
    )
    flags = F.when(F.col("is_response"), F.lit(0x8180)).otherwise(F.lit(0x0100))
    rcode = F.coalesce(F.col("rcode_raw").cast("int"), F.lit(0))
    message = F.concat(
        _short(F.col("seq") % 65536),
        _short(flags + F.when(F.col("is_response"), rcode).otherwise(0)),
        F.unhex(F.lit("0001")),
        _short(F.size(answers)),
        F.unhex(F.lit("00000000")),
        question,
        F.unhex(F.array_join(records, "")),
    )
    built = raw.withColumn("_message", message)
    segment = F.when(
        tcp,
        F.concat(
            F.unhex(F.lit("C350" + "0035" + "00000001" + "00000001" + "5018" + "2000" + "00000000")),
            _short(F.length("_message")),
            F.col("_message"),
        ),
    ).otherwise(
        F.concat(F.unhex(F.lit("C3500035")), _short(F.length("_message") + 8), F.unhex(F.lit("0000")), F.col("_message"))
    )
    built = built.withColumn("_segment", segment)
    ethernet = F.lit("020000000001020000000002")
    protocol = _byte(F.when(tcp, 6).otherwise(17))
    packet4 = F.concat(
        F.unhex(F.concat(ethernet, F.lit("0800" + "4500"))),
        _short(F.length("_segment") + 20),
        F.unhex(F.lit("00004000" + "40")),
        protocol,
        F.unhex(F.lit("0000")),
        _octets(F.col("source_ip")),
        _octets(F.col("destination_ip")),
        F.col("_segment"),
    )
    packet6 = F.concat(
        F.unhex(F.concat(ethernet, F.lit("86DD" + "60000000"))),
        _short(F.length("_segment")),
        protocol,
        F.unhex(F.lit("40" + "20010DB8000000000000000000000025" + "26064700470000000000000000001111")),
        F.col("_segment"),
    )
    packet = F.when(v6, packet6).otherwise(packet4)
    return built.select(
        "seq",
        (F.unix_micros("event_ts") / F.lit(1e6)).alias("epoch"),
        F.lit(1).alias("link_type"),
        F.length(packet).alias("packet_length"),
        packet.alias("frame"),
    )
