"""Packet capture files as a many-file Spark job.

Three steps: a task per file cuts it into frames (Python, streaming batches); the
link, network and transport headers are peeled and filtered to DNS ports with
binary functions on the JVM; only the DNS messages left go through a small
Arrow-batched decoder.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens import dims
from dnslens.functions.codes import min_ttl
from dnslens.functions.text import clean_domain

FRAME_SCHEMA = "path string, frame_no bigint, epoch double, link_type int, packet_length int, frame binary"
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("dns_id", T.IntegerType()),
        T.StructField("is_response", T.BooleanType()),
        T.StructField("rcode", T.IntegerType()),
        T.StructField("domain", T.StringType()),
        T.StructField("qtype", T.IntegerType()),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("ttls", T.ArrayType(T.LongType())),
    ]
)
# Ports on which plain DNS messages travel.
MESSAGE_PORTS = [53, 5353]
_BATCH = 4096


# --- step 1: files to frames ---------------------------------------------------


def _pcap_frames(data: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    magic = data[:4]
    if len(data) < 24:
        return  # no header, no frames
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1e-9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
    (link,) = struct.unpack_from(order + "I", data, 20)
    at = 24
    while at + 16 <= len(data):
        seconds, fraction, size, length = struct.unpack_from(order + "IIII", data, at)
        at += 16
        yield seconds + fraction * unit, link & 0xFFFF, length, data[at : at + size]
        at += size


def _pcapng_frames(data: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    order, links, at = "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        kind, total = struct.unpack_from(order + "II", data, at)
        if total < 12:
            return
        body = data[at + 8 : at + total - 4]
        if kind == 1:
            link, _, _ = struct.unpack_from(order + "HHI", body, 0)
            resolution, place = 1e-6, 8
            while place + 4 <= len(body):
                code, size = struct.unpack_from(order + "HH", body, place)
                if code == 9 and size == 1:
                    raw = body[place + 4]
                    resolution = 2.0 ** -(raw & 0x7F) if raw & 0x80 else 10.0**-raw
                place += 4 + size + (-size % 4)
            links.append((link, resolution))
        elif kind == 6:
            interface, high, low, size, length = struct.unpack_from(order + "IIIII", body, 0)
            link, resolution = links[interface]
            yield ((high << 32) | low) * resolution, link, length, body[20 : 20 + size]
        elif kind == 2:  # the older packet block
            interface, _, high, low, size, length = struct.unpack_from(order + "HHIIII", body, 0)
            link, resolution = links[interface]
            yield ((high << 32) | low) * resolution, link, length, body[20 : 20 + size]
        elif kind == 3 and links:  # simple packet block: no time
            (length,) = struct.unpack_from(order + "I", body, 0)
            yield 0.0, links[0][0], length, body[4 : 4 + length]
        at += total


def _split_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in FRAME_SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            reader = _pcapng_frames if content[:4] == b"\x0a\x0d\x0d\x0a" else _pcap_frames
            rows: list[tuple] = []
            for number, (epoch, link, length, frame) in enumerate(reader(content), start=1):
                rows.append((path, number, epoch, link, length, frame))
                if len(rows) == _BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_frames(spark: SparkSession, path: str, suffix: str = "*.pcap*") -> DataFrame:
    """Frames of all capture files under ``path`` (one file per task)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return files.select("path", "content").mapInPandas(_split_files, FRAME_SCHEMA)


# --- step 2: headers -------------------------------------------------------------


def _bytes(data: Column, at: Column, size: int) -> Column:
    return F.substring(data, at + 1, F.lit(size))


def _number(data: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(_bytes(data, at, size)), 16, 10).cast("int")


def peel_headers(frames: DataFrame) -> DataFrame:
    """Addresses, ports and the transport payload of IP frames (UDP and TCP)."""
    frame, zero = F.col("frame"), F.lit(0)
    tagged, twice = (_number(frame, F.lit(place), 2).isin(0x8100, 0x88A8) for place in (12, 16))
    start = (
        F.when((F.col("link_type") == 1) & tagged & twice, 22)
        .when((F.col("link_type") == 1) & tagged, 18)
        .when(F.col("link_type") == 1, 14)
        .when(F.col("link_type") == 113, 16)
        .when(F.col("link_type") == 0, 4)
        .when(F.col("link_type").isin(101, 12, 228, 229), 0)
    )
    step = frames.withColumn("_ip", start).withColumn("_first", _number(frame, F.col("_ip"), 1))
    step = step.withColumn("_version", F.shiftright("_first", 4))
    v4, ip = F.col("_version") == 4, F.col("_ip")
    step = step.withColumns(
        {
            "_protocol": F.when(v4, _number(frame, ip + 9, 1)).otherwise(_number(frame, ip + 6, 1)),
            "_port": ip + F.when(v4, F.col("_first").bitwiseAND(15) * 4).otherwise(40),
        }
    )
    tcp, port = F.col("_protocol") == 6, F.col("_port")
    # TCP messages carry a two-byte length in front
    payload = port + F.when(tcp, F.shiftright(_number(frame, port + 12, 1), 4) * 4 + 2).otherwise(8)
    headers = F.struct(
        F.when(tcp, "tcp").otherwise("udp").alias("transport"),
        _number(frame, port + zero, 2).alias("source_port"),
        _number(frame, port + 2, 2).alias("destination_port"),
        F.when(v4, _bytes(frame, ip + 12, 4)).otherwise(_bytes(frame, ip + 8, 16)).alias("_source"),
        F.when(v4, _bytes(frame, ip + 16, 4)).otherwise(_bytes(frame, ip + 24, 16)).alias("_destination"),
        F.substring(frame, payload + 1, F.length(frame)).alias("_message"),
    )
    # later fragments have no ports
    whole = ~v4 | (_number(frame, ip + 6, 2).bitwiseAND(0x1FFF) == 0)
    usable = F.col("_version").isin(4, 6) & F.col("_protocol").isin(6, 17) & whole
    # no row for other frames; later filters work on the peeled values
    return step.select(
        *[name for name in frames.columns if name not in ("frame", "link_type")],
        F.inline(F.when(usable, F.array(headers))),
    )


# --- step 3: messages --------------------------------------------------------------


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and the position after it."""
    labels, end, lowest = [], None, at
    while True:
        size = data[at]
        if size >= 0xC0:
            end = at + 2 if end is None else end
            target = ((size & 0x3F) << 8) | data[at + 1]
            if target >= lowest:  # pointers lead backwards, else the name loops
                raise ValueError("name loops")
            at = lowest = target
            continue
        at += 1
        if size == 0:
            break
        labels.append(data[at : at + size].decode("utf-8", "ignore"))
        at += size
    return ".".join(labels), at if end is None else end


def _record_text(data: bytes, at: int, size: int, kind: int) -> str:
    raw = data[at : at + size]
    if kind == 1 and size == 4 or kind == 28 and size == 16:
        return _address(raw)
    if kind in (2, 5, 12, 39):
        return _name(data, at)[0] + "."
    if kind == 15:
        return _name(data, at + 2)[0] + "."
    if kind == 16:
        texts, place = [], 0
        while place < size:
            texts.append(raw[place + 1 : place + 1 + raw[place]].decode("utf-8", "ignore"))
            place += 1 + raw[place]
        return " ".join(texts)
    return raw.decode("utf-8", "ignore")


def _message(data: bytes) -> tuple | None:
    """The fields of ``MESSAGE_SCHEMA``; null for what is not a DNS message."""
    try:
        number, flags, questions, records = struct.unpack_from("!HHHH", data, 0)
        at, domain, qtype = 12, "", 0
        for index in range(questions):
            name, at = _name(data, at)
            if index == 0:
                domain, (qtype,) = name, struct.unpack_from("!H", data, at)
            at += 4
        answers, ttls = [], []
        response = bool(flags & 0x8000)
        try:
            for _ in range(records if response else 0):
                _, at = _name(data, at)
                kind, _, ttl, size = struct.unpack_from("!HHIH", data, at)
                at += 10
                text = _record_text(data, at, size, kind)
                ttls.append(ttl)
                if text:
                    answers.append(text)
                at += size
        except (struct.error, IndexError, ValueError):
            pass  # cut off: question, header and the answers read so far stay
        return number, response, flags & 15, domain, qtype, answers, ttls
    except (struct.error, IndexError, ValueError):
        return None


def _address(raw: bytes) -> str:
    return socket.inet_ntop(socket.AF_INET if len(raw) == 4 else socket.AF_INET6, bytes(raw))


@F.pandas_udf(MESSAGE_SCHEMA)
def _decode_messages(messages: pd.Series) -> pd.DataFrame:
    names = MESSAGE_SCHEMA.names
    rows = [_message(bytes(data)) or (None,) * len(names) for data in messages]
    return pd.DataFrame(rows, columns=names).astype({"dns_id": "Int32", "rcode": "Int32", "qtype": "Int32"})


@F.pandas_udf(T.StringType())
def _format_addresses(raw: pd.Series) -> pd.Series:
    return raw.map(lambda data: _address(data) if data is not None and len(data) in (4, 16) else None)


def decode_frames(frames: DataFrame, ports: list[int] | None = None) -> DataFrame:
    """Packet records of the frames that carry a DNS message."""
    ports = ports or MESSAGE_PORTS
    peeled = peel_headers(frames)
    dns = peeled.filter(F.col("source_port").isin(ports) | F.col("destination_port").isin(ports))
    # otherwise Spark decodes once more for the filter
    decoded = dns.withColumn("_m", _decode_messages.asNondeterministic()("_message"))
    kept = [name for name in peeled.columns if not name.startswith("_")]
    return decoded.filter(F.col("_m.dns_id").isNotNull()).select(
        *kept,
        _format_addresses("_source").alias("source_ip"),
        _format_addresses("_destination").alias("dest_ip"),
        "_m.*",
    )


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packet records of all capture files under ``path`` (input of ``packet_metadata``)."""
    return decode_frames(read_frames(spark, path))


def capture_fields(packets: DataFrame, max_answers: int | None = dims.MAX_FRAME_ANSWERS) -> DataFrame:
    """Raw records for ``build_events`` from packet records; orient them first if clients shall be the source.

    Packets without a question are dropped. The first ``max_answers`` answers are read (``None``: all).
    """
    response = F.col("is_response")

    def read(name: str) -> Column:
        return F.col(name) if max_answers is None else F.slice(name, 1, max_answers)

    answers = read("answers")
    order = F.col("seq") if "seq" in packets.columns else F.monotonically_increasing_id()
    moment = F.timestamp_micros(F.rint(F.col("epoch") * F.lit(1e6)).cast("bigint"))
    return packets.withColumn("domain", clean_domain(F.col("domain"))).filter(F.col("domain").isNotNull()).select(
        order.alias("seq"),
        moment.alias("event_ts"),
        "domain",
        "source_ip",
        F.col("dest_ip").alias("destination_ip"),
        F.col("qtype").cast("string").alias("qtype_raw"),
        "transport",
        F.col("destination_port").cast("string").alias("destination_port"),
        F.when(response, F.col("rcode").cast("string")).alias("rcode_raw"),
        F.when(response, min_ttl(read("ttls"))).alias("ttl"),
        F.when(response & (F.size(answers) > 0), answers).alias("answers"),
        "is_response",
    )
