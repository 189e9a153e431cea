from __future__ import annotations

import json
import socket
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dnslens.operators.normalize import build_events, normalize_events, number_lines, orient, packet_metadata, with_event_id
from dnslens.sources import captures, envelopes, fields
from dnslens.sources.scans import scan_events
from dnslens.streaming.arrival import numbered_batches

LINES = [
    "1700000000.25|192.168.1.25||1.1.1.1||google.com.|1|53||0|300;60|142.250.1.1;142.250.1.2|||| ",
    "1700000001.5||2001:db8::25||2606:4700:4700::1111|goog1e.com|28||853|3||||||",
    "1700000002|10.0.0.1||1.1.1.1|||1|53||||||||",
    "bad-epoch|10.0.0.1||1.1.1.1||short.example.org|16",
    "1700000003|10.0.0.1||1.1.1.1||many.example|1|53||0|x|" + ";".join(f"10.0.0.{i}" for i in range(12)) + "|::1||;mx.example;|txt one|ignored|more",
]


def test_field_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES) + "\n")
    raw = fields.read_fields(spark, str(tmp_path))
    rows = {r.seq: r for r in build_events(raw, "tshark", "manual").collect()}
    assert sorted(rows) == [1, 2, 4, 5]
    one, two, four, five = rows[1], rows[2], rows[4], rows[5]
    assert (one.domain, one.ttl, one.answers, one.answer_count) == ("google.com", 300, ["142.250.1.1", "142.250.1.2"], 2)
    assert (one.record_type, one.rcode, one.protocol, one.id) == ("A", "NOERROR", "DNS", "evt-1")
    assert (two.source_ip, two.transport, two.protocol, two.rcode, two.record_type) == ("2001:db8::25", "tcp", "DoT", "NXDOMAIN", "AAAA")
    assert (four.event_ts, four.destination_port, four.rcode, four.record_type, four.answers) == (None, "53", "NOERROR", "TXT", None)
    assert five.ttl is None and len(five.answers) == 10 and five.answer_count == 15
    assert five.threat_level in ("low", "medium", "high")


def test_numbering_over_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(40)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50b")
    try:
        rows = number_lines(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in sorted(rows, key=lambda r: r.seq)] == [f"{n}{i}" for n in "abc" for i in range(40)]
    assert sorted(r.seq for r in rows) == list(range(1, 121))


@pytest.mark.parametrize("before, after", [("64k", "1k"), ("2k", "128m"), ("1k", "3k")])
def test_numbering_survives_other_splits(spark, tmp_path, before, after):
    """The files are split otherwise once their blocks have been counted, as when executors come or go."""
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    try:
        numbered = number_lines(spark.read.text(str(tmp_path)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", after)
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        rows = sorted((r.seq, r.value) for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert rows == [(k + 1, x) for k, x in enumerate([*(f"a{i}" for i in range(3000)), *(f"b{i}" for i in range(500))])]


def test_arrival_numbers_of_repeated_batches(spark, tmp_path):
    """Totals are read from the batch before; a repeated batch gets its numbers again, a lost total fails."""
    seen: dict[int, list] = {}
    step = numbered_batches(lambda batch, number: seen.__setitem__(number, sorted((r.seq, r.value) for r in batch.collect())), f"{tmp_path}/counts")
    batches = []
    for k in range(3):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "x.txt").write_text("".join(f"{k}-{i}\n" for i in range(k * 5)))  # the first has no line
        lines = spark.read.text(f"{tmp_path}/in{k}")
        batches.append(lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")))
    for k in (0, 1, 2, 2):
        step(batches[k], k)
    assert seen == {0: [], 1: [(i + 1, f"1-{i}") for i in range(5)], 2: [(i + 6, f"2-{i}") for i in range(10)]}
    with pytest.raises(AnalysisException):
        step(batches[2], 5)


def test_envelopes_by_file(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"kind": "status", "status": "running", "note": f" of {name} "}) + "\n")
    read = envelopes.read_envelopes(spark, str(tmp_path), by_file=True)
    messages = envelopes.session_messages(read)
    assert {(r.session_id, r.kind, r.note) for r in messages.collect()} == {("one", "status", "of one"), ("two", "status", "of two")}


def test_envelopes(spark, tmp_path):
    lines = [
        json.dumps({"kind": "event", "queryName": "a.example", "type": "txt", "destinationPort": 53, "ttl": 7, "answers": ["x"], "vendor": "v"}),
        json.dumps({"kind": "status", "note": " hello ", "tool": "scapy"}),
        json.dumps({"kind": "error", "message": ""}),
        json.dumps({"domain": "no.kind"}),
        json.dumps({"kind": "other"}),
        '{"kind": "event", "domain": "cut',
        "   ",
        json.dumps({"kind": "event", "domain": "  ", "queryName": "late.example", "timestamp": "2024-01-01T00:00:00Z", "transport": "TCP"}),
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    got = envelopes.read_envelopes(spark, str(tmp_path), tool="tshark", mode="manual", extra=True)
    events = {r.seq: r for r in with_event_id(got.events).collect()}
    assert sorted(events) == [1, 8]
    first = events[1]
    assert (first.domain, first.record_type, first.tool, first.mode, first.ttl, first.answers) == ("a.example", "TXT", "tshark", "manual", 7, ["x"])
    assert (first.destination_port, first.extra, first.id, first.event_ts) == ("53", {"vendor": "v"}, "evt-1", None)
    assert events[8].domain == "unknown" and events[8].transport == "tcp" and events[8].event_ts is not None
    assert "kind" not in got.events.columns
    assert [tuple(r) for r in got.status.select("status", "note", "tool").collect()] == [("running", "hello", "scapy")]
    errors = {r.seq: (r.kind, r.message) for r in got.errors.collect()}
    assert errors == {3: ("error", "Unknown capture error"), 6: ("stderr", 'Unreadable monitor payload: {"kind": "event", "domain": "cut')}
    messages = envelopes.session_messages(got)
    assert sorted(r.kind for r in messages.collect()) == ["error", "event", "event", "status", "stderr"]


def test_payload_defaults(spark):
    df = spark.createDataFrame([("event", None, "")], "kind string, domain string, queryName string")
    row = normalize_events(df).first()
    assert (row.domain, row.source_ip, row.destination_ip, row.record_type) == ("unknown", "unknown", "unknown", "A")
    assert (row.protocol, row.transport, row.tool, row.mode, row.confidence, row.source) == ("DNS", "udp", "auto", "live", "observed", "python-monitor")


def test_scan_events(spark):
    df = spark.createDataFrame(
        [(1, None, "10.0.0.1", "10.0.0.2", 53, 0x12), (2, None, "10.0.0.1", "10.0.0.2", 853, 0x12), (3, None, "10.0.0.1", "10.0.0.2", 443, 0x14)],
        "seq bigint, event_ts timestamp, source_ip string, destination_ip string, port int, flags int",
    )
    rows = scan_events(df).orderBy("seq").collect()
    assert [(r.domain, r.record_type, r.protocol, r.answers, r.mode) for r in rows] == [
        ("scan-53", "SCAN", "DNS/TCP", ["Open DNS/TCP port"], "scan"), ("scan-853", "SCAN", "DoT", ["Open DoT port"], "scan")]


# --- capture files ------------------------------------------------------------------


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".") if p) + b"\0"


def message(number, flags, question, qtype, records=()):
    body = struct.pack("!HHHHHH", number, flags, 1, len(records), 0, 0) + name(question) + struct.pack("!HH", qtype, 1)
    for kind, ttl, data in records:
        body += b"\xc0\x0c" + struct.pack("!HHIH", kind, 1, ttl, len(data)) + data
    return body


def packet(data, source, destination, sport, dport, tcp=False, vlan=False):
    if tcp:
        segment = struct.pack("!HHIIBBHHH", sport, dport, 1, 1, 0x50, 0x18, 1024, 0, 0) + struct.pack("!H", len(data)) + data
    else:
        segment = struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data
    kind = 6 if tcp else 17
    ethernet = b"\2" * 12 + (b"\x81\0\0\5" if vlan else b"")
    if ":" in source:
        head = struct.pack("!IHBB", 0x60000000, len(segment), kind, 64)
        head += socket.inet_pton(socket.AF_INET6, source) + socket.inet_pton(socket.AF_INET6, destination)
        return ethernet + b"\x86\xdd" + head + segment
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(segment), 0, 0, 64, kind, 0)
    return ethernet + b"\x08\0" + head + socket.inet_aton(source) + socket.inet_aton(destination) + segment


TXT = bytes([3]) + b"v=1" + bytes([2]) + b"ok"
MX = struct.pack("!H", 10) + b"\4mail\xc0\x0c"
FRAMES = [
    (1700000000.25, packet(message(1, 0x0100, "a.example", 1), "10.0.0.1", "1.1.1.1", 40000, 53)),
    (1700000000.5, packet(message(1, 0x8180, "a.example", 1, [(1, 300, b"\x01\x02\x03\x04"), (5, 60, b"\3www\xc0\x0c")]), "1.1.1.1", "10.0.0.1", 53, 40000, vlan=True)),
    (1700000001.0, packet(message(2, 0x8183, "no.example", 28), "2606:4700:4700::1111", "2001:db8::25", 53, 40001)),
    (1700000002.0, packet(message(3, 0x8180, "t.example", 16, [(16, 5, TXT), (15, 7, MX)]), "1.1.1.1", "10.0.0.1", 53, 40000, tcp=True)),
    (1700000003.0, packet(b"\x16\x03\x01", "10.0.0.1", "1.1.1.1", 40000, 443)),
    (1700000004.0, packet(b"\0\1", "10.0.0.1", "1.1.1.1", 40000, 53)),
    (1700000005.0, b"\2" * 12 + b"\x08\x06" + b"\0" * 28),
    (1700000006.0, packet(message(4, 0x0100, ".", 2), "10.0.0.1", "1.1.1.1", 40000, 53)),
]


def pcap(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for epoch, data in frames:
        out += struct.pack("<IIII", int(epoch), round(epoch % 1 * 1e6), len(data), len(data)) + data
    return out


def pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 6) + struct.pack("<HH", 0, 0))
    for epoch, data in frames:
        ticks = round(epoch * 1e6)
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    (folder / "one.pcap").write_bytes(pcap(FRAMES))
    (folder / "two.pcapng").write_bytes(pcapng(FRAMES))
    (folder / "notes.txt").write_text("not a capture")
    return captures.read_captures(spark, str(folder))


def test_captures(packets):
    rows = sorted(packets.collect(), key=lambda r: (r.path, r.frame_no))
    assert [r.frame_no for r in rows] == [1, 2, 3, 4, 8] * 2
    drop = [tuple(v for k, v in r.asDict().items() if k != "path") for r in rows]
    assert str(drop[:5]) == str(drop[5:])
    query, reply, missing, text, root = rows[:5]
    assert (query.epoch, query.source_ip, query.dest_ip, query.is_response, query.domain, query.qtype) == (1700000000.25, "10.0.0.1", "1.1.1.1", False, "a.example", 1)
    assert (reply.answers, reply.ttls, reply.rcode) == (["1.2.3.4", "www.a.example."], [300, 60], 0)
    assert (missing.source_ip, missing.dest_ip, missing.rcode, missing.answers) == ("2606:4700:4700::1111", "2001:db8::25", 3, [])
    assert (text.transport, text.answers) == ("tcp", ["v=1 ok", "mail.t.example."])
    assert root.domain == ""


def test_capture_events(packets):
    only = packets.filter(F.endswith("path", F.lit("one.pcap"))).withColumn("seq", F.col("frame_no"))
    swapped = build_events(orient(captures.capture_fields(only)), "scapy", "manual")
    rows = {r.seq: r for r in swapped.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[2].source_ip, rows[2].destination_ip, rows[2].destination_port, rows[2].ttl) == ("10.0.0.1", "1.1.1.1", "40000", 60)
    assert (rows[1].rcode, rows[3].rcode, rows[3].record_type) == ("NOERROR", "NXDOMAIN", "AAAA")
    assert rows[1].protocol == "DNS" and rows[4].protocol == "DNS"


def test_packet_report(packets):
    rows = packet_metadata(packets).filter("transport = 'TCP' or qtype = 'NS'").collect()
    assert {(r.iso_time, r.domain, r.qtype, r.is_response) for r in rows} == {
        ("2023-11-14T22:13:22+00:00", "t.example", "TXT", True), ("2023-11-14T22:13:26+00:00", "", "NS", False)}


def test_captures_with_damage(spark, tmp_path):
    cut = message(5, 0x8180, "cut.example", 1, [(1, 30, b"\x01\x02\x03\x04"), (1, 40, b"\x05\x06\x07\x08")])[:-6]
    # 71 labels, each before a pointer to the one written earlier
    places, names = [12], b"\1a\0"
    for _ in range(70):
        places.append(12 + len(names))
        names += b"\1b" + struct.pack("!H", 0xC000 | places[-2])
    assert captures._name(b"\0" * 12 + names, places[-1])[0].count(".") == 70
    assert captures._message(cut)[3:6] == ("cut.example", 1, ["1.2.3.4"])
    with pytest.raises(ValueError):
        captures._name(b"\xc0\x00", 0)
    double = packet(message(8, 0x0100, "vlan.example", 1), "10.0.0.1", "1.1.1.1", 40000, 53, vlan=True)
    double = double[:12] + b"\x88\xa8\0\7" + double[12:]
    late = bytearray(packet(message(9, 0x0100, "late.example", 1), "10.0.0.1", "1.1.1.1", 40000, 53))
    late[14 + 7] = 5  # a later fragment
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "odd.pcap").write_bytes(pcap([(1.0, double), (2.0, bytes(late))]))
    simple = packet(message(10, 0x0100, "simple.example", 1), "10.0.0.1", "1.1.1.1", 40000, 53)
    body = struct.pack("<I", len(simple)) + simple + b"\0" * (-len(simple) % 4)
    size = struct.pack("<I", len(body) + 12)
    (tmp_path / "simple.pcapng").write_bytes(pcapng([]) + struct.pack("<I", 3) + size + body + size)
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert sorted((r.dns_id, r.domain) for r in rows) == [(8, "vlan.example"), (10, "simple.example")]


def test_envelope_lines_are_parsed_once(spark):
    """With ``hold`` all kinds come from the laid-down lines; the messages are the same."""
    from dnslens.session import written
    from dnslens.sources.envelopes import parse_envelopes, session_messages

    texts = ['{"kind": "event", "domain": "a.example", "type": "A", "ttl": 5}', '{"kind": "event", "domain": "cut-',
             '{"kind": "status", "status": "running", "note": " n "}', '{"kind": "error", "message": ""}', '{"kind": "other"}', " ", None]
    lines = spark.createDataFrame([("s", i, text) for i, text in enumerate(texts * 2)], "session_id string, seq bigint, value string")
    once, plain = session_messages(parse_envelopes(lines, hold=written)), session_messages(parse_envelopes(lines))
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect())) and once.count() == 8
    assert "from_json" in str(plain._jdf.queryExecution().optimizedPlan())
    assert "from_json" not in str(once._jdf.queryExecution().optimizedPlan())


def test_events_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Tasks grow in number, not in size: a table in one row group is laid down in parts of bounded size, and lands so."""
    from dnslens.plans import tables
    from dnslens.streaming import run

    assert tables.task_count(100, 8) == 8 and tables.task_count(36_000_001, 12) == 145
    given = spark.range(1000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' AS ts", "id AS user_id", "'view' AS event_type",
                                         "2D AS value", "'' AS props").toPandas()
    given.to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    dealt = tables.raw_dealt(spark, str(tmp_path))
    assert len(dealt.inputFiles()) == 10 and dealt.count() == dealt.select("seq").distinct().count() == 1000
    assert "Repartition 10" in tables.raw_stream(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(run, "LANDING_ROWS", 50)
    path, later = run.landings(spark, dealt, dealt["seq"])
    assert len(spark.read.parquet(f"{path}/part=0").inputFiles()) == 5 and len(later) == 3
