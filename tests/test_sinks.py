from __future__ import annotations

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from dnslens.operators.normalize import packet_metadata
from dnslens.operators.summary import summary_record
from dnslens.plans import derived
from dnslens.plans import tables as t
from dnslens.sinks import exports, ledger, packets, store
from dnslens.sources.sessions import read_sessions

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return t.events(spark, FOLDER).filter("seq < 60").cache()


def content(path):
    return "".join(open(name, encoding="utf8").read() for name in sorted(glob.glob(f"{path}/part-*")))


def test_csv(events, tmp_path):
    path = str(tmp_path / "csv")
    odd = events.withColumn("tool", F.when(F.col("seq") == 3, F.lit('say "hi", ok')).otherwise(F.col("tool")))
    assert exports.export_csv(odd, path)
    text = content(path)
    assert text.startswith("Time,Domain,Type,Method,Threat,Threat Reasons,Client,Resolver,Transport,Answers,TTL,Tool,Mode\n")
    rows = list(csv.DictReader(io.StringIO(text)))
    assert len(rows) == 60 and rows[60 - 4]["Tool"] == 'say "hi", ok'
    assert [r["Time"] for r in rows] == sorted((r["Time"] for r in rows), reverse=True)
    assert not exports.export_csv(events.filter("seq > 99"), str(tmp_path / "none"))
    assert not glob.glob(str(tmp_path / "none"))


def test_json(events, tmp_path):
    path = str(tmp_path / "json")
    assert exports.export_json(events, path, {"search": "x"}, summary_record(events))
    rows = [json.loads(line) for line in content(path + "/events").splitlines()]
    assert len(rows) == 60 and list(rows[0]) == [
        "time", "domain", "type", "method", "threat", "threatScore", "threatReasons", "client", "resolver", "transport", "answers", "ttl", "tool", "mode"]
    assert rows[0]["ttl"] is None or rows[0]["ttl"] > 0
    meta = json.loads(content(path + "/metadata"))
    assert meta["eventCount"] == 60 and meta["filters"] == {"search": "x", "field": "", "target": ""}
    assert meta["sessionSummary"]["total_events"] == 60 and len(meta["sessionSummary"]["top_domains"]) == 8


def test_packet_files(spark, tmp_path):
    frames = derived.frames(t.raw(spark, FOLDER)).filter("seq < 40")
    report = packet_metadata(frames)
    assert packets.export_packets_csv(report, str(tmp_path / "csv"))
    body = content(str(tmp_path / "csv"))
    rows = [r for r in csv.DictReader(io.StringIO(body)) if r["iso_time"] != "iso_time"]
    assert len(rows) == report.count() and {r["is_response"] for r in rows} <= {"True", "False"}
    assert all("E" not in r["timestamp"] for r in rows)
    assert not packets.export_packets_csv(report.filter("dns_id < 0"), str(tmp_path / "none"))
    packets.export_packets_json(report, frames, str(tmp_path / "json"))
    meta = json.loads(content(str(tmp_path / "json/metadata")))
    assert (meta["packet_count"], meta["dns_event_count"]) == (40, len(rows))


def test_store_appends(spark, events, tmp_path):
    path = str(tmp_path / "store")
    store.write_events(events, path)
    store.write_events(events, path)
    back = store.read_events(spark, path)
    assert back.count() == 120
    plan = back.filter("event_date = date'2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_sessions(spark, path).count() == 0

    def session(i):
        return (f"session-{i:03d}", "completed", i)

    def frame(ids):
        df = spark.createDataFrame([session(i) for i in ids], "id string, status string, s int")
        return df.select("id", "status", F.timestamp_seconds("s").alias("ended_at"), F.array(F.lit("e")).alias("errors"))

    ledger.append_sessions(frame(range(40)), path)
    ledger.append_sessions(frame(range(40, 60)), path)
    rows = read_sessions(spark, path).collect()
    assert [r.id for r in rows] == [f"session-{i:03d}" for i in range(59, 9, -1)]
    assert rows[0].errors == ["e"]
    assert isinstance(json.loads(content(path)), list)
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.json").write_text('[{"id": ')
    assert read_sessions(spark, str(bad)).count() == 0
