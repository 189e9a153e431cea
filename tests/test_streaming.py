from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dnslens.operators import alerts as al
from dnslens.operators import sessions
from dnslens.operators.normalize import build_events
from dnslens.operators.summary import breakdowns
from dnslens.plans import derived
from dnslens.plans import tables as t
from dnslens.sinks import store
from dnslens.sinks.keyed import KeyedTable
from dnslens.sources import envelopes, fields
from dnslens.streaming import events as streams
from dnslens.streaming.partials import drain_partials
from dnslens.streaming.run import drain_append, drain_update, landings

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """Raw records in several files that land in time order, for several micro-batches."""
    path = str(tmp_path_factory.mktemp("landing") / "raw")
    for start in range(0, 1000, 250):
        part = t.raw(spark, FOLDER).filter(F.col("seq").between(start, start + 249))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, landing):
    raw = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return build_events(raw, "tshark", "live")


@pytest.fixture(scope="module")
def batch(spark, landing):
    return build_events(spark.read.parquet(landing), "tshark", "live").cache()


def rows(df):
    return sorted(map(str, df.collect()))


def test_enrichment(stream, batch):
    assert rows(drain_append(stream, "events")) == rows(batch)


def test_alerts(stream, batch):
    got = drain_append(streams.alerts(stream, "6 hours", "1 day"), "alerts")
    want = al.alerts(batch, "6 hours")
    columns = ["seq", "domain", "threat_level", "message"]
    assert rows(got.select(*columns)) == rows(want.select(*columns))


def test_breakdowns(stream, batch):
    got = drain_update(streams.running_breakdowns(stream), "breakdowns", ["dimension", "value"])
    assert rows(got.select("dimension", "value", "events")) == rows(breakdowns(batch).select("dimension", "value", "events"))


def test_sessions(spark, stream, batch, landing):
    got = drain_update(sessions.session_counters(stream), "counters", ["session_id"])
    assert rows(got) == rows(sessions.session_counters(batch))
    raw = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    got = drain_update(sessions.session_status(derived.session_messages(raw)), "status", ["session_id"])
    assert rows(got) == rows(sessions.session_status(derived.session_messages(spark.read.parquet(landing))))


def test_focus_and_traffic(stream, batch):
    address = batch.first().source_ip
    assert rows(drain_append(al.focus_alerts(stream, address), "focus")) == rows(al.focus_alerts(batch, address))
    got = drain_append(streams.traffic(stream, "1 hour", "0 seconds"), "traffic")
    want = al.traffic_counts(batch, "1 hour")
    assert set(rows(got)) <= set(rows(want)) and got.count() >= want.count() - 2


def test_running_totals(stream, batch):
    totals = streams.running_totals(stream).withColumn("scope", F.lit("all"))
    row = drain_update(totals, "totals", ["scope"]).first()
    exact = batch.filter("domain <> 'unknown'").select("domain").distinct().count()
    assert row.total_events == batch.count() and abs(row.unique_domains_approx - exact) <= 0.15 * exact


def test_field_files_as_a_stream(spark, tmp_path):
    lines = derived.field_lines(t.raw(spark, FOLDER))
    path = str(tmp_path / "lines")
    lines.select("value").repartition(3).write.text(path)
    got = drain_append(fields.stream_fields(spark, path, 1), "fields")
    want = fields.parse_fields(lines.select("value"))
    assert rows(got) == rows(want)


def test_envelopes_as_a_stream(spark, tmp_path):
    lines = derived.envelope_lines(t.raw(spark, FOLDER)).select("value")
    path = str(tmp_path / "lines")
    lines.repartition(2).write.text(path)
    got, want = envelopes.stream_envelopes(spark, path), envelopes.parse_envelopes(lines)
    for ours, theirs in zip(got, want):
        assert rows(drain_append(ours, "envelopes")) == rows(theirs)


def test_store_and_consumer(spark, stream, batch, tmp_path):
    path, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    store.stream_to_store(stream, path, checkpoint, every=None).awaitTermination()
    store.stream_to_store(stream, path, checkpoint, every=None).awaitTermination()
    assert spark.read.parquet(path).count() == batch.count()
    now, later = streams.consume(spark, path, 20)
    top = batch.agg(F.max("seq")).first()[0]
    assert [r.seq for r in now.collect()] == list(range(top, top - 20, -1))
    assert later.isStreaming


# --- keyed tables, ledger, partial aggregates ------------------------------------------------


def test_keyed_table(spark, tmp_path):
    """Against a dict, over batches that repeat keys, repeat themselves, or fail before their commit."""
    import random

    rng, want = random.Random(7), {}
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], "seq", buckets=5)
    assert table.read() is None and table.last_batch() is None and table.vacuum() == 0
    seq = 0
    for number in range(4):
        batch = []
        for _ in range(60):
            seq += 1
            batch.append((rng.choice([None, *"abcdefghij"]), seq - rng.choice([0, 0, 500]), f"v{seq}"))
        frame = spark.createDataFrame(batch, "k string, seq bigint, version string")
        if number == 2:  # a writer that is lost between data and commit
            frame.withColumn("kept_bucket", F.lit(0)).write.partitionBy("kept_bucket").parquet(f"{tmp_path}/t/data/kept_version=2")
        assert table.merge(frame, number)
        assert not table.merge(frame.withColumn("seq", F.col("seq") + 10_000), number)
        for k, at, value in batch:
            if k not in want or at > want[k][0]:
                want[k] = (at, value)
        assert {r["k"]: (r["seq"], r["version"]) for r in table.read().collect()} == want
    few = spark.createDataFrame([("a", 20_000, "last")], "k string, seq bigint, version string")
    assert table.merge(few, 9)
    assert table._versions()[next(b for b, v in table._versions().items() if v == 9)] == 9
    assert sorted(set(table._versions().values())) == [3, 9]  # the other buckets were not rewritten
    assert table.vacuum(keep=1) == 3 and table.vacuum(keep=1) == 0
    assert {r["k"]: r["seq"] for r in table.read().collect()} == {**{k: v[0] for k, v in want.items()}, "a": 20_000}


def test_ledger_keeps_the_newest(spark, tmp_path):
    from dnslens.sinks.ledger import Ledger
    from dnslens.sources.sessions import read_sessions

    records = spark.range(60).selectExpr(
        "concat('session-', id) AS id", "'completed' AS status", "'tshark' AS tool", "concat('note ', id) AS note",
        "timestamp_seconds(id) AS started_at", "timestamp_seconds(id + 5) AS ended_at", "timestamp_seconds(id + 4) AS last_event_at",
        "id AS events_seen", "array('e') AS errors", "id AS version")
    ledger = Ledger(spark, f"{tmp_path}/records")
    assert ledger.newest() is None and not ledger.export(f"{tmp_path}/none")
    ledger.merge(records.filter("version < 40"), 0)
    ledger.merge(records.filter("version >= 40"), 1)
    ledger.merge(records.filter("version = 59").withColumn("note", F.lit("again")).withColumn("version", F.lit(70)), 2)
    assert ledger.export(f"{tmp_path}/list")
    back = {r["id"]: r for r in read_sessions(spark, f"{tmp_path}/list").collect()}
    assert len(back) == 50 and back["session-59"]["note"] == "again" and "session-9" not in back
    assert back["session-10"]["errors"] == ["e"] and back["session-10"]["ended_at"].second == 15


def test_record_of_a_session(spark):
    """Notes, states and times of each way a session can go."""
    from dnslens.operators.sessions import session_records

    rows = [
        ("s1", 1, "start", 10, None, None, None, None), ("s1", 2, "event", 11, None, None, "A", "x.org"), ("s1", 3, "stop", None, None, None, None, None),
        ("s2", 4, "event", 12, None, None, "A", "y.org"), ("s2", 5, "stderr", None, None, "odd", None, None),
        ("s3", 6, "status", None, "stopping", None, None, None), ("s3", 7, "error", None, None, "broken", None, None),
        ("s4", 8, "event", 13, None, None, "MX", "z.org"), ("s5", 9, "stderr", None, None, "lost", None, None), ("s6", 10, "event", 14, None, None, "A", "w.org"),
    ]
    messages = spark.createDataFrame(
        [(s, seq, kind, at, status, message, rt, d) for s, seq, kind, at, status, message, rt, d in rows],
        "session_id string, seq bigint, kind string, at bigint, status string, message string, record_type string, domain string",
    ).selectExpr("*", "timestamp_seconds(at) AS event_ts", "CAST(NULL AS string) AS tool", "CAST(NULL AS string) AS note")
    ends = spark.createDataFrame([("s1", 0, 20), ("s2", 0, 21), ("s3", 0, 22), ("s4", 3, 23)], "session_id string, exit_code int, at bigint")
    got = {r["id"]: (r["status"], r["note"], r["started_at"] and r["started_at"].second, r["ended_at"] and r["ended_at"].second)
           for r in session_records(messages, ends.selectExpr("session_id", "exit_code", "timestamp_seconds(at) AS ended_at")).collect()}
    assert got == {
        "s1": ("stopped", "Capture stopped by user.", 10, 20), "s2": ("completed", "Capture finished successfully.", 12, 21),
        "s3": ("error", "broken", None, 22), "s4": ("error", "Capture exited with status code 3.", 13, 23),
        "s5": ("starting", "Preparing DNS capture.", None, None), "s6": ("running", "Observed A query for w.org", 14, None)}


def test_partials(stream, batch, spark):
    """A repeated batch, the sketch, and totals after batches have been folded."""
    partials = drain_partials(stream)
    partials.record(batch.filter("seq >= 750"), 3)  # the last batch again
    want = rows(breakdowns(batch))
    assert rows(partials.breakdowns().select(breakdowns(batch).columns)) == want
    totals = partials.totals().first()
    assert totals["total_events"] == batch.count()
    names = batch.filter("domain <> 'unknown'").select("domain").distinct().count()
    assert totals["unique_domains"] == names
    assert abs(partials.totals(exact=False).first()["unique_domains"] - names) <= 0.05 * names
    partials.compact(3)
    assert rows(partials.breakdowns().select(breakdowns(batch).columns)) == want
    assert partials.totals().first() == totals
    partials.compact(3)
    assert partials.totals().first() == totals


# --- state per key ------------------------------------------------------------------------------


def test_alerts_of_a_hot_name(spark):
    """One name in every event, over several micro-batches, with repeats and times that step back within the delay."""
    events = spark.range(1, 3001).selectExpr(
        "id AS seq", "CASE WHEN id % 50 = 0 THEN CAST(NULL AS timestamp) ELSE timestamp_millis(1700000000000 + 1000 * id - 3000 * (id % 3)) END AS event_ts",
        "CASE WHEN id % 9 = 0 THEN concat('other', id % 4) ELSE 'hot.example' END AS domain", "'high' AS threat_level", "array('why') AS threat_reasons")
    path, later = landings(spark, events, F.col("seq"))
    arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(path)
    got = drain_append(streams.alerts(arriving, "7 seconds", "1 hour"), "alerts", later).collect()
    # within a batch rows go by time, so the reference does too
    bounds, want, last = [1 + 3000 * k // 4 for k in range(5)], set(), {}
    table = [(r["seq"], r["event_ts"], r["domain"]) for r in events.collect()]
    for low, high in zip(bounds, bounds[1:]):
        part = [x for x in table if low <= x[0] < high]
        want |= {x[0] for x in part if x[1] is None}
        for seq, at, name in sorted((x for x in part if x[1] is not None), key=lambda x: (x[1], x[0])):
            if name not in last or (at - last[name]).total_seconds() >= 7:
                last[name] = at
                want.add(seq)
    assert sorted(r["seq"] for r in got) == sorted(want)


def test_series_fills_idle_buckets(spark):
    events = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 7), (5, 20), (6, 21)], "seq bigint, at bigint").selectExpr("seq", "timestamp_seconds(at) AS event_ts")
    path, later = landings(spark, events, F.col("seq"), parts=3)
    arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(path)
    got = drain_append(streams.traffic_series(arriving, "1 second", "0 seconds"), "series", later).collect()
    found = sorted((r["bucket_start"].second, r["events"]) for r in got)
    counts = {0: 1, 1: 2, 7: 1, 20: 1}
    assert found == [(k, counts.get(k, 0)) for k in range(21)]


def test_feed_equals_batch(spark, landing):
    from dnslens.plans.queries import _envelope_messages

    raw = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    feed = drain_update(streams.activity_feed(_envelope_messages(raw)), "feed", ["session_id", "first_seq"])
    want = sessions.activity_feed(_envelope_messages(spark.read.parquet(landing)))
    assert rows(feed.select(want.columns)) == rows(want)


def test_names_of_a_bucket_share_one_state():
    """Names that come once cost one read and one write of the state for their bucket; forgotten ones leave it."""
    import pandas as pd

    from dnslens.streaming.states import BucketSuppression

    class State:
        """One bucket's variable, timers and clock."""

        def __init__(self):
            self.value, self.calls, self.timers, self.now = None, 0, [], 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    def batch(rows):
        frame = pd.DataFrame(rows, columns=["seq", "event_ts", "domain"])
        frame["event_ts"] = pd.to_datetime(frame["event_ts"], unit="s")
        out = processor.handleInputRows((7,), iter([frame[:1], frame[1:]]), state)
        return sorted(seq for part in out for seq in part["seq"])

    state, processor = State(), BucketSuppression(10_000_000, ["seq"])
    processor.init(state)
    assert batch([(k, 100, f"n{k}") for k in range(500)] + [(500, 105, "n0"), (501, None, "n0"), (502, 110, "n0"), (503, 100, None)]) == [
        *range(500), 501, 502, 503]
    assert state.calls == 2 and state.timers == [120_001]
    assert batch([(600, 109, "n1"), (601, 119, "n0"), (602, 109, None)]) == []
    assert batch([(603, 111, "n1"), (604, 120, "n0")]) == [603, 604] and state.timers == [120_001]
    state.now = 121_000
    assert not list(processor.handleExpiredTimer((7,), state, None))
    assert dict(zip(*state.value[:2])) == {"n0": 120_000_000, "n1": 111_000_000} and state.timers == [120_001, 130_001]
    state.now = 130_001
    assert not list(processor.handleExpiredTimer((7,), state, None)) and state.value is None and len(state.timers) == 2
    assert batch([(700, 131, "n0")]) == [700]


def test_state_of_a_name_gives_the_same_alerts(stream, batch):
    got = drain_append(streams.alerts(stream, "6 hours", "1 day", buckets=None), "alerts")
    assert rows(got) == rows(al.alerts(batch, "6 hours"))
