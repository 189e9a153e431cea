from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dnslens.operators import filters
from dnslens.operators.alerts import traffic_series
from dnslens.operators.sessions import session_report, session_view
from dnslens.operators.summary import scalars, summary_long


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "evt-1", "a.example", "A", "10.0.0.1", "1.1.1.1", "live", "udp", "low", 100),
        (2, "evt-2", "b.example", "MX", "10.0.0.2", "1.1.1.1", "live", "tcp", "high", 200),
        (3, "evt-3", None, "aaaa", None, "8.8.8.8", "manual", "udp", None, None),
        (4, "evt-4", "/(x/", "TXT", "10.0.0.1", "8.8.8.8", "live", "udp", "medium", 260),
        (5, "evt-5", "unknown", "NS", "unknown", "8.8.8.8", "live", "udp", "low", 200),
    ]
    df = spark.createDataFrame(
        rows,
        "seq bigint, id string, domain string, record_type string, source_ip string, destination_ip string, mode string, "
        "transport string, threat_level string, s int",
    )
    return df.select("*", F.timestamp_seconds("s").alias("event_ts"), F.lit("tshark").alias("tool"), F.lit("DNS").alias("protocol"), F.lit("NOERROR").alias("rcode")).drop("s")


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_joined_search_spans_fields(events):
    assert seqs(filters.search(events, "example A 10.0.0.1")) == [1]
    assert seqs(filters.search(events, " AAAA  8.8.8.8 ")) == [3]  # the empty field leaves two blanks
    assert seqs(filters.search(events, "   ")) == [1, 2, 3, 4, 5]
    assert [r.seq for r in filters.snapshot(events, "", 2).collect()] == [5, 4]


def test_any_search_and_its_complement(events):
    for term in ("example", "HIGH", "/^A/", "/(x/", "/a+/gi", "%", "/8\\.8/y", "/a/gg"):
        both = seqs(filters.search_any(events, term)) + seqs(filters.search_any(events, term, exclude=True))
        assert sorted(both) == [1, 2, 3, 4, 5]
    assert seqs(filters.search_any(events, "/(x/")) == [4]
    assert seqs(filters.search_field(events, "resolver", "/8\\.8/y")) == [3, 4, 5]
    assert seqs(filters.search_field(events, "resolver", "/\\.8/y")) == []
    assert seqs(filters.search_field(events, "type", "/^(a|mx)$/")) == [1, 2]


def test_view_filters(events):
    assert seqs(filters.type_group(events, "browser")) == [1, 3]
    assert seqs(filters.type_group(events, "other")) == [1, 2, 3, 4, 5]
    assert seqs(filters.focus(events, "0.0.1")) == [1, 4]
    cut = filters.latest_timestamp(events.filter("seq < 3"))
    assert seqs(filters.after_cutoff(events, cut)) == [3, 4]
    spec = filters.ViewSpec(group="mail", address="10.0", term=" example ", exclude=True)
    assert seqs(filters.filtered_view(events, spec)) == [4]
    assert seqs(filters.filtered_view(events, filters.ViewSpec())) == [1, 2, 3, 4, 5]


def test_selection(spark, events):
    ids = spark.createDataFrame([("evt-2",), ("evt-2",), ("evt-99",)], "id string")
    assert seqs(filters.select_rows(events, ids)) == [2]
    assert seqs(filters.select_rows(events.filter("seq <> 2"), ids)) == [1, 3, 4, 5]
    assert seqs(filters.select_rows(events, None)) == [1, 2, 3, 4, 5]
    assert tuple(filters.view_counts(events, ids).first()) == (5, 1)
    assert tuple(filters.view_counts(events).first()) == (5, 0)


def test_filters_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    view = filters.type_group(spark.read.parquet(path), "mail").filter("seq > 1").select("seq")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,1)" in plan and "ReadSchema: struct<seq:bigint,record_type:string>" in plan


def test_summary_edges(events):
    row = scalars(events).first()
    assert (row.total_events, row.unique_domains, row.top_domain, row.top_source_ip) == (5, 3, "/(x/", "10.0.0.1")
    assert row.events_per_minute == 3.0 and row.avg_qps == "0.05"
    empty = scalars(events.filter("seq > 100")).first()
    assert (empty.total_events, empty.unique_domains, empty.top_domain, empty.events_per_minute) == (0, 0, None, 0.0)
    long = {(r.section, r.value): r.events for r in summary_long(events).collect()}
    assert long["threat_level", "low"] == 3 and ("domain", "unknown") not in long


def test_report_ties_go_to_the_first_seen(events):
    rows = session_report(events.withColumn("source_ip", F.coalesce("source_ip", F.lit("unknown")))).collect()
    ranked = {(r.dimension, r["rank"]): (r.value, r.events) for r in rows}
    assert ranked["total", 1] == (None, 5)
    assert ranked["source_ip", 1] == ("10.0.0.1", 2) and ranked["source_ip", 2] == ("unknown", 2)
    assert ranked["record_type", 1] == ("A", 1)
    assert session_report(events.filter("seq > 9")).count() == 0


def test_traffic_series_fills_idle_buckets(events):
    rows = traffic_series(events.filter("seq <> 3"), "1 second", 60).orderBy("bucket_start").collect()
    assert len(rows) == 60 and rows[-1].events == 1 and sum(r.events for r in rows) == 1
    rows = traffic_series(events, "1 minute", 4).orderBy("bucket_start").collect()
    assert [r.events for r in rows] == [1, 0, 2, 1]


def test_session_view(spark):
    df = spark.createDataFrame(
        [("session-1704116480461", "manual", None, 3, "completed"), (None, None, None, None, "error")],
        "id string, mode string, started_at timestamp, events_seen bigint, status string",
    )
    rows = [tuple(r) for r in session_view(df).select("session", "mode", "events_seen", "status").collect()]
    assert rows == [("17041164", "MANUAL", 3, "completed"), ("unknown", "LIVE", 0, "error")]


@pytest.mark.parametrize(
    "term, hits",
    [
        ("/[^]1/", ["a1", "[1"]),  # any character, then 1
        ("/^[[]/", ["[1", "["]),
        ("/[a-z&&b]/", ["a1", "b", "&"]),  # a plain class: letters, & and b
        ("/[]/", []),
        ("/b$/", ["b"]),
        ("/[\\]\\[]1/", ["[1"]),
        ("/(/", []),  # invalid: searched as text
    ],
)
def test_browser_patterns(spark, term, hits):
    words = ["a1", "[1", "[", "b", "&", "1"]
    df = spark.createDataFrame([(w,) for w in words], "domain string")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    match = filters.term_match(term, "domain")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == jobs  # no job for a term
    assert [r.domain for r in df.filter(match).collect()] == hits


def test_newest_before_reads_bounded_ranges(spark, tmp_path):
    """Pages over a store with gaps in its numbers; both bounds reach the scan."""
    from dnslens.operators.windows import newest_before, page
    from dnslens.sinks import store

    numbers = [*range(1, 60), *range(4_000, 4_030), 90_000]
    events = spark.createDataFrame([(n,) for n in numbers], "seq bigint").selectExpr("seq", "timestamp_seconds(seq * 40) AS event_ts")
    store.write_events(events, str(tmp_path / "s"))
    back = store.read_events(spark, str(tmp_path / "s"))
    for before in (None, 90_000, 4_010, 30, 1):
        for rows in (1, 7, 40, 500):
            got = newest_before(back, rows, before)
            assert [r.seq for r in got.collect()] == [r.seq for r in page(back, before, rows).collect()]
    plan = newest_before(back, 7, 4_010)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq," in plan and "LessThan(seq,4010)" in plan
    assert newest_before(back.limit(0), 5).count() == 0
