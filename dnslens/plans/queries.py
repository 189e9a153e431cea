"""The registered queries: ``(spark, folder) -> DataFrame`` over the given tables.

Results are flat (arrays joined to text, timestamps without zone), so that they can
be compared with SQL on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.functions import text, threat, times
from dnslens.functions.codes import method_class, resolve_rcode, resolve_record_type
from dnslens.operators import alerts as al
from dnslens.operators import filters, sessions, sets, summary, views, windows
from dnslens.operators.normalize import build_events, normalize_events, orient, packet_metadata, with_event_id
from dnslens.operators.threat import (
    apply_redirect,
    name_features,
    reason_counts,
    rule_breakdown,
    score_events,
    tld_reputation,
)
from dnslens.operators.typosquat import default_brands, typosquat_matches
from dnslens.plans import derived, reports
from dnslens.plans import tables as t
from dnslens.sinks import exports, ledger, packets, store
from dnslens.sources import captures, envelopes, fields, scans
from dnslens.sources.sessions import read_sessions
from dnslens.streaming import arrival
from dnslens.streaming import events as streams
from dnslens.session import cut_lineage, written
from dnslens.sinks.keyed import KeyedTable
from dnslens.streaming.partials import drain_partials
from dnslens.streaming.run import drain_append, drain_batches, drain_update, landings, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GAP = "6 hours"
BUCKET = "1 hour"
FOCUS = "192.168.1.27"
REDIRECT = "10.9.9.9"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def joined(name: str, separator: str = "|") -> Column:
    return F.array_join(name, separator).alias(name)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, timestamps without zone."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out.append(F.array_join(F.col(name).cast("array<string>"), "|").alias(name))
        elif kind == "timestamp":
            out.append(ntz(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- normalisation --------------------------------------------------------------


@query
def normalize_events_fields(spark, folder):
    return flat(t.events(spark, folder, score=False))


@query
def normalize_payloads(spark, folder):
    events = normalize_events(derived.payloads(t.raw(spark, folder)), tool="auto", mode="live")
    return flat(events)


@query
def record_type_lookup(spark, folder):
    raw = t.raw(spark, folder)
    named = resolve_record_type(F.col("qtype_raw")).alias("record_type")
    return raw.groupBy("qtype_raw", named).agg(F.count("*").alias("events"))


@query
def rcode_lookup(spark, folder):
    raw = t.raw(spark, folder)
    named = resolve_rcode(F.col("rcode_raw")).alias("rcode")
    return raw.groupBy("rcode_raw", named).agg(F.count("*").alias("events"))


@query
def protocol_detect(spark, folder):
    events = t.events(spark, folder, score=False)
    return events.groupBy("transport", "destination_port", "protocol").agg(F.count("*").alias("events"))


@query
def method_classes(spark, folder):
    events = t.events(spark, folder, score=False)
    kind = method_class(F.col("protocol"), F.col("transport")).alias("method_class")
    return events.groupBy("protocol", kind).agg(F.count("*").alias("events"))


@query
def oriented_events(spark, folder):
    events = build_events(orient(t.raw(spark, folder)), "scapy", "manual", score=False)
    return events.select("seq", "source_ip", "destination_ip", "destination_port", "protocol")


# --- threat scoring ---------------------------------------------------------------


@query
def name_feature_table(spark, folder):
    names = t.events(spark, folder, score=False).select("domain").distinct()
    features = name_features(names).withColumn("entropy", F.round("entropy", 6))
    return features.drop("first_label").withColumns(
        {"name_length": F.col("name_length").cast("bigint"), "label_count": F.col("label_count").cast("bigint"),
         "consonant_run": F.col("consonant_run").cast("bigint")}
    )


@query
def domain_entropy(spark, folder):
    pages = t.table(spark, folder, "pages")
    return pages.select("page_id", F.round(threat.entropy(F.col("url")), 6).alias("entropy"))


@query
def typosquat(spark, folder):
    names = t.events(spark, folder, score=False).select("domain").distinct()
    found = names.withColumn("brand", threat.typosquat_target(F.col("domain")))
    return found.filter(F.col("brand").isNotNull())


@query
def typosquat_join(spark, folder):
    return typosquat_matches(t.events(spark, folder, score=False), default_brands(spark))


@query
def name_twins(spark, folder):
    """Part names one edit away from another table's names: the brand join on a growing brand table."""
    names = t.table(spark, folder, "customer").select(F.lower("c_name").alias("domain"))
    brands = t.table(spark, folder, "supplier").select(
        F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("brand"),
        F.col("s_suppkey").cast("int").alias("position"),
    )
    return typosquat_matches(names, brands)


def _scores(events: DataFrame) -> DataFrame:
    return events.select(
        "seq", "domain", "record_type", "rcode", "threat_score", "threat_level", joined("threat_reasons")
    )


@query
def threat_scores(spark, folder):
    return _scores(t.events(spark, folder))


@query
def threat_scores_per_name(spark, folder):
    return _scores(t.events(spark, folder, per_name=True))


@query
def threat_scores_brand_table(spark, folder):
    return _scores(t.events(spark, folder, brands=default_brands(spark)))


@query
def rule_points(spark, folder):
    events = rule_breakdown(t.events(spark, folder, score=False))
    return events.select("seq", *[name for name in events.columns if name.startswith("points_")])


@query
def threat_reason_counts(spark, folder):
    return reason_counts(t.events(spark, folder))


@query
def tld_weights(spark, folder):
    return tld_reputation(t.events(spark, folder, score=False))


@query
def threat_report(spark, folder):
    return reports.threat_report(t.events(spark, folder))


@query
def url_hosts(spark, folder):
    pages = t.table(spark, folder, "pages")
    return pages.select("page_id", text.normalize_target(F.col("url")).alias("host"))


@query
def url_threats(spark, folder):
    hosts = url_hosts(spark, folder).withColumnRenamed("host", "domain")
    scored = reports.host_threats(hosts)
    return scored.select("page_id", "domain", "threat_score", "threat_level", joined("threat_reasons"))


# --- summary ------------------------------------------------------------------------


@query
def summary_scalars(spark, folder):
    return flat(summary.scalars(t.events(spark, folder, score=False)))


@query
def buffer_summary(spark, folder):
    return flat(summary.scalars(windows.latest(t.events(spark, folder, score=False))))


@query
def events_per_minute(spark, folder):
    return flat(summary.totals(t.events(spark, folder, score=False)))


@query
def session_rates(spark, folder):
    events = t.events(spark, folder, score=False)
    rates = events.groupBy("session_id").agg(summary.events_per_minute().alias("events_per_minute"))
    return rates.withColumn("avg_qps", summary.avg_qps(F.col("events_per_minute")))


@query
def transport_breakdown(spark, folder):
    return summary.breakdown(t.events(spark, folder, score=False), "transport").select("transport", "events")


@query
def record_type_breakdown(spark, folder):
    return summary.breakdown(t.events(spark, folder, score=False), "record_type").select("record_type", "events")


@query
def rcode_breakdown(spark, folder):
    return summary.breakdown(t.events(spark, folder, score=False), "rcode").select("rcode", "events")


@query
def threat_breakdown(spark, folder):
    return summary.breakdown(t.events(spark, folder), "threat_level").select("threat_level", "events")


@query
def top_domains(spark, folder):
    return summary.top_values(t.events(spark, folder, score=False), "domain", 8)


@query
def top_source_ips(spark, folder):
    return summary.top_values(t.events(spark, folder, score=False), "source_ip", 5)


@query
def summary_long(spark, folder):
    return summary.summary_long(t.events(spark, folder)).drop("last_seq")


@query
def summary_record(spark, folder):
    record = summary.summary_record(t.events(spark, folder))
    keys = F.array_sort(F.map_keys("threat_level_breakdown"))
    levels = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("threat_level_breakdown")[k].cast("string")))
    tops = F.transform("top_domains", lambda e: F.concat(e["value"], F.lit("="), e["events"].cast("string")))
    return record.select(
        "total_events", "unique_domains", F.array_join(levels, ",").alias("levels"), F.array_join(tops, ",").alias("tops")
    )


@query
def summary_activity(spark, folder):
    """The summary record with the newest activity of all sessions and the number of stored ones."""
    raw = t.raw(spark, folder)
    record = summary.summary_record(
        t.events(spark, folder), feed=sessions.activity_feed(_envelope_messages(raw)), sessions=derived.stored_sessions(raw))
    entries = F.transform("recent_activity", lambda e: F.concat_ws(" ", e["level"], e["message"]))
    return record.select("total_events", "unique_domains", "history_count", F.array_join(entries, "|").alias("activity"))


@query
def latest_events(spark, folder):
    return windows.latest(t.events(spark, folder, score=False)).select("id", "seq", "domain")


# --- filters and views -----------------------------------------------------------------


def _found(df: DataFrame) -> DataFrame:
    return df.select("seq", "domain", "record_type", "source_ip")


@query
def search_joined(spark, folder):
    return _found(filters.search(t.events(spark, folder, score=False), " AAAA 192.168.1 "))


@query
def snapshot_view(spark, folder):
    return _found(filters.snapshot(t.events(spark, folder, score=False), "github", 50))


@query
def search_any(spark, folder):
    return _found(filters.search_any(t.events(spark, folder), "HIGH"))


@query
def search_field_client(spark, folder):
    return _found(filters.search_field(t.events(spark, folder, score=False), "client", "168.3.1"))


@query
def search_regex(spark, folder):
    return _found(filters.search_field(t.events(spark, folder, score=False), "domain", r"/^[A-F0-9]{8}\.buzz$/g"))


@query
def search_regex_invalid(spark, folder):
    return _found(filters.search_any(t.events(spark, folder), "/(unclosed/", exclude=True))


@query
def search_exclude(spark, folder):
    return _found(filters.search_any(t.events(spark, folder), "example", exclude=True))


@query
def type_group(spark, folder):
    return _found(filters.type_group(t.events(spark, folder, score=False), "mail"))


@query
def focus_ip(spark, folder):
    return _found(filters.focus(t.events(spark, folder, score=False), "2606:4700:4700::1111"))


@query
def clear_cutoff(spark, folder):
    events = t.events(spark, folder, score=False)
    older = events.filter(F.col("rcode") == "RCODE_11")
    return _found(filters.after_cutoff(events, filters.latest_timestamp(older)))


@query
def filtered_view(spark, folder):
    spec = filters.ViewSpec(group="browser", address="192.168.2", term="google", field="domain", exclude=True)
    return _found(filters.filtered_view(t.events(spark, folder), spec))


def _selection(events: DataFrame) -> DataFrame:
    return events.filter(F.col("rcode") == "REFUSED").select("id")


@query
def selected_rows(spark, folder):
    events = t.events(spark, folder, score=False)
    return _found(filters.select_rows(filters.type_group(events, "mail"), _selection(events)))


@query
def view_counts(spark, folder):
    events = t.events(spark, folder, score=False)
    return filters.view_counts(filters.type_group(events, "mail"), _selection(events))


@query
def dns_ports(spark, folder):
    packets_ = derived.frames(t.raw(spark, folder))
    return filters.dns_ports(packets_).select("seq", "source_port", "destination_port")


@query
def dns_only(spark, folder):
    return filters.dns_only(derived.frames(t.raw(spark, folder))).select("seq", "domain")


@query
def known_values(spark, folder):
    events = t.events(spark, folder, score=False)
    kinds = [F.count_if(filters.known(name)).alias(name) for name in ("domain", "source_ip", "record_type", "rcode")]
    return events.agg(*kinds)


@query
def table_view(spark, folder):
    events = apply_redirect(t.events(spark, folder), REDIRECT)
    return flat(views.table_view(events))


@query
def detail_view(spark, folder):
    return flat(views.detail_view(t.events(spark, folder)))


@query
def page(spark, folder):
    return _found(windows.page(t.events(spark, folder, score=False), before=800))


@query
def store_page(spark, folder):
    """A page of a store, by bounded ranges of arrival numbers."""
    path = new_folder(spark, "store")
    store.write_events(t.events(spark, folder, score=False), path)
    return _found(windows.newest_before(store.read_events(spark, path), before=800))


@query
def latest_by_id(spark, folder):
    events = t.events(spark, folder, score=False)
    return windows.latest_by_id(events, key="domain").select("domain", "seq", "source_ip")


@query
def first_events(spark, folder):
    return _found(windows.limit_events(t.events(spark, folder, score=False), 250))


@query
def time_order(spark, folder):
    events = windows.sort_by_time(t.events(spark, folder, score=False))
    return events.select("seq", ntz("event_ts"))


@query
def chart_labels(spark, folder):
    names = t.events(spark, folder, score=False).select("domain").distinct()
    return names.select("domain", text.short_label(F.col("domain")).alias("label"))


@query
def age_labels(spark, folder):
    events = t.events(spark, folder, score=False)
    newest = events.agg(F.max("event_ts")).scalar()
    return events.select("seq", times.age_label(F.col("event_ts"), newest).alias("age"))


# --- sessions and activity -------------------------------------------------------------------


@query
def session_stats(spark, folder):
    return sessions.session_stats(t.events(spark, folder, score=False)).drop("first_seq")


@query
def session_report(spark, folder):
    return sessions.session_report(t.events(spark, folder, score=False))


@query
def activity_sample(spark, folder):
    sample = sessions.activity_sample(t.events(spark, folder, score=False))
    return flat(sample.withColumn("rank", F.col("rank").cast("bigint")))


@query
def activity_sample_chunked(spark, folder):
    sample = sessions.activity_sample(t.events(spark, folder, score=False), chunk_rows=97)
    return flat(sample.withColumn("rank", F.col("rank").cast("bigint")))


@query
def activity_collapse(spark, folder):
    return flat(sessions.collapse_activity(derived.activities(t.raw(spark, folder))))


@query
def activity_collapse_chunked(spark, folder):
    return flat(sessions.collapse_activity(derived.activities(t.raw(spark, folder)), chunk_rows=61))


@query
def recent_activity(spark, folder):
    collapsed = sessions.collapse_activity(derived.activities(t.raw(spark, folder)))
    return flat(sessions.recent_activity(collapsed))


@query
def session_status(spark, folder):
    return sessions.session_status(derived.session_messages(t.raw(spark, folder)))


@query
def session_ledger(spark, folder):
    messages = derived.session_messages(t.raw(spark, folder))
    return flat(sessions.session_ledger(messages, derived.session_ends(messages)))


def _envelope_messages(raw: DataFrame, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The messages of sessions as their envelope lines give them."""
    return envelopes.session_messages(envelopes.parse_envelopes(derived.envelope_lines(raw), hold=hold))


@query
def activity_feed(spark, folder):
    return flat(sessions.activity_feed(_envelope_messages(t.raw(spark, folder))))


@query
def activity_feed_chunked(spark, folder):
    return flat(sessions.activity_feed(_envelope_messages(t.raw(spark, folder)), chunk_rows=73))


@query
def ledger_from_envelopes(spark, folder):
    """Envelope lines become session records, merged into the ledger batch by batch and read back from its export.

    The second batch is repeated with other contents, the third brings older records of sessions that are there.
    """
    messages = written(_envelope_messages(t.raw_dealt(spark, folder), hold=written))  # read for each part of the records
    records = cut_lineage(sessions.session_records(messages, derived.session_closings(messages)))
    path = new_folder(spark, "ledger")
    kept = ledger.Ledger(spark, f"{path}/records")
    even = F.substring_index("id", "-", -1).cast("int") % 2 == 0
    wrong = records.withColumn("note", F.lit("wrong"))
    kept.merge(records.filter(even), 0)
    kept.merge(records.filter(~even), 1)
    kept.merge(wrong.withColumn("version", F.col("version") + 1), 1)
    kept.merge(wrong.withColumn("version", F.col("version") - 1), 2)
    kept.export(f"{path}/newest")
    return flat(read_sessions(spark, f"{path}/newest").drop("config"))


@query
def session_counters(spark, folder):
    return flat(sessions.session_counters(t.events(spark, folder, score=False)))


@query
def recent_sessions(spark, folder):
    stored = derived.stored_sessions(t.raw(spark, folder))
    return flat(windows.recent_sessions(stored).drop("mode"))


@query
def session_view(spark, folder):
    return flat(sessions.session_view(derived.stored_sessions(t.raw(spark, folder))))


@query
def session_durations(spark, folder):
    stored = derived.stored_sessions(t.raw(spark, folder))
    label = times.duration_label(F.col("started_at"), F.col("ended_at"))
    return stored.select("id", times.session_id(F.col("started_at")).alias("session_id"), label.alias("duration"))


@query
def session_store(spark, folder):
    """The ledger written to disk (newest 50) and read back, with its size."""
    path = new_folder(spark, "ledger")
    stored = derived.stored_sessions(t.raw(spark, folder)).drop("mode")
    ledger.append_sessions(stored.withColumn("note", F.lit("first")), path)
    ledger.append_sessions(stored.filter("status = 'none'"), path)
    back = read_sessions(spark, path)
    return flat(back.select("id", "status", "note", "events_seen", "started_at", "ended_at"))


@query
def history_count(spark, folder):
    return sessions.history_count(derived.stored_sessions(t.raw(spark, folder)))


@query
def union_sources(spark, folder):
    raw = t.raw(spark, folder)
    lines = fields.parse_fields(derived.field_lines(raw))
    packets_ = captures.capture_fields(derived.frames(raw))
    both = sets.union_sources(build_events(lines, "tshark", "manual", score=False), build_events(packets_, "scapy", "manual", score=False))
    return both.groupBy("tool", "record_type").agg(F.count("*").alias("events"))


@query
def address_sets(spark, folder):
    return sets.address_sets(t.events(spark, folder, score=False))


# --- alerts, series, policy --------------------------------------------------------------------


@query
def traffic_series(spark, folder):
    return flat(al.traffic_series(t.events(spark, folder, score=False), BUCKET))


@query
def alerts(spark, folder):
    return flat(al.alerts(t.events(spark, folder), GAP))


@query
def alerts_split(spark, folder):
    return flat(al.alerts(t.events(spark, folder), GAP, max_group_rows=20))


@query
def alerts_arrival(spark, folder):
    names = t.events(spark, folder).withColumn("domain", F.substring_index("domain", ".", -1))
    return flat(al.alerts(names, GAP, scope="arrival"))


def _field_line_events(raw):
    """Scored events of field lines, every seventh without a time."""
    return build_events(fields.parse_fields(derived.field_lines(raw)), "tshark", "manual")


@query
def alerts_field_lines(spark, folder):
    return flat(al.alerts(_field_line_events(t.raw(spark, folder)), GAP))


@query
def alerts_field_lines_split(spark, folder):
    return flat(al.alerts(_field_line_events(t.raw(spark, folder)), GAP, max_group_rows=1))


@query
def traffic_series_ms(spark, folder):
    return flat(al.traffic_series(t.events(spark, folder, score=False), "100 milliseconds"))


@query
def focus_alerts(spark, folder):
    return flat(al.focus_alerts(t.events(spark, folder), FOCUS))


@query
def redirect_policy(spark, folder):
    events = apply_redirect(t.events(spark, folder), REDIRECT)
    return events.select("seq", "action", joined("answers", ";"), F.col("answer_count").cast("bigint").alias("answer_count"))


# --- sources and sinks ---------------------------------------------------------------------------


@query
def fields_ingest(spark, folder):
    lines = derived.field_lines(t.raw(spark, folder))
    events = build_events(fields.parse_fields(lines), "tshark", "manual", score=False)
    return flat(events.drop("is_response"))


@query
def fields_file_ingest(spark, folder):
    """Field lines written as files, read back and numbered in file and line order."""
    path = new_folder(spark, "fields")
    derived.field_lines(t.raw(spark, folder)).orderBy("seq").select("value").write.text(path)
    return fields.read_fields(spark, path).select("seq", "domain", ntz("event_ts"))


@query
def envelope_events(spark, folder):
    routed = envelopes.parse_envelopes(derived.envelope_lines(t.raw(spark, folder)))
    return flat(routed.events.select("session_id", "seq", "event_ts", "domain", "source_ip", "destination_ip", "record_type", "transport", "tool", "rcode", "ttl"))


@query
def envelope_status(spark, folder):
    routed = envelopes.parse_envelopes(derived.envelope_lines(t.raw(spark, folder)))
    return routed.status.select("session_id", "seq", "status", "note")


@query
def envelope_errors(spark, folder):
    routed = envelopes.parse_envelopes(derived.envelope_lines(t.raw(spark, folder)))
    return routed.errors


@query
def scan_events(spark, folder):
    scanned = scans.scan_events(derived.scan_replies(t.raw(spark, folder)))
    return scanned.select("seq", "domain", "record_type", "protocol", "transport", "destination_port", joined("answers"), "threat_score", "tool", "mode")


@query
def packet_report(spark, folder):
    return flat(packet_metadata(derived.frames(t.raw(spark, folder))))


@query
def packet_counts(spark, folder):
    return packets.packet_counts(derived.frames(t.raw(spark, folder)))


@query
def packet_csv_rows(spark, folder):
    return packets.packet_csv_rows(packet_metadata(derived.frames(t.raw(spark, folder))))


@query
def capture_decode(spark, folder):
    """Binary frames peeled and decoded back into packet records."""
    decoded = captures.decode_frames(derived.wire_frames(t.raw(spark, folder)))
    return flat(decoded.drop("epoch", "packet_length"))


@query
def capture_events(spark, folder):
    decoded = captures.decode_frames(derived.wire_frames(t.raw(spark, folder)))
    events = build_events(orient(captures.capture_fields(decoded)), "scapy", "manual", score=False)
    return flat(events.select("seq", "event_ts", "domain", "source_ip", "destination_ip", "destination_port", "protocol", "rcode", "ttl", "answers"))


@query
def export_csv_rows(spark, folder):
    rows = views.csv_rows(t.events(spark, folder))
    return rows.withColumnsRenamed({name: name.lower().replace(" ", "_") for name in rows.columns})


@query
def export_csv_file(spark, folder):
    """The written CSV report, line by line."""
    path = new_folder(spark, "csv")
    exports.export_csv(t.events(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def export_json_rows(spark, folder):
    rows = flat(views.json_rows(t.events(spark, folder)))
    return rows.withColumnsRenamed({"threatScore": "threat_score", "threatReasons": "threat_reasons"})


@query
def export_json_file(spark, folder):
    """The written JSON report, read back."""
    path = new_folder(spark, "json")
    events = t.events(spark, folder)
    exports.export_json(events, path)
    rows = spark.read.schema(views.json_rows(events).schema).json(f"{path}/events")
    return flat(rows).withColumnsRenamed({"threatScore": "threat_score", "threatReasons": "threat_reasons"})


@query
def packets_json_file(spark, folder):
    """The written packet report, read back, with the counts of its metadata."""
    path = new_folder(spark, "packets")
    frames = derived.frames(t.raw(spark, folder))
    report = packet_metadata(frames)
    packets.export_packets_json(report, frames, path)
    counted = spark.read.schema("packet_count bigint, dns_event_count bigint").json(f"{path}/metadata")
    return summary.attach_row(flat(spark.read.schema(report.schema).json(f"{path}/events")), counted)


@query
def packets_csv_file(spark, folder):
    """The written packet CSV, read back."""
    path = new_folder(spark, "packets")
    report = packet_metadata(derived.frames(t.raw(spark, folder)))
    packets.export_packets_csv(report, path)
    rows = spark.read.schema(packets.packet_csv_rows(report).schema).option("escape", '"').csv(path, header=True)
    return rows.select(*[F.coalesce(name, F.lit("")).alias(name) for name in rows.columns])


@query
def export_metadata(spark, folder):
    events = t.events(spark, folder)
    view = filters.filtered_view(events, filters.ViewSpec(term="google"))
    row = exports.export_metadata(view, {"search": "google"}, summary.scalars(events))
    return row.select(
        F.col("eventCount").alias("event_count"), F.col("filters.search").alias("search"),
        F.col("sessionSummary.total_events").alias("total_events"), F.col("sessionSummary.top_domain").alias("top_domain"),
    )


@query
def event_store(spark, folder):
    """Events appended to the store and read back by date."""
    path = new_folder(spark, "store")
    store.write_events(t.events(spark, folder), path)
    back = store.read_events(spark, path)
    by_date = back.groupBy(F.col("event_date").cast("string").alias("event_date"))
    return by_date.agg(F.count("*").alias("events"), F.sum("threat_score").alias("score"))


# --- streaming ---------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return streams.enrich(t.raw_stream(spark, folder), t.TOOL, t.MODE)


def _arriving(rows: DataFrame, order: Column, parts: int = 4) -> tuple[DataFrame, list]:
    """A stream of ``rows``, which land one range of ``order`` after another, and the landings that are still to come."""
    path, later = landings(rows.sparkSession, rows, order, parts)
    reader = rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", True)
    return reader.parquet(path), later


def _raw_arriving(spark: SparkSession, folder: str, order: Column | None = None) -> tuple[DataFrame, list]:
    """Raw records landing in order of time, or of ``order``."""
    return _arriving(t.raw(spark, folder), F.coalesce(F.unix_micros("event_ts"), F.lit(0)) if order is None else order)


def _landed(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, list]:
    """A stream of the lines (``seq``, ``value``), which land in order, and the landings that are still to come."""
    path, later = landings(spark, lines, F.col("seq"), text=True)
    return arrival.follow_lines(spark, path), later


@query
def stream_fields_events(spark, folder):
    """Events of field files that land one after another, numbered over all micro-batches."""
    def events(lines):
        return build_events(fields.parse_fields(lines), "tshark", "manual", score=False)

    landed, later = _landed(spark, derived.field_lines(t.raw(spark, folder)))
    return flat(arrival.drain_numbered(landed, events, "fields", later).select("seq", "id", "domain", "event_ts"))


@query
def stream_envelope_events(spark, folder):
    landed, later = _landed(spark, derived.envelope_lines(t.raw(spark, folder)))
    numbered = arrival.drain_numbered(landed, lambda lines: with_event_id(envelopes.parse_envelopes(lines).events), "envelopes", later)
    return flat(numbered.select("seq", "id", "event_ts", "domain", "source_ip", "tool"))


@query
def stream_envelope_status(spark, folder):
    """The status messages of envelope files, numbered with all other lines."""
    landed, later = _landed(spark, derived.envelope_lines(t.raw(spark, folder)))
    return arrival.drain_numbered(landed, lambda lines: envelopes.parse_envelopes(lines).status, "status", later).select("seq", "status", "note")


@query
def stream_threat_scores(spark, folder):
    return _scores(drain_append(_stream(spark, folder), "scores"))


@query
def stream_breakdowns(spark, folder):
    """Counts per dimension value, from the partial aggregates of several micro-batches."""
    raw, later = _raw_arriving(spark, folder)
    counted = drain_partials(streams.enrich(raw, t.TOOL, t.MODE), later).breakdowns()
    return counted.select("dimension", "value", "events")


@query
def stream_totals(spark, folder):
    raw, later = _raw_arriving(spark, folder)
    return flat(drain_partials(build_events(raw, t.TOOL, t.MODE, score=False), later).totals())


@query
def stream_top_domains(spark, folder):
    """The most frequent names of a stream, from its partial aggregates."""
    raw, later = _raw_arriving(spark, folder)
    return drain_partials(build_events(raw, t.TOOL, t.MODE, score=False), later).top("domain", 8)


@query
def stream_traffic(spark, folder):
    """Closed one-hour buckets; the newest stay open until the watermark passes them."""
    return flat(drain_append(streams.traffic(_stream(spark, folder), BUCKET, "0 seconds"), "traffic"))


@query
def stream_traffic_series(spark, folder):
    """Closed buckets of five minutes, idle ones with 0."""
    raw, later = _raw_arriving(spark, folder)
    events = build_events(raw, t.TOOL, t.MODE, score=False)
    return flat(drain_append(streams.traffic_series(events, "5 minutes", "0 seconds"), "series", later))


@query
def stream_alerts(spark, folder):
    raw, later = _raw_arriving(spark, folder)
    return flat(drain_append(streams.alerts(streams.enrich(raw, t.TOOL, t.MODE), GAP), "alerts", later))


@query
def stream_alerts_field_lines(spark, folder):
    raw, later = _raw_arriving(spark, folder)
    return flat(drain_append(streams.alerts(_field_line_events(raw), GAP), "alerts", later))


@query
def stream_activity_feed(spark, folder):
    """The feed of every session, kept over several micro-batches."""
    raw, later = _raw_arriving(spark, folder, F.col("seq"))
    feed = streams.activity_feed(_envelope_messages(raw))
    return flat(drain_update(feed, "feed", ["session_id", "first_seq"], later))


@query
def stream_latest_by_id(spark, folder):
    """The newest record of ids that repeat, merged batch by batch; the last batch comes twice."""
    raw, later = _raw_arriving(spark, folder, F.col("seq"))
    events = build_events(raw, t.TOOL, t.MODE, score=False).withColumn("id", F.concat(F.lit("evt-"), (F.col("seq") % 997).cast("string")))
    path = new_folder(spark, "latest")
    newest = KeyedTable(spark, f"{path}/table", ["id"], "seq", buckets=16)

    def merge(batch: DataFrame, number: int) -> None:
        newest.merge(batch, number)
        newest.merge(batch.withColumn("seq", F.col("seq") + 1), number)  # a repeat of a merged batch changes nothing

    drain_batches(events, merge, f"{path}/checkpoint", later)
    newest.vacuum()
    return flat(newest.read().select("id", "seq", "event_ts", "domain", "source_ip"))


@query
def stream_focus_alerts(spark, folder):
    return flat(drain_append(al.focus_alerts(_stream(spark, folder), FOCUS), "focus"))


@query
def stream_session_counters(spark, folder):
    return flat(drain_update(sessions.session_counters(_stream(spark, folder)), "counters", ["session_id"]))


@query
def stream_session_status(spark, folder):
    messages = derived.session_messages(t.raw_stream(spark, folder))
    return drain_update(sessions.session_status(messages), "status", ["session_id"])


@query
def stream_store(spark, folder):
    """The store filled by a stream, then read by a new consumer: newest events first."""
    path, checkpoint = new_folder(spark, "store"), new_folder(spark, "checkpoint")
    store.stream_to_store(_stream(spark, folder), path, checkpoint, every=None).awaitTermination()
    now, _ = streams.consume(spark, path)
    return now.select("seq", "id", "domain", "threat_score")


@query
def stream_handover(spark, folder):
    """A consumer takes its snapshot after part of the events; what the stream then delivers."""
    path = new_folder(spark, "store")
    events = t.events(spark, folder)
    cut = (events.agg(F.max("seq")).first()[0] or 0) * 3 // 5
    store.write_events(events.filter(F.col("seq") <= cut), path)
    _, later = streams.consume(spark, path, 20)
    store.write_events(events.filter(F.col("seq") > cut), path)
    return drain_append(later, "increments").select("seq", "id", "domain", "threat_score")
