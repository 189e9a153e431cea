"""DuckDB SQL for every registered query, over the same tables.

Written from the rules, not from the Spark plans: lookups are value tables, the
typosquat rule is a theta join, suppression and session status are recursive
queries that step through the rows.
"""

from __future__ import annotations

from dnslens import dims
from dnslens.plans.dns_raw import DNS_RAW

ORACLES: dict[str, str] = {}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in row) + ")" for row in rows)


RAW = f"dns_raw AS ({DNS_RAW.format(events='events')})"

EVENTS = f"""{RAW},
types(code, name) AS (VALUES {_values((str(k), v) for k, v in dims.RECORD_TYPES.items())}),
rcodes(code, name) AS (VALUES {_values((str(k), v) for k, v in dims.RCODES.items())}),
ev AS (
 SELECT r.session_id, r.seq, 'evt-' || r.seq AS id, r.event_ts, coalesce(r.domain, 'unknown') AS domain,
  r.source_ip, r.destination_ip, r.destination_port,
  CASE WHEN r.qtype_raw IS NULL THEN 'A' ELSE coalesce(ty.name, upper(r.qtype_raw)) END AS record_type,
  CASE WHEN r.transport = 'tcp' AND r.destination_port = '853' THEN 'DoT'
       WHEN r.transport = 'tcp' AND r.destination_port = '443' THEN 'DoH'
       WHEN r.transport = 'udp' AND r.destination_port = '443' THEN 'DoQ'
       WHEN r.transport = 'tcp' AND r.destination_port = '53' THEN 'DNS/TCP' ELSE 'DNS' END AS protocol,
  r.transport,
  CASE WHEN r.rcode_raw IS NULL THEN 'NOERROR' ELSE coalesce(rc.name, 'RCODE_' || r.rcode_raw) END AS rcode,
  'tshark' AS tool, 'live' AS mode, 'observed' AS confidence, 'python-monitor' AS source,
  r.ttl, r.answers_raw, r.is_response, r.event_type, r.user_id
 FROM dns_raw r LEFT JOIN types ty ON ty.code = r.qtype_raw LEFT JOIN rcodes rc ON rc.code = r.rcode_raw
)"""

BRANDS = f"brands(brand, position) AS (VALUES {_values((b, i) for i, b in enumerate(dims.POPULAR_DOMAINS))})"


def _features(names: str) -> str:
    """Feature CTEs over a CTE ``names(domain)`` of distinct names."""
    return f"""names AS ({names}),
{BRANDS},
weights(tld, weight) AS (VALUES {_values(dims.TLD_WEIGHTS.items())}),
chars AS (SELECT domain, unnest(string_split(lower(domain), '')) AS c FROM names),
shares AS (SELECT domain, c, count(*) / CAST(length(domain) AS DOUBLE) AS p FROM chars GROUP BY domain, c),
bits AS (SELECT domain, -sum(p * log2(p)) AS entropy FROM shares GROUP BY domain),
squats AS (
 SELECT n.domain, arg_min(b.brand, b.position) AS brand FROM names n JOIN brands b
 ON translate(rtrim(lower(n.domain), '.'), 'i10', 'llo') = translate(b.brand, 'i10', 'llo')
  OR (abs(length(rtrim(lower(n.domain), '.')) - length(b.brand)) <= 2 AND levenshtein(rtrim(lower(n.domain), '.'), b.brand) = 1)
 WHERE rtrim(lower(n.domain), '.') NOT IN (SELECT brand FROM brands) GROUP BY n.domain),
feat AS (
 SELECT n.domain, b.entropy, string_split(n.domain, '.')[1] AS label0, len(string_split(n.domain, '.')) AS labels,
  length(n.domain) AS size, CASE WHEN contains(n.domain, '.') THEN lower(string_split(n.domain, '.')[-1]) ELSE '' END AS tld,
  coalesce(w.weight, 0) AS weight, s.brand AS target,
  coalesce(list_max(list_transform(regexp_extract_all(string_split(n.domain, '.')[1], '[{dims.CONSONANTS}]+'), lambda x: length(x))), 0) AS run
 FROM names n JOIN bits b ON b.domain = n.domain LEFT JOIN squats s ON s.domain = n.domain
 LEFT JOIN weights w ON contains(n.domain, '.') AND w.tld = lower(string_split(n.domain, '.')[-1]))"""


POINTS = """
  CASE WHEN f.weight >= 8 THEN 35 WHEN f.weight >= 6 THEN 15 ELSE 0 END AS p1,
  CASE WHEN f.entropy > 4.0 THEN 30 WHEN f.entropy > 3.5 THEN 15 ELSE 0 END AS p2,
  CASE WHEN f.size > 60 THEN 25 WHEN f.size > 40 THEN 10 ELSE 0 END AS p3,
  CASE WHEN regexp_matches(f.label0, '\\p{Nd}{4,}') THEN 10 ELSE 0 END AS p4,
  CASE WHEN f.run >= 5 THEN 25 ELSE 0 END AS p5,
  CASE WHEN f.labels > 5 THEN 15 ELSE 0 END AS p6,
  CASE WHEN e.record_type IN ('TXT','NULL','ANY','AXFR','IXFR','HINFO','KEY','SIG') THEN 10 ELSE 0 END AS p7,
  CASE WHEN e.rcode = 'NXDOMAIN' THEN 5 WHEN e.rcode IN ('SERVFAIL','REFUSED') THEN 10 ELSE 0 END AS p8,
  CASE WHEN f.target IS NOT NULL THEN 45 ELSE 0 END AS p9"""

SCORED_FROM_EV = f"""pts AS (SELECT e.*, f.entropy, f.tld, f.size, f.run, f.labels, f.target, {POINTS}
 FROM ev e JOIN feat f ON f.domain = e.domain),
scored AS (SELECT *, CAST(p1+p2+p3+p4+p5+p6+p7+p8+p9 AS INTEGER) AS threat_score,
 CASE WHEN p1+p2+p3+p4+p5+p6+p7+p8+p9 >= 60 THEN 'high' WHEN p1+p2+p3+p4+p5+p6+p7+p8+p9 >= 30 THEN 'medium' ELSE 'low' END AS threat_level,
 list_filter([
  CASE p1 WHEN 35 THEN 'Suspicious TLD (.' || tld || ')' WHEN 15 THEN 'Suboptimal TLD (.' || tld || ')' END,
  CASE p2 WHEN 30 THEN printf('High domain entropy (%.2f)', entropy) WHEN 15 THEN printf('Elevated domain entropy (%.2f)', entropy) END,
  CASE p3 WHEN 25 THEN 'Very long domain name (' || size || ' chars)' WHEN 10 THEN 'Long domain name (' || size || ' chars)' END,
  CASE p4 WHEN 10 THEN 'Numeric-heavy subdomain label' END,
  CASE p5 WHEN 25 THEN 'DGA heuristic (' || run || ' consecutive consonants)' END,
  CASE p6 WHEN 15 THEN 'Excessive subdomain depth (' || labels || ' labels)' END,
  CASE p7 WHEN 10 THEN 'Unusual record type (' || record_type || ')' END,
  CASE p8 WHEN 5 THEN 'NXDOMAIN response' WHEN 10 THEN 'Error response (' || rcode || ')' END,
  CASE p9 WHEN 45 THEN 'Potential typosquatting of ' || target END], lambda x: x IS NOT NULL) AS reasons
 FROM pts)"""

FEATURES = EVENTS + ",\n" + _features("SELECT DISTINCT domain FROM ev")
SCORED = FEATURES + ",\n" + SCORED_FROM_EV

TEXT_ANSWERS = "replace(answers_raw, ';', '|')"
REASONS = "array_to_string(reasons, '|')"


def oracle(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


# --- normalisation -----------------------------------------------------------------

oracle("normalize_events_fields", EVENTS, f"""
SELECT session_id, seq, id, event_ts, domain, source_ip, destination_ip, destination_port, record_type, protocol,
 transport, rcode, tool, mode, confidence, source, ttl, {TEXT_ANSWERS} AS answers,
 CASE WHEN answers_raw IS NOT NULL THEN CAST(2 AS INTEGER) END AS answer_count, is_response FROM ev""")

oracle("normalize_payloads", EVENTS, """
SELECT session_id, seq, event_ts,
 CASE seq % 5 WHEN 0 THEN domain WHEN 1 THEN 'unknown' ELSE domain END AS domain,
 source_ip, destination_ip, upper(coalesce((SELECT any_value(r.qtype_raw) FROM dns_raw r WHERE r.seq = ev.seq), 'A')) AS record_type,
 'DNS' AS protocol, transport, CASE seq % 5 WHEN 3 THEN 'scapy' ELSE 'auto' END AS tool, 'live' AS mode,
 'observed' AS confidence, 'python-monitor' AS source,
 (SELECT any_value(r.rcode_raw) FROM dns_raw r WHERE r.seq = ev.seq) AS rcode, ttl FROM ev""")

oracle("record_type_lookup", EVENTS, """
SELECT r.qtype_raw, e.record_type, count(*) AS events FROM ev e JOIN dns_raw r ON r.seq = e.seq GROUP BY ALL""")
oracle("rcode_lookup", EVENTS, """
SELECT r.rcode_raw, e.rcode, count(*) AS events FROM ev e JOIN dns_raw r ON r.seq = e.seq GROUP BY ALL""")
oracle("protocol_detect", EVENTS, """
SELECT transport, destination_port, protocol, count(*) AS events FROM ev GROUP BY ALL""")
oracle("method_classes", EVENTS, """
SELECT protocol, CASE upper(protocol) WHEN 'DOH' THEN 'doh' WHEN 'DOT' THEN 'dot' ELSE 'dns' END AS method_class,
 count(*) AS events FROM ev GROUP BY ALL""")
oracle("oriented_events", EVENTS, """
SELECT seq, CASE WHEN is_response THEN destination_ip ELSE source_ip END AS source_ip,
 CASE WHEN is_response THEN source_ip ELSE destination_ip END AS destination_ip, destination_port, protocol FROM ev""")

# --- threat scoring ------------------------------------------------------------------

oracle("name_feature_table", FEATURES, """
SELECT domain, tld, round(entropy, 6) AS entropy, size AS name_length, labels AS label_count,
 CAST(CASE WHEN run >= 5 THEN run ELSE 0 END AS BIGINT) AS consonant_run, target AS typo_target FROM feat""")
ORACLES["domain_entropy"] = """
WITH chars AS (SELECT page_id, length(url) AS size, unnest(string_split(lower(url), '')) AS c FROM pages),
 shares AS (SELECT page_id, c, count(*) / CAST(any_value(size) AS DOUBLE) AS p FROM chars GROUP BY page_id, c)
SELECT page_id, round(-sum(p * log2(p)), 6) AS entropy FROM shares GROUP BY page_id"""
oracle("typosquat", FEATURES, "SELECT domain, brand FROM squats")
ORACLES["typosquat_join"] = ORACLES["typosquat"]
ORACLES["name_twins"] = """
WITH n AS (SELECT DISTINCT lower(c_name) AS domain FROM customer),
 b AS (SELECT replace(lower(s_name), 'supplier', 'customer') AS brand, s_suppkey AS position FROM supplier)
SELECT n.domain, arg_min(b.brand, b.position) AS brand FROM n JOIN b
 ON translate(n.domain, 'i10', 'llo') = translate(b.brand, 'i10', 'llo') OR levenshtein(n.domain, b.brand) = 1
WHERE n.domain NOT IN (SELECT brand FROM b) GROUP BY n.domain"""
oracle("threat_scores", SCORED, f"""
SELECT seq, domain, record_type, rcode, threat_score, threat_level, {REASONS} AS threat_reasons FROM scored""")
for _name in ("threat_scores_per_name", "threat_scores_brand_table", "stream_threat_scores"):
    ORACLES[_name] = ORACLES["threat_scores"]
oracle("rule_points", SCORED, """
SELECT seq, p1 AS points_tld, p2 AS points_entropy, p3 AS points_length, p4 AS points_numeric, p5 AS points_consonants,
 p6 AS points_depth, p7 AS points_record_type, p8 AS points_rcode, p9 AS points_typosquat FROM scored""")
ORACLES["threat_reason_counts"] = f"""WITH {SCORED}, r AS (SELECT unnest(reasons) AS reason FROM scored)
SELECT trim(CASE WHEN contains(reason, '(') THEN split_part(reason, '(', 1) ELSE split_part(reason, ' of ', 1) END) AS reason,
 count(*) AS events FROM r GROUP BY 1"""
oracle("tld_weights", FEATURES, """
SELECT w.tld, count(*) AS events, CAST(w.weight AS INTEGER) AS weight FROM ev JOIN feat f ON f.domain = ev.domain
JOIN weights w ON w.tld = f.tld GROUP BY w.tld, w.weight""")

TOP_DOMAINS = """(SELECT domain AS value, count(*) AS events FROM scored WHERE domain <> 'unknown' GROUP BY domain
 ORDER BY count(*) DESC, max(seq) DESC LIMIT 8)"""
oracle("threat_report", SCORED, f"""
SELECT 'threat_level' AS section, threat_level AS value, count(*) AS events FROM scored GROUP BY threat_level
UNION ALL SELECT 'domain', value, events FROM {TOP_DOMAINS}""")
HOST = "rtrim(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.')"
ORACLES["url_hosts"] = f"SELECT page_id, {HOST} AS host FROM pages"
ORACLES["url_threats"] = f"""
WITH ev AS (SELECT page_id, {HOST} AS domain, 'A' AS record_type, 'NOERROR' AS rcode FROM pages),
{_features("SELECT DISTINCT domain FROM ev")}, {SCORED_FROM_EV}
SELECT page_id, domain, threat_score, threat_level, {REASONS} AS threat_reasons FROM scored"""

# --- summary -----------------------------------------------------------------------------

RATE = """CASE WHEN count(*) < 2 THEN 0.0 ELSE CAST(printf('%.1f', count(*) / greatest(
  (epoch_us(arg_max(event_ts, seq)) - epoch_us(arg_min(event_ts, seq))) / 1e6 / 60.0, 1.0 / 60.0)) AS DOUBLE) END"""


def _top(column: str, source: str, unknown: str | None) -> str:
    where = f"WHERE {column} <> '{unknown}'" if unknown else ""
    return f"(SELECT {column} FROM {source} {where} GROUP BY {column} ORDER BY count(*) DESC, max(seq) DESC LIMIT 1)"


def _scalars(source: str) -> str:
    return f"""SELECT count(*) AS total_events, arg_max(event_ts, seq) AS last_event_at, {RATE} AS events_per_minute,
 printf('%.2f', floor({RATE} / 60.0 * 100 + 0.5) / 100) AS avg_qps,
 count(DISTINCT CASE WHEN domain <> 'unknown' THEN domain END) AS unique_domains,
 {_top('domain', source, 'unknown')} AS top_domain, {_top('source_ip', source, 'unknown')} AS top_source_ip,
 {_top('record_type', source, 'UNKNOWN')} AS top_record_type FROM {source}"""


oracle("summary_scalars", EVENTS, _scalars("ev"))
oracle("buffer_summary", EVENTS + ", buf AS (SELECT * FROM ev ORDER BY seq DESC LIMIT 500)", _scalars("buf"))
TOTALS = f"""SELECT count(*) AS total_events, arg_max(event_ts, seq) AS last_event_at, {RATE} AS events_per_minute,
 printf('%.2f', floor({RATE} / 60.0 * 100 + 0.5) / 100) AS avg_qps FROM ev"""
oracle("events_per_minute", EVENTS, TOTALS)
oracle("session_rates", EVENTS, f"""
SELECT session_id, {RATE} AS events_per_minute, printf('%.2f', floor({RATE} / 60.0 * 100 + 0.5) / 100) AS avg_qps
FROM ev GROUP BY session_id""")
for _dim in ("transport", "record_type", "rcode"):
    oracle(f"{_dim}_breakdown", EVENTS, f"SELECT {_dim}, count(*) AS events FROM ev GROUP BY {_dim}")
oracle("threat_breakdown", SCORED, "SELECT threat_level, count(*) AS events FROM scored GROUP BY threat_level")
for _query, _dim, _k in (("top_domains", "domain", 8), ("top_source_ips", "source_ip", 5)):
    oracle(_query, EVENTS, f"""
SELECT {_dim}, count(*) AS events FROM ev WHERE {_dim} <> 'unknown' GROUP BY {_dim} ORDER BY count(*) DESC, max(seq) DESC LIMIT {_k}""")
oracle("summary_long", SCORED, f"""
SELECT 'threat_level' AS section, threat_level AS value, count(*) AS events FROM scored GROUP BY threat_level
UNION ALL SELECT 'record_type', record_type, count(*) FROM scored WHERE record_type <> 'UNKNOWN' GROUP BY record_type
UNION ALL SELECT 'transport', transport, count(*) FROM scored GROUP BY transport
UNION ALL SELECT 'rcode', rcode, count(*) FROM scored GROUP BY rcode
UNION ALL SELECT 'domain', value, events FROM {TOP_DOMAINS}
UNION ALL SELECT 'source_ip', value, events FROM (SELECT source_ip AS value, count(*) AS events FROM scored GROUP BY source_ip
 ORDER BY count(*) DESC, max(seq) DESC LIMIT 5)""")
oracle("summary_record", SCORED + f""",
lv AS (SELECT threat_level, count(*) AS n FROM scored GROUP BY threat_level),
td AS (SELECT domain, count(*) AS n, max(seq) AS s FROM scored WHERE domain <> 'unknown' GROUP BY domain ORDER BY n DESC, s DESC LIMIT 8)""", """
SELECT (SELECT count(*) FROM scored) AS total_events,
 (SELECT count(DISTINCT domain) FROM scored WHERE domain <> 'unknown') AS unique_domains,
 (SELECT string_agg(threat_level || '=' || n, ',' ORDER BY threat_level) FROM lv) AS levels,
 (SELECT string_agg(domain || '=' || n, ',' ORDER BY n DESC, s DESC) FROM td) AS tops""")
oracle("latest_events", EVENTS, "SELECT id, seq, domain FROM ev ORDER BY seq DESC LIMIT 500")

# --- filters and views ---------------------------------------------------------------------

FOUND = "seq, domain, record_type, source_ip"
JOINED = "lower(domain || ' ' || record_type || ' ' || source_ip || ' ' || destination_ip || ' ' || tool || ' ' || mode || ' ' || transport)"
ANY = ["domain", "record_type", "source_ip", "destination_ip", "transport", "tool", "mode", "protocol", "threat_level"]


def _any(term: str) -> str:
    return "(" + " OR ".join(f"contains(lower({name}), '{term.lower()}')" for name in ANY) + ")"


oracle("search_joined", EVENTS, f"SELECT {FOUND} FROM ev WHERE contains({JOINED}, 'aaaa 192.168.1')")
oracle("snapshot_view", EVENTS, f"SELECT {FOUND} FROM ev WHERE contains({JOINED}, 'github') ORDER BY seq DESC LIMIT 50")
oracle("search_any", SCORED, f"SELECT {FOUND} FROM scored WHERE {_any('HIGH')}")
oracle("search_field_client", EVENTS, f"SELECT {FOUND} FROM ev WHERE contains(source_ip, '168.3.1')")
oracle("search_regex", EVENTS, f"SELECT {FOUND} FROM ev WHERE regexp_matches(domain, '^[A-F0-9]{{8}}\\.buzz$', 'i')")
oracle("search_regex_invalid", SCORED, f"SELECT {FOUND} FROM scored WHERE NOT {_any('/(unclosed/')}")
oracle("search_exclude", SCORED, f"SELECT {FOUND} FROM scored WHERE NOT {_any('example')}")
oracle("type_group", EVENTS, f"SELECT {FOUND} FROM ev WHERE record_type IN ('MX', 'TXT')")
oracle("focus_ip", EVENTS, f"""
SELECT {FOUND} FROM ev WHERE contains(source_ip, '2606:4700:4700::1111') OR contains(destination_ip, '2606:4700:4700::1111')""")
oracle("clear_cutoff", EVENTS, f"""
SELECT {FOUND} FROM ev WHERE coalesce(event_ts > (SELECT max(event_ts) FROM ev WHERE rcode = 'RCODE_11'), true)""")
oracle("filtered_view", EVENTS, f"""
SELECT {FOUND} FROM ev WHERE record_type IN ('A', 'AAAA', 'HTTPS', 'CNAME')
 AND (contains(source_ip, '192.168.2') OR contains(destination_ip, '192.168.2')) AND NOT contains(lower(domain), 'google')""")
oracle("selected_rows", EVENTS, f"""
SELECT {FOUND} FROM ev WHERE record_type IN ('MX', 'TXT') AND (rcode = 'REFUSED'
 OR NOT EXISTS (SELECT 1 FROM ev x WHERE x.record_type IN ('MX', 'TXT') AND x.rcode = 'REFUSED'))""")
oracle("view_counts", EVENTS, """
SELECT count(*) AS results, count(*) FILTER (rcode = 'REFUSED') AS selected FROM ev WHERE record_type IN ('MX', 'TXT')""")
oracle("dns_ports", RAW, """
SELECT seq, CAST(40000 + seq % 1000 AS INTEGER) AS source_port, CAST(destination_port AS INTEGER) AS destination_port
FROM dns_raw WHERE destination_port IN ('53', '443', '853')""")
oracle("dns_only", RAW, """
SELECT seq, domain || '.' AS domain FROM dns_raw WHERE event_type <> 'signup' AND domain IS NOT NULL""")
oracle("known_values", EVENTS, """
SELECT count(*) FILTER (domain <> 'unknown') AS domain, count(*) FILTER (source_ip <> 'unknown') AS source_ip,
 count(*) FILTER (record_type <> 'UNKNOWN') AS record_type, count(*) FILTER (rcode <> '') AS rcode FROM ev""")
REDIRECTED = "(threat_level = 'high' AND NOT is_response AND transport = 'udp')"
oracle("table_view", SCORED, f"""
SELECT seq, event_ts AS time, domain, record_type AS type, upper(protocol) AS method,
 CASE WHEN {REDIRECTED} THEN 'SPOOFED' ELSE upper(threat_level) END AS threat, source_ip AS client,
 destination_ip AS resolver, transport || ' / ' || protocol AS carrier, tool, mode,
 CASE upper(protocol) WHEN 'DOH' THEN 'doh' WHEN 'DOT' THEN 'dot' ELSE 'dns' END AS method_class FROM scored""")
oracle("detail_view", SCORED, f"""
SELECT id, domain, record_type, protocol, transport, rcode AS response_code, source_ip AS client_ip,
 destination_ip AS resolver_ip, destination_port AS port, coalesce(ttl || 's', 'N/A') AS ttl, tool, mode,
 event_ts AS timestamp, confidence, threat_score || '/100' AS score_label, least(threat_score, 100) AS bar_width,
 threat_level, {REASONS} AS threat_reasons, coalesce({TEXT_ANSWERS}, '') AS answers FROM scored""")
oracle("page", EVENTS, f"SELECT {FOUND} FROM ev WHERE seq < 800 ORDER BY seq DESC LIMIT 100")
ORACLES["store_page"] = ORACLES["page"]
oracle("latest_by_id", EVENTS, """
SELECT domain, max(seq) AS seq, arg_max(source_ip, seq) AS source_ip FROM ev GROUP BY domain""")
oracle("first_events", EVENTS, f"SELECT {FOUND} FROM ev ORDER BY seq LIMIT 250")
oracle("time_order", EVENTS, "SELECT seq, event_ts FROM ev ORDER BY event_ts, seq")
oracle("chart_labels", EVENTS, """
SELECT DISTINCT domain, CASE WHEN length(domain) > 28 THEN left(domain, 26) || '…' ELSE domain END AS label FROM ev""")
oracle("age_labels", EVENTS + """,
ages AS (SELECT seq, CAST(floor((epoch_us((SELECT max(event_ts) FROM ev)) - epoch_us(event_ts)) / 1e6 + 0.5) AS BIGINT) AS s FROM ev)""", """
SELECT seq, CASE WHEN s < 5 THEN 'Just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago'
 ELSE (s // 3600) || 'h ago' END AS age FROM ages""")

# --- sessions and activity --------------------------------------------------------------------

STATS = " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {name} AS value, count(*) AS events, min(seq) AS first_seq FROM ev GROUP BY {name}"
    for name in ("domain", "record_type", "source_ip", "transport", "rcode")
) + " UNION ALL SELECT 'total', NULL, count(*), min(seq) FROM ev"
oracle("session_stats", EVENTS, f"SELECT dimension, value, events FROM ({STATS})")
oracle("session_report", EVENTS + f""", stats AS ({STATS}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY events DESC, first_seq) AS INTEGER) AS rank FROM stats)""", """
SELECT dimension, rank, value, events FROM ranked
WHERE rank <= CASE dimension WHEN 'transport' THEN 10 WHEN 'total' THEN 1 ELSE 5 END""")
oracle("activity_sample", EVENTS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rank FROM ev)""", """
SELECT session_id, seq, event_ts, rank, 'info' AS level, 'Observed ' || record_type || ' query for ' || domain AS message
FROM r WHERE rank IN (1, 5) OR rank % 25 = 0""")
ORACLES["activity_sample_chunked"] = ORACLES["activity_sample"]
COLLAPSED = RAW + """,
act AS (SELECT session_id, seq, event_ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  'seen ' || event_type AS message FROM dns_raw WHERE event_type <> 'signup'),
marked AS (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER w AND message IS NOT DISTINCT FROM lag(message) OVER w
  THEN 0 ELSE 1 END AS start FROM act WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
runs AS (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM marked),
collapsed AS (SELECT session_id, min(seq) AS first_seq, level, message, arg_max(event_ts, seq) AS event_ts, count(*) AS entries
  FROM runs GROUP BY session_id, run, level, message)"""
oracle("activity_collapse", COLLAPSED, "SELECT * FROM collapsed")
ORACLES["activity_collapse_chunked"] = ORACLES["activity_collapse"]
oracle("recent_activity", COLLAPSED, """
SELECT * FROM collapsed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_seq DESC) <= 40""")

MESSAGES = RAW + """,
msg AS (SELECT session_id, seq, event_ts,
  CASE WHEN user_id % 8 > 3 AND seq % 97 = 3 THEN 'stop' WHEN seq % 13 = 4 THEN 'error' WHEN seq % 13 = 5 THEN 'stderr'
       WHEN seq % 13 IN (6, 7, 8) THEN 'status' ELSE 'event' END AS kind,
  CASE seq % 3 WHEN 0 THEN 'tshark' WHEN 1 THEN 'scapy' END AS tool,
  ['running', 'completed', 'stopping', 'starting', 'interrupted'][seq % 5 + 1] AS status, 'failure ' || seq AS message FROM dns_raw),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM msg),
walk AS (
 SELECT session_id, CAST(0 AS BIGINT) AS n, 'starting' AS state, false AS stop_requested
 FROM (SELECT DISTINCT session_id FROM msg)
 UNION ALL
 SELECT w.session_id, m.n,
  CASE m.kind WHEN 'event' THEN CASE WHEN w.state = 'stopping' THEN 'stopping' ELSE 'running' END
   WHEN 'error' THEN 'error' WHEN 'stop' THEN 'stopping' WHEN 'stderr' THEN w.state
   ELSE CASE WHEN m.status IN ('completed', 'stopped', 'interrupted')
     THEN CASE WHEN w.stop_requested OR w.state = 'stopping' THEN 'stopping' ELSE 'running' END ELSE m.status END END,
  w.stop_requested OR m.kind = 'stop'
 FROM walk w JOIN numbered m ON m.session_id = w.session_id AND m.n = w.n + 1),
final AS (SELECT session_id, arg_max(state, n) AS status, arg_max(stop_requested, n) AS stop_requested FROM walk GROUP BY session_id)"""
oracle("session_status", MESSAGES, "SELECT session_id, status, stop_requested FROM final", recursive=True)
ORACLES["stream_session_status"] = ORACLES["session_status"]
oracle("session_ledger", MESSAGES + """,
agg AS (SELECT session_id, count(*) FILTER (kind = 'event') AS events_seen,
  arg_max(event_ts, seq) FILTER (kind = 'event') AS last_event_at,
  arg_max(tool, seq) FILTER (kind IN ('event', 'status') AND tool IS NOT NULL) AS tool FROM msg GROUP BY session_id),
errs AS (SELECT session_id, string_agg(message, '|' ORDER BY seq) AS errors FROM
  (SELECT * FROM msg WHERE kind IN ('error', 'stderr') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6)
  GROUP BY session_id)""", """
SELECT a.session_id, a.events_seen, a.last_event_at, a.tool, f.stop_requested, coalesce(e.errors, '') AS errors,
 CASE WHEN CAST(split_part(a.session_id, '-', 2) AS INTEGER) >= 7 THEN f.status
  WHEN f.stop_requested AND f.status <> 'error' THEN 'stopped' WHEN f.status IN ('error', 'stopped') THEN f.status
  WHEN CAST(split_part(a.session_id, '-', 2) AS INTEGER) % 3 = 0 THEN 'completed' ELSE 'error' END AS status
FROM agg a JOIN final f ON f.session_id = a.session_id LEFT JOIN errs e ON e.session_id = a.session_id""", recursive=True)
ENVELOPES = EVENTS + """,
env AS (
 SELECT ev.session_id, ev.seq, 'event' AS kind, ev.event_ts, CASE WHEN ev.seq % 5 = 3 THEN 'scapy' END AS tool, NULL AS status, 'info' AS level,
  'Observed ' || upper(coalesce(r.qtype_raw, 'A')) || ' query for ' || CASE WHEN ev.seq % 5 = 1 THEN 'unknown' ELSE ev.domain END AS message
 FROM ev JOIN dns_raw r ON r.seq = ev.seq WHERE ev.seq % 11 NOT IN (3, 5, 6, 7, 8, 9)
 UNION ALL
 SELECT session_id, seq, 'status', NULL, NULL, ['running', 'completed', 'running', 'stopping', 'interrupted'][seq % 5 + 1], 'info', 'note ' || seq
 FROM dns_raw WHERE seq % 11 = 3
 UNION ALL
 SELECT session_id, seq, CASE WHEN seq % 11 = 7 THEN 'stderr' ELSE 'error' END, NULL, NULL, NULL, 'error',
  CASE seq % 11 WHEN 5 THEN 'failure ' || seq WHEN 6 THEN 'Unknown capture error'
   ELSE 'Unreadable monitor payload: {"kind": "event", "domain": "cut-' || seq END
 FROM dns_raw WHERE seq % 11 IN (5, 6, 7))"""
oracle("activity_feed", ENVELOPES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY seq) AS n FROM env),
act AS (SELECT * FROM ranked WHERE kind <> 'event' OR n IN (1, 5) OR n % 25 = 0),
marked AS (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER w AND message IS NOT DISTINCT FROM lag(message) OVER w
  THEN 0 ELSE 1 END AS start FROM act WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
runs AS (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM marked),
ends AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY seq DESC) AS back FROM runs)""", """
SELECT session_id, min(seq) AS first_seq, level, message, any_value(event_ts) FILTER (back = 1) AS event_ts, count(*) AS entries
FROM ends GROUP BY session_id, run, level, message""")
ORACLES["activity_feed_chunked"] = ORACLES["stream_activity_feed"] = ORACLES["activity_feed"]
oracle("summary_activity", ORACLES["activity_feed"][5:ORACLES["activity_feed"].rindex("\nSELECT session_id, min(seq)")] + """,
newest AS (SELECT min(seq) AS first_seq, level, message FROM ends GROUP BY session_id, run, level, message ORDER BY first_seq DESC LIMIT 40)""", """
SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT count(DISTINCT domain) FROM ev WHERE domain <> 'unknown') AS unique_domains,
 (SELECT count(DISTINCT user_id) FROM dns_raw) AS history_count,
 (SELECT string_agg(level || ' ' || message, '|' ORDER BY first_seq DESC) FROM newest) AS activity""")
oracle("ledger_from_envelopes", ENVELOPES + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM env),
walk AS (
 SELECT session_id, CAST(0 AS BIGINT) AS n, 'starting' AS state FROM (SELECT DISTINCT session_id FROM env)
 UNION ALL
 SELECT w.session_id, m.n,
  CASE m.kind WHEN 'event' THEN CASE WHEN w.state = 'stopping' THEN 'stopping' ELSE 'running' END
   WHEN 'error' THEN 'error' WHEN 'stderr' THEN w.state
   ELSE CASE WHEN m.status IN ('completed', 'stopped', 'interrupted')
     THEN CASE WHEN w.state = 'stopping' THEN 'stopping' ELSE 'running' END ELSE m.status END END
 FROM walk w JOIN numbered m ON m.session_id = w.session_id AND m.n = w.n + 1),
final AS (SELECT session_id, arg_max(state, n) AS state, CAST(split_part(session_id, '-', 2) AS INTEGER) AS number FROM walk GROUP BY session_id),
agg AS (SELECT session_id, count(*) FILTER (kind = 'event') AS events_seen, arg_max(event_ts, seq) FILTER (kind = 'event') AS last_event_at,
  min(event_ts) AS first_at, max(event_ts) AS last_at, arg_max(tool, seq) FILTER (tool IS NOT NULL) AS tool,
  arg_max(message, seq) FILTER (kind <> 'stderr') AS note FROM env GROUP BY session_id),
errs AS (SELECT session_id, string_agg(message, '|' ORDER BY seq) AS errors FROM
  (SELECT * FROM env WHERE kind IN ('error', 'stderr') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6)
  GROUP BY session_id)""", """
SELECT a.session_id AS id,
 CASE WHEN number >= 7 OR state IN ('error', 'stopped') THEN state WHEN number % 3 = 0 THEN 'completed' ELSE 'error' END AS status, a.tool,
 CASE WHEN number >= 7 OR state IN ('error', 'stopped') THEN note WHEN number % 3 = 0 THEN 'Capture finished successfully.'
  ELSE 'Capture exited with status code ' || (number % 3) || '.' END AS note,
 date_trunc('millisecond', first_at) AS started_at, CASE WHEN number < 7 THEN date_trunc('millisecond', last_at) END AS ended_at,
 date_trunc('millisecond', last_event_at) AS last_event_at, events_seen, coalesce(errors, '') AS errors
FROM agg a JOIN final f ON f.session_id = a.session_id LEFT JOIN errs e ON e.session_id = a.session_id""", recursive=True)
oracle("session_counters", EVENTS, """
SELECT session_id, count(*) AS events_seen, arg_max(event_ts, seq) AS last_event_at FROM ev GROUP BY session_id""")
ORACLES["stream_session_counters"] = ORACLES["session_counters"]
STORED = RAW + """,
stored AS (SELECT 'session-' || (epoch_us(min(event_ts)) // 1000) || '-' || user_id AS id,
  CASE WHEN user_id % 3 = 0 THEN 'stopped' ELSE 'completed' END AS status, min(event_ts) AS started_at,
  max(event_ts) AS ended_at, count(*) AS events_seen, user_id FROM dns_raw GROUP BY user_id)"""
oracle("recent_sessions", STORED, """
SELECT id, status, started_at, ended_at, events_seen FROM stored ORDER BY ended_at DESC, id DESC LIMIT 50""")
oracle("session_view", STORED, """
SELECT left(replace(id, 'session-', ''), 8) AS session, CASE WHEN user_id % 2 = 0 THEN 'MANUAL' ELSE 'LIVE' END AS mode,
 started_at, events_seen, status FROM stored""")
oracle("session_durations", STORED + """,
d AS (SELECT id, started_at, (epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS s FROM stored)""", """
SELECT id, 'session-' || (epoch_us(started_at) // 1000) AS session_id, (s // 60) || 'm ' || (s % 60) || 's' AS duration FROM d""")
oracle("session_store", STORED, """
SELECT id, status, 'first' AS note, events_seen, date_trunc('millisecond', started_at) AS started_at,
 date_trunc('millisecond', ended_at) AS ended_at FROM stored ORDER BY stored.ended_at DESC, id DESC LIMIT 50""")
oracle("history_count", STORED, "SELECT count(*) AS history_count FROM stored")
oracle("union_sources", EVENTS, """
SELECT 'tshark' AS tool, record_type, count(*) AS events FROM ev JOIN dns_raw r ON r.seq = ev.seq
 WHERE r.domain IS NOT NULL GROUP BY record_type
UNION ALL SELECT 'scapy', CASE WHEN r.qtype_raw IS NULL OR r.qtype_raw = 'txt' THEN 'A' ELSE ev.record_type END, count(*)
 FROM ev JOIN dns_raw r ON r.seq = ev.seq WHERE r.domain IS NOT NULL AND r.event_type <> 'signup' GROUP BY 2""")
oracle("address_sets", EVENTS, """
SELECT DISTINCT domain, 'ipv4' AS family, unnest(string_split(answers_raw, ';')) AS address FROM ev WHERE answers_raw IS NOT NULL""")

# --- alerts, series, policy ---------------------------------------------------------------------

oracle("traffic_series", EVENTS + """,
c AS (SELECT date_trunc('hour', event_ts) AS b, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT max(b) FROM c) - INTERVAL 59 HOUR, (SELECT max(b) FROM c), INTERVAL 1 HOUR)) AS b)""", """
SELECT g.b AS bucket_start, coalesce(c.n, 0) AS events FROM g LEFT JOIN c ON c.b = g.b""")
oracle("traffic_series_ms", EVENTS + """,
c AS (SELECT time_bucket(INTERVAL 100 MILLISECOND, event_ts) AS b, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT max(b) FROM c) - INTERVAL 5900 MILLISECOND, (SELECT max(b) FROM c), INTERVAL 100 MILLISECOND)) AS b)""", """
SELECT g.b AS bucket_start, coalesce(c.n, 0) AS events FROM g LEFT JOIN c ON c.b = g.b""")
ALERT_ROWS = SCORED + """,
cand AS (SELECT seq, event_ts, domain, threat_level,
  CASE WHEN len(reasons) = 0 THEN 'Suspicious activity detected' ELSE array_to_string(reasons[1:2], ' • ') END AS message
  FROM scored WHERE threat_level <> 'low')"""
CHAIN = """,
chain AS (
 SELECT domain, min(event_ts) AS ts FROM cand GROUP BY domain
 UNION ALL
 SELECT c.domain, (SELECT min(x.event_ts) FROM cand x WHERE x.domain = c.domain AND x.event_ts >= c.ts + INTERVAL 6 HOUR)
 FROM chain c WHERE c.ts IS NOT NULL)"""
oracle("alerts", ALERT_ROWS + CHAIN, """
SELECT arg_min(k.seq, k.seq) AS seq, k.event_ts, k.domain, arg_min(k.threat_level, k.seq) AS threat_level,
 arg_min(k.message, k.seq) AS message
FROM cand k JOIN chain c ON c.domain = k.domain AND c.ts = k.event_ts GROUP BY k.domain, k.event_ts""", recursive=True)
ORACLES["alerts_split"] = ORACLES["alerts"]
ORACLES["stream_alerts"] = ORACLES["alerts"]
oracle("alerts_field_lines", ALERT_ROWS.replace("cand AS (SELECT seq", "everything AS (SELECT seq") + """,
lined AS (SELECT e.* REPLACE (CASE WHEN e.seq % 7 = 6 THEN NULL ELSE e.event_ts END AS event_ts)
 FROM everything e JOIN dns_raw r ON r.seq = e.seq WHERE r.domain IS NOT NULL),
cand AS (SELECT * FROM lined WHERE event_ts IS NOT NULL)""" + CHAIN, """
SELECT arg_min(k.seq, k.seq) AS seq, k.event_ts, k.domain, arg_min(k.threat_level, k.seq) AS threat_level,
 arg_min(k.message, k.seq) AS message
FROM cand k JOIN chain c ON c.domain = k.domain AND c.ts = k.event_ts GROUP BY k.domain, k.event_ts
UNION ALL SELECT seq, event_ts, domain, threat_level, message FROM lined WHERE event_ts IS NULL""", recursive=True)
ORACLES["alerts_field_lines_split"] = ORACLES["alerts_field_lines"]
ORACLES["stream_alerts_field_lines"] = ORACLES["alerts_field_lines"]
oracle("alerts_arrival", ALERT_ROWS + """,
short AS (SELECT * REPLACE (string_split(domain, '.')[-1] AS domain), row_number() OVER (ORDER BY seq) AS n FROM cand),
walk AS (
 SELECT n, seq, domain AS last_domain, event_ts AS last_ts, true AS kept FROM short WHERE n = 1
 UNION ALL
 SELECT s.n, s.seq,
  CASE WHEN s.domain = w.last_domain AND s.event_ts - w.last_ts < INTERVAL 6 HOUR THEN w.last_domain ELSE s.domain END,
  CASE WHEN s.domain = w.last_domain AND s.event_ts - w.last_ts < INTERVAL 6 HOUR THEN w.last_ts ELSE s.event_ts END,
  NOT (s.domain = w.last_domain AND s.event_ts - w.last_ts < INTERVAL 6 HOUR)
 FROM walk w JOIN short s ON s.n = w.n + 1)""", """
SELECT s.seq, s.event_ts, s.domain, s.threat_level, s.message FROM short s JOIN walk w ON w.seq = s.seq WHERE w.kept""",
       recursive=True)
oracle("focus_alerts", SCORED, """
SELECT seq, event_ts, CASE WHEN threat_level = 'high' THEN 'error' ELSE 'warning' END AS level,
 'Observed targeted activity from 192.168.1.27 for ' || domain AS message FROM scored
WHERE source_ip = '192.168.1.27' OR destination_ip = '192.168.1.27'""")
ORACLES["stream_focus_alerts"] = ORACLES["focus_alerts"]
oracle("redirect_policy", SCORED, f"""
SELECT seq, CASE WHEN {REDIRECTED} THEN 'sinkholed' END AS action,
 CASE WHEN {REDIRECTED} THEN '10.9.9.9' ELSE answers_raw END AS answers,
 CASE WHEN answers_raw IS NOT NULL THEN CAST(2 AS BIGINT) END AS answer_count FROM scored""")

# --- sources and sinks ----------------------------------------------------------------------------

oracle("fields_ingest", EVENTS, f"""
SELECT ev.seq, 'evt-' || ev.seq AS id, CASE WHEN ev.seq % 7 = 6 THEN NULL ELSE ev.event_ts END AS event_ts, ev.domain, ev.source_ip,
 ev.destination_ip, ev.destination_port, record_type, protocol, ev.transport, ev.rcode, 'tshark' AS tool, 'manual' AS mode,
 confidence, source, ev.ttl,
 nullif(concat_ws('|', replace(ev.answers_raw, ';', '|'), CASE WHEN ev.seq % 3 = 0 THEN 'alias.example.net' END), '') AS answers,
 CAST(nullif(CASE WHEN ev.answers_raw IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN ev.seq % 3 = 0 THEN 1 ELSE 0 END, 0) AS INTEGER) AS answer_count
FROM ev JOIN dns_raw r ON r.seq = ev.seq WHERE r.domain IS NOT NULL""")
oracle("fields_file_ingest", RAW + ", n AS (SELECT *, row_number() OVER (ORDER BY seq) AS line FROM dns_raw)", """
SELECT line AS seq, domain, CASE WHEN seq % 7 = 6 THEN NULL ELSE event_ts END AS event_ts FROM n WHERE domain IS NOT NULL""")
NUMBERED = ", n AS (SELECT seq AS old, row_number() OVER (ORDER BY seq) AS line FROM dns_raw)"
oracle("stream_fields_events", RAW + NUMBERED, """
SELECT line AS seq, 'evt-' || line AS id, domain, CASE WHEN seq % 7 = 6 THEN NULL ELSE event_ts END AS event_ts
FROM dns_raw JOIN n ON old = seq WHERE domain IS NOT NULL""")
oracle("stream_envelope_events", EVENTS + NUMBERED, """
SELECT line AS seq, 'evt-' || line AS id, ev.event_ts, CASE WHEN ev.seq % 5 = 1 THEN 'unknown' ELSE ev.domain END AS domain, ev.source_ip,
 CASE WHEN ev.seq % 5 = 3 THEN 'scapy' ELSE 'auto' END AS tool FROM ev JOIN n ON old = ev.seq WHERE ev.seq % 11 NOT IN (3, 5, 6, 7, 8, 9)""")
oracle("stream_envelope_status", RAW + NUMBERED, """
SELECT line AS seq, ['running', 'completed', 'running', 'stopping', 'interrupted'][seq % 5 + 1] AS status, 'note ' || seq AS note
FROM dns_raw JOIN n ON old = seq WHERE seq % 11 = 3""")
oracle("envelope_events", EVENTS, """
SELECT ev.session_id, ev.seq, ev.event_ts,
 CASE WHEN ev.seq % 5 = 1 THEN 'unknown' ELSE ev.domain END AS domain,
 ev.source_ip, ev.destination_ip, upper(coalesce(r.qtype_raw, 'A')) AS record_type, ev.transport,
 CASE WHEN ev.seq % 5 = 3 THEN 'scapy' ELSE 'auto' END AS tool, r.rcode_raw AS rcode, ev.ttl
FROM ev JOIN dns_raw r ON r.seq = ev.seq WHERE ev.seq % 11 NOT IN (3, 5, 6, 7, 8, 9)""")
oracle("envelope_status", RAW, """
SELECT session_id, seq, ['running', 'completed', 'running', 'stopping', 'interrupted'][seq % 5 + 1] AS status,
 'note ' || seq AS note FROM dns_raw WHERE seq % 11 = 3""")
oracle("envelope_errors", RAW, """
SELECT session_id, seq, CASE WHEN seq % 11 = 7 THEN 'stderr' ELSE 'error' END AS kind,
 CASE seq % 11 WHEN 5 THEN 'failure ' || seq WHEN 6 THEN 'Unknown capture error'
  ELSE 'Unreadable monitor payload: {"kind": "event", "domain": "cut-' || seq END AS message
FROM dns_raw WHERE seq % 11 IN (5, 6, 7)""")
oracle("scan_events", RAW + """,
p AS (SELECT seq, [53, 443, 853][seq % 3 + 1] AS port FROM dns_raw WHERE user_id % 2 = 0)""", """
SELECT seq, 'scan-' || port AS domain, 'SCAN' AS record_type,
 CASE port WHEN 53 THEN 'DNS/TCP' WHEN 443 THEN 'DoH' ELSE 'DoT' END AS protocol, 'tcp' AS transport,
 CAST(port AS VARCHAR) AS destination_port,
 'Open ' || CASE port WHEN 53 THEN 'DNS/TCP' WHEN 443 THEN 'DoH' ELSE 'DoT' END || ' port' AS answers,
 CAST(0 AS INTEGER) AS threat_score, 'scapy-scanner' AS tool, 'scan' AS mode FROM p""")
PACKETS = RAW + """,
pk AS (SELECT seq, CASE WHEN epoch_us(event_ts) % 1000000 = 0 THEN strftime(event_ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso_time,
  epoch_us(event_ts) / 1e6 AS timestamp, epoch_us(event_ts) AS us, source_ip, destination_ip AS dest_ip, upper(transport) AS transport,
  CAST(60 + seq % 400 AS INTEGER) AS packet_length, CAST(seq % 65536 AS INTEGER) AS dns_id, is_response, coalesce(domain, '') AS domain,
  CASE coalesce(try_cast(qtype_raw AS INTEGER), 0) WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT'
   WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 65 THEN 'HTTPS'
   ELSE CAST(coalesce(try_cast(qtype_raw AS INTEGER), 0) AS VARCHAR) END AS qtype,
  CAST(coalesce(rcode_raw, '0') AS INTEGER) AS rcode, CASE WHEN is_response THEN answers_raw END AS a, ttl FROM dns_raw WHERE event_type <> 'signup')"""
oracle("packet_report", PACKETS, """
SELECT iso_time, timestamp, source_ip, dest_ip, transport, packet_length, dns_id, is_response, domain, qtype, rcode,
 coalesce(replace(a, ';', '|'), '') AS answers, CASE WHEN a IS NULL THEN '' ELSE ttl || '|' || ttl END AS ttls FROM pk""")
oracle("packet_counts", RAW, """
SELECT count(*) AS packet_count, count(*) FILTER (event_type <> 'signup') AS dns_event_count FROM dns_raw""")
oracle("packet_csv_rows", PACKETS, """
SELECT iso_time, (us // 1000000) || '.' || CASE WHEN us % 1000000 = 0 THEN '0' ELSE rtrim(lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '0') END AS timestamp,
 source_ip, dest_ip, transport, CAST(packet_length AS VARCHAR) AS packet_length, CAST(dns_id AS VARCHAR) AS dns_id,
 CASE WHEN is_response THEN 'True' ELSE 'False' END AS is_response, domain, qtype, CAST(rcode AS VARCHAR) AS rcode,
 coalesce(replace(a, ';', ', '), '') AS answers, CASE WHEN a IS NULL THEN '' ELSE ttl || ', ' || ttl END AS ttls FROM pk""")
oracle("packets_csv_file", PACKETS + ",\nrep AS (" + ORACLES["packet_csv_rows"][ORACLES["packet_csv_rows"].rindex("SELECT iso_time"):] + ")",
       "SELECT " + ", ".join(f"coalesce({name}, '') AS {name}" for name in dims.PACKET_HEADER) + " FROM rep")
oracle("packets_json_file", PACKETS + ",\nrep AS (" + ORACLES["packet_report"][ORACLES["packet_report"].rindex("SELECT iso_time"):] + ")", """
SELECT *, (SELECT count(*) FROM dns_raw) AS packet_count, (SELECT count(*) FROM dns_raw WHERE event_type <> 'signup') AS dns_event_count FROM rep""")
oracle("capture_decode", RAW, """
SELECT seq, transport, CAST(50000 AS INTEGER) AS source_port, CAST(53 AS INTEGER) AS destination_port,
 CASE WHEN contains(destination_ip, ':') THEN '2001:db8::25' ELSE source_ip END AS source_ip, destination_ip AS dest_ip,
 CAST(seq % 65536 AS INTEGER) AS dns_id, is_response,
 CAST(CASE WHEN is_response THEN coalesce(rcode_raw, '0') ELSE '0' END AS INTEGER) AS rcode, coalesce(domain, '') AS domain,
 CAST(1 AS INTEGER) AS qtype, coalesce(replace(CASE WHEN is_response THEN answers_raw END, ';', '|'), '') AS answers,
 CASE WHEN is_response AND answers_raw IS NOT NULL THEN ttl || '|' || ttl ELSE '' END AS ttls FROM dns_raw""")
oracle("capture_events", EVENTS + """,
w AS (SELECT ev.*, CASE WHEN contains(ev.destination_ip, ':') THEN '2001:db8::25' ELSE ev.source_ip END AS client
  FROM ev JOIN dns_raw r ON r.seq = ev.seq WHERE r.domain IS NOT NULL)""", """
SELECT seq, event_ts, domain, CASE WHEN is_response THEN destination_ip ELSE client END AS source_ip,
 CASE WHEN is_response THEN client ELSE destination_ip END AS destination_ip, '53' AS destination_port,
 CASE transport WHEN 'tcp' THEN 'DNS/TCP' ELSE 'DNS' END AS protocol,
 CASE WHEN is_response THEN rcode ELSE 'NOERROR' END AS rcode, CASE WHEN is_response THEN ttl END AS ttl,
 CASE WHEN is_response THEN replace(answers_raw, ';', '|') END AS answers FROM w""")
CSV = """SELECT seq, strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, domain, record_type AS type, protocol AS method, threat_level AS threat,
 array_to_string(reasons, '; ') AS threat_reasons, source_ip AS client, destination_ip AS resolver, transport,
 coalesce(replace(answers_raw, ';', '; '), '') AS answers, coalesce(CAST(nullif(ttl, 0) AS VARCHAR), '') AS ttl, tool, mode FROM scored"""
oracle("export_csv_rows", SCORED, f"SELECT * EXCLUDE (seq) FROM ({CSV})")
oracle("export_csv_file", SCORED + f", csv AS ({CSV})", """
SELECT 'Time,Domain,Type,Method,Threat,Threat Reasons,Client,Resolver,Transport,Answers,TTL,Tool,Mode' AS line
UNION ALL SELECT '"' || concat_ws('","', time, domain, type, method, threat, threat_reasons, client, resolver, transport, answers, ttl, tool, mode) || '"' FROM csv""")
oracle("export_json_rows", SCORED, """
SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, domain, record_type AS type, protocol AS method,
 threat_level AS threat, threat_score, array_to_string(reasons, '|') AS threat_reasons, source_ip AS client,
 destination_ip AS resolver, transport, coalesce(replace(answers_raw, ';', '|'), '') AS answers, nullif(ttl, 0) AS ttl, tool, mode FROM scored""")
ORACLES["export_json_file"] = ORACLES["export_json_rows"]
oracle("export_metadata", SCORED, f"""
SELECT count(*) FILTER ({_any('google')}) AS event_count, 'google' AS search, count(*) AS total_events,
 {_top('domain', 'scored', 'unknown')} AS top_domain FROM scored""")
oracle("event_store", SCORED, """
SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS event_date, count(*) AS events, CAST(sum(threat_score) AS BIGINT) AS score
FROM scored GROUP BY 1""")

# --- streaming --------------------------------------------------------------------------------------

oracle("stream_breakdowns", SCORED, """
SELECT 'threat_level' AS dimension, threat_level AS value, count(*) AS events FROM scored GROUP BY threat_level
UNION ALL SELECT 'record_type', record_type, count(*) FROM scored WHERE record_type <> 'UNKNOWN' GROUP BY record_type
UNION ALL SELECT 'transport', transport, count(*) FROM scored GROUP BY transport
UNION ALL SELECT 'rcode', rcode, count(*) FROM scored GROUP BY rcode
UNION ALL SELECT 'domain', domain, count(*) FROM scored WHERE domain <> 'unknown' GROUP BY domain
UNION ALL SELECT 'source_ip', source_ip, count(*) FROM scored WHERE source_ip <> 'unknown' GROUP BY source_ip""")
ORACLES["stream_top_domains"] = ORACLES["top_domains"]
oracle("stream_totals", EVENTS, """
SELECT count(*) AS total_events, count(DISTINCT domain) FILTER (domain <> 'unknown') AS unique_domains, arg_max(event_ts, seq) AS last_event_at FROM ev""")
oracle("stream_latest_by_id", EVENTS, """
SELECT 'evt-' || (seq % 997) AS id, max(seq) AS seq, arg_max(event_ts, seq) AS event_ts, arg_max(domain, seq) AS domain, arg_max(source_ip, seq) AS source_ip
FROM ev GROUP BY seq % 997""")
oracle("stream_traffic_series", EVENTS + """,
c AS (SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS b, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(event_ts) FROM ev) - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS b)""", """
SELECT g.b AS bucket_start, coalesce(c.n, 0) AS events FROM g LEFT JOIN c ON c.b = g.b""")
oracle("stream_traffic", EVENTS, """
SELECT date_trunc('hour', event_ts) AS bucket_start, count(*) AS events FROM ev GROUP BY 1
HAVING date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= (SELECT max(event_ts) FROM ev)""")
oracle("stream_handover", SCORED, """
SELECT seq, id, domain, threat_score FROM scored WHERE seq > (SELECT max(seq) * 3 // 5 FROM scored)""")
oracle("stream_store", SCORED, "SELECT seq, id, domain, threat_score FROM scored ORDER BY seq DESC LIMIT 500")
