"""DNS records derived from the ``events`` table: one statement for Spark SQL and DuckDB."""

DNS_RAW = """
SELECT event_id AS seq, ts AS event_ts,
 CASE event_id % 20
  WHEN 0 THEN 'google.com' WHEN 1 THEN 'github.com' WHEN 2 THEN 'wikipedia.org'
  WHEN 3 THEN 'microsoft.com' WHEN 4 THEN 'python.org'
  WHEN 5 THEN 'cdn' || CAST(event_id % 7 AS STRING) || '.cloudflare.com'
  WHEN 6 THEN 'free-gift-cards-now.tk' WHEN 7 THEN 'login-verify-account.ml'
  WHEN 8 THEN substr(md5(CAST(event_id AS STRING)), 1, 16) || '.top'
  WHEN 9 THEN substr(md5(CAST(event_id AS STRING)), 1, 8) || '.buzz'
  WHEN 10 THEN 'goog1e.com' WHEN 11 THEN 'paypa1.com' WHEN 12 THEN 'amazom.com'
  WHEN 13 THEN 'host' || CAST(1000 + event_id % 9000 AS STRING) || '.example.info'
  WHEN 14 THEN md5(CAST(event_id AS STRING)) || '.' || substr(md5(CAST(user_id AS STRING)), 1, 16) || '.t.x.exfil.example.com'
  WHEN 15 THEN 'a.b.c.d.e.f.example.org' WHEN 16 THEN 'xkcdqwrtzp.example.net'
  WHEN 17 THEN 'unknown' WHEN 18 THEN NULL ELSE 'GitHub.com' END AS domain,
 '192.168.' || CAST(user_id % 4 AS STRING) || '.' || CAST(2 + user_id % 250 AS STRING) AS source_ip,
 CASE event_id % 4 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '9.9.9.9' ELSE '2606:4700:4700::1111' END AS destination_ip,
 CASE (user_id + event_id) % 12 WHEN 0 THEN '28' WHEN 1 THEN '16' WHEN 2 THEN '15' WHEN 3 THEN '2' WHEN 4 THEN '6'
  WHEN 5 THEN '65' WHEN 6 THEN '255' WHEN 7 THEN '10' WHEN 8 THEN 'txt' WHEN 9 THEN NULL ELSE '1' END AS qtype_raw,
 CASE WHEN event_id % 10 IN (6, 7, 8) THEN 'tcp' ELSE 'udp' END AS transport,
 CASE event_id % 10 WHEN 7 THEN '853' WHEN 8 THEN '443' WHEN 9 THEN '443' ELSE '53' END AS destination_port,
 CASE WHEN value < 1 THEN '11' WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN '0'
  WHEN event_type = 'error' THEN '3' WHEN event_type = 'signup' THEN '2' ELSE '5' END AS rcode_raw,
 event_type <> 'click' AS is_response,
 CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS ttl,
 CASE WHEN event_type = 'view' THEN '10.0.0.' || CAST(event_id % 200 AS STRING) || ';10.0.1.' || CAST(event_id % 100 AS STRING) END AS answers_raw,
 'session-' || CAST(user_id % 8 AS STRING) AS session_id,
 event_type, user_id
FROM {events}
"""
