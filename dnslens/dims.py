"""Lookup dimensions and constants of the DNS event model."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. They define the results (names, weights, thresholds, texts) and
# are stated as they are, in natural order.
# ---------------------------------------------------------------------------

# DNS record type numbers and their names (46 entries; 10 is left out on purpose).
RECORD_TYPES = {
    1: "A",
    2: "NS",
    5: "CNAME",
    6: "SOA",
    12: "PTR",
    13: "HINFO",
    15: "MX",
    16: "TXT",
    17: "RP",
    18: "AFSDB",
    24: "SIG",
    25: "KEY",
    28: "AAAA",
    29: "LOC",
    33: "SRV",
    35: "NAPTR",
    36: "KX",
    37: "CERT",
    39: "DNAME",
    41: "OPT",
    43: "DS",
    44: "SSHFP",
    45: "IPSECKEY",
    46: "RRSIG",
    47: "NSEC",
    48: "DNSKEY",
    49: "DHCID",
    50: "NSEC3",
    51: "NSEC3PARAM",
    52: "TLSA",
    55: "HIP",
    59: "CDS",
    60: "CDNSKEY",
    61: "OPENPGPKEY",
    64: "SVCB",
    65: "HTTPS",
    99: "SPF",
    249: "TKEY",
    250: "TSIG",
    251: "IXFR",
    252: "AXFR",
    255: "ANY",
    256: "URI",
    257: "CAA",
    32768: "TA",
    32769: "DLV",
}

# DNS response codes and their names.
RCODES = {
    0: "NOERROR",
    1: "FORMERR",
    2: "SERVFAIL",
    3: "NXDOMAIN",
    4: "NOTIMP",
    5: "REFUSED",
    6: "YXDOMAIN",
    7: "YXRRSET",
    8: "NXRRSET",
    9: "NOTAUTH",
    10: "NOTZONE",
}

# Query types named in the packet report.
PACKET_QTYPES = {
    1: "A",
    28: "AAAA",
    15: "MX",
    16: "TXT",
    2: "NS",
    5: "CNAME",
    6: "SOA",
    65: "HTTPS",
}

# Reputation weight of top-level domains.
TLD_WEIGHTS = {
    "tk": 10,
    "ml": 10,
    "ga": 10,
    "cf": 10,
    "gq": 10,
    "top": 8,
    "xyz": 8,
    "buzz": 8,
    "club": 7,
    "work": 7,
    "info": 6,
    "click": 6,
    "link": 6,
    "online": 6,
    "site": 6,
    "icu": 8,
    "cam": 8,
    "monster": 8,
    "rest": 7,
    "uno": 7,
    "surf": 7,
}

# Popular names a typosquatter may imitate, in list order.
POPULAR_DOMAINS = [
    "amazon.com",
    "apple.com",
    "bankofamerica.com",
    "chase.com",
    "facebook.com",
    "github.com",
    "google.com",
    "instagram.com",
    "linkedin.com",
    "microsoft.com",
    "netflix.com",
    "paypal.com",
    "twitter.com",
    "wellsfargo.com",
]

# Record types that earn points by themselves.
UNUSUAL_TYPES = ["TXT", "NULL", "ANY", "AXFR", "IXFR", "HINFO", "KEY", "SIG"]

# Look-alike characters: each of the first string reads as its partner in the second.
HOMOGLYPHS_FROM = "i10"
HOMOGLYPHS_TO = "llo"

# Consonants counted in runs (lower case, y included).
CONSONANTS = "bcdfghjklmnpqrstvwxyz"

# Points per rule.
POINTS_TLD_BAD = 35
POINTS_TLD_POOR = 15
POINTS_ENTROPY_HIGH = 30
POINTS_ENTROPY_ELEVATED = 15
POINTS_NAME_VERY_LONG = 25
POINTS_NAME_LONG = 10
POINTS_NUMERIC_LABEL = 10
POINTS_CONSONANT_RUN = 25
POINTS_DEPTH = 15
POINTS_UNUSUAL_TYPE = 10
POINTS_NXDOMAIN = 5
POINTS_ERROR_RESPONSE = 10
POINTS_TYPOSQUAT = 45

# Thresholds of the rules.
TLD_BAD_WEIGHT = 8
TLD_POOR_WEIGHT = 6
ENTROPY_HIGH = 4.0
ENTROPY_ELEVATED = 3.5
NAME_VERY_LONG = 60
NAME_LONG = 40
NUMERIC_RUN = 4
CONSONANT_RUN = 5
MAX_LABELS = 5
LEVEL_HIGH = 60
LEVEL_MEDIUM = 30

# Texts of the reasons; %s takes the value.
REASON_TLD_BAD = "Suspicious TLD (.%s)"
REASON_TLD_POOR = "Suboptimal TLD (.%s)"
REASON_ENTROPY_HIGH = "High domain entropy (%s)"
REASON_ENTROPY_ELEVATED = "Elevated domain entropy (%s)"
REASON_NAME_VERY_LONG = "Very long domain name (%s chars)"
REASON_NAME_LONG = "Long domain name (%s chars)"
REASON_NUMERIC_LABEL = "Numeric-heavy subdomain label"
REASON_CONSONANT_RUN = "DGA heuristic (%s consecutive consonants)"
REASON_DEPTH = "Excessive subdomain depth (%s labels)"
REASON_UNUSUAL_TYPE = "Unusual record type (%s)"
REASON_NXDOMAIN = "NXDOMAIN response"
REASON_ERROR_RESPONSE = "Error response (%s)"
REASON_TYPOSQUAT = "Potential typosquatting of %s"

# Texts of notes, alerts and errors; %s takes the value.
NOTE_OBSERVED = "Observed %s query for %s"
NOTE_FOCUS = "Observed targeted activity from %s for %s"
NOTE_ALERT = "Suspicious activity detected"
NOTE_OPEN_PORT = "Open %s port"
ERROR_UNREADABLE = "Unreadable monitor payload: %s"
ERROR_UNKNOWN = "Unknown capture error"
NOTE_PREPARING = "Preparing DNS capture."
NOTE_STOPPING = "Stop requested. Waiting for the monitor to shut down."
NOTE_STOPPED = "Capture stopped by user."
NOTE_COMPLETED = "Capture finished successfully."
NOTE_EXITED = "Capture exited with status code %s."

# Quick filter groups of record types.
TYPE_GROUPS = {
    "browser": ["A", "AAAA", "HTTPS", "CNAME"],
    "mail": ["MX", "TXT"],
    "infrastructure": ["NS", "SOA"],
}

# Ports that carry DNS: plain, over HTTPS / QUIC, over TLS.
DNS_PORTS = [53, 443, 853]

# Statuses that end a session.
TERMINAL_STATUSES = ["completed", "interrupted", "stopped"]

# Provenance of events built from packets.
CONFIDENCE = "observed"
EVENT_SOURCE = "python-monitor"

# Action of a redirected query.
ACTION_REDIRECTED = "sinkholed"

# Answers kept per event, and read per captured frame.
MAX_ANSWERS = 10
MAX_FRAME_ANSWERS = 20

# Sizes of the views.
BUFFER_EVENTS = 500
BUFFER_ACTIVITY = 40
BUFFER_ERRORS = 6
LEDGER_SESSIONS = 50
PAGE_ROWS = 100

# Columns of the CSV export, in order.
CSV_HEADER = [
    "Time",
    "Domain",
    "Type",
    "Method",
    "Threat",
    "Threat Reasons",
    "Client",
    "Resolver",
    "Transport",
    "Answers",
    "TTL",
    "Tool",
    "Mode",
]

# Columns of the packet report, in order.
PACKET_HEADER = [
    "iso_time",
    "timestamp",
    "source_ip",
    "dest_ip",
    "transport",
    "packet_length",
    "dns_id",
    "is_response",
    "domain",
    "qtype",
    "rcode",
    "answers",
    "ttls",
]

# Characters removed at both ends by "strip" (Unicode white space).
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------
# Values of this library.
# ---------------------------------------------------------------------------

# Rows one (key, chunk) group may hold when an ordered operator splits a key.
CHUNK_ROWS = 1_000_000

# Rows a lookup may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000
