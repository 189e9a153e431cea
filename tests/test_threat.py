from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.operators.threat import apply_redirect, rule_breakdown, score_events
from dnslens.operators.typosquat import default_brands, typosquat_matches

# domain, record type, rcode, score, level
WORKED = [
    ("google.com", "A", "NOERROR", 0, "low"),
    ("GitHub.com", "A", "NOERROR", 0, "low"),
    ("xn--80ak6aa92e.com", "A", "NOERROR", 15, "low"),
    ("free-gift-cards-now.tk", "A", "NOERROR", 50, "medium"),
    ("login-verify-account.ml", "A", "NOERROR", 65, "high"),
    ("update-your-security.ga", "A", "NOERROR", 50, "medium"),
    ("c2-server-callback.xyz", "A", "NOERROR", 50, "medium"),
    ("a1b2c3d4e5f6g7h8.top", "A", "NOERROR", 65, "high"),
    ("data-exfiltration-test.cf", "A", "NOERROR", 50, "medium"),
    ("phishing-simulation.buzz", "A", "NOERROR", 50, "medium"),
    ("goog1e.com", "A", "NOERROR", 45, "medium"),
    ("g00gle.com", "A", "NOERROR", 45, "medium"),
    ("amazom.com", "A", "NOERROR", 45, "medium"),
    ("paypa1.com", "A", "NOERROR", 45, "medium"),
    ("githubb.com", "A", "NOERROR", 45, "medium"),
    ("a.b.c.d.e.f.example.org", "A", "NOERROR", 15, "low"),
    ("xkcdqwrtzp.example.net", "A", "NOERROR", 40, "medium"),
    ("XKCDQWRTZP.example.net", "A", "NOERROR", 15, "low"),
    ("host1234.example.info", "A", "NOERROR", 55, "medium"),
    ("unknown", "A", "NOERROR", 0, "low"),
    ("scan-53", "A", "NOERROR", 0, "low"),
    ("stackoverflow.com", "A", "NOERROR", 15, "low"),
    ("google.com", "TXT", "NXDOMAIN", 15, "low"),
    ("google.com", "ANY", "REFUSED", 20, "low"),
]
# length, depth and run boundaries: (domain, points of the rule)
EDGES = [
    ("length", "a" * 40, 0), ("length", "a" * 41, 10), ("length", "a" * 60, 10), ("length", "a" * 61, 25),
    ("depth", "a.a.a.a.a", 0), ("depth", "a.a.a.a.a.a", 15),
    ("consonants", "abcdf.a", 0), ("consonants", "abcdfg.a", 25),
    ("numeric", "a123.a", 0), ("numeric", "a1234.a", 10), ("numeric", "a.1234", 0),
    ("entropy", "aabbccddefghij.l", 0), ("entropy", "abcdefghijklm.op", 15), ("entropy", "aabbccdefghijk.m", 15),
    ("tld", "a.tk", 35), ("tld", "a.CLUB", 15), ("tld", "a.info", 15), ("tld", "tk", 0), ("tld", "a.com", 0),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(WORKED)], "seq int, domain string, record_type string, rcode string")
    return df


def test_worked_scores(scored):
    rows = score_events(scored).orderBy("seq").collect()
    assert [(r.domain, r.record_type, r.rcode, r.threat_score, r.threat_level) for r in rows] == WORKED
    reasons = {(r.domain, r.record_type): r.threat_reasons for r in rows}
    assert reasons["host1234.example.info", "A"] == [
        "Suboptimal TLD (.info)", "High domain entropy (4.11)", "Numeric-heavy subdomain label"]
    assert reasons["google.com", "TXT"] == ["Unusual record type (TXT)", "NXDOMAIN response"]
    assert reasons["paypa1.com", "A"] == ["Potential typosquatting of paypal.com"]
    assert reasons["google.com", "ANY"] == ["Unusual record type (ANY)", "Error response (REFUSED)"]


def test_forms_agree(spark, scored):
    plain = score_events(scored).collect()
    columns = scored.columns + ["threat_score", "threat_level", "threat_reasons"]
    for other in (score_events(scored, per_name=True), score_events(scored, brands=default_brands(spark))):
        assert sorted(other.select(*columns).collect()) == sorted(plain)


def test_score_is_sum_of_points(scored):
    points = rule_breakdown(scored)
    total = sum((F.col(c) for c in points.columns if c.startswith("points_")), F.lit(0))
    got = points.select("seq", total).join(score_events(scored).select("seq", "threat_score"), "seq").collect()
    assert all(row[1] == row[2] for row in got)


def test_rule_edges(spark):
    df = spark.createDataFrame([(d, "A", "NOERROR") for _, d, _ in EDGES], "domain string, record_type string, rcode string").distinct()
    rows = {r.domain: r for r in rule_breakdown(df).collect()}
    assert [(rule, name, rows[name]["points_" + rule]) for rule, name, _ in EDGES] == EDGES


def test_entropy_text_rounds_like_printf(spark):
    df = spark.createDataFrame([("aabbccdefghijk.m", "A", "NOERROR")], "domain string, record_type string, rcode string")
    assert score_events(df).first().threat_reasons[0] == "Elevated domain entropy (3.62)"


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_brand_join_against_brute_force(spark):
    rng = random.Random(7)
    brands = ["alpha.com", "alphq.com", "lino.org", "a1.io", "al.io"]
    alphabet = "aloi10q.c"
    names = set(brands) | {"a1pha.com", "alph.com", "llno.0rg"}
    for brand in brands:
        for _ in range(60):
            name = list(brand)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(name) + 1)
                step = rng.randrange(3)
                if step == 0:
                    name.insert(at, rng.choice(alphabet))
                elif at < len(name):
                    name[at : at + 1] = [] if step == 1 else [rng.choice(alphabet)]
            names.add("".join(name))
    fold = str.maketrans("i10", "llo")

    def expected(name):
        plain = name.lower().rstrip(".")
        if plain in brands or not plain:
            return None
        for brand in brands:
            if plain.translate(fold) == brand.translate(fold) or _distance(plain, brand) == 1:
                return brand
        return None

    table = spark.createDataFrame(list(enumerate(brands)), "position int, brand string")
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    got = {r.domain: r.brand for r in typosquat_matches(df, table).collect()}
    assert got == {n: expected(n) for n in names if expected(n)}
    from dnslens.functions.threat import typosquat_target

    short = {r[0]: r[1] for r in df.select("domain", typosquat_target(F.col("domain"), brands)).collect()}
    assert short == {n: expected(n) for n in names}


def test_redirect(spark):
    rows = [(1, "high", "10.0.0.1", "udp", False), (2, "high", "10.0.0.1", "udp", True), (3, "high", "2001:db8::1", "udp", False),
            (4, "high", "10.0.0.1", "tcp", False), (5, "medium", "10.0.0.1", "udp", False)]
    df = spark.createDataFrame(rows, "seq int, threat_level string, source_ip string, transport string, is_response boolean")
    df = df.withColumn("answers", F.array(F.lit("1.2.3.4")))
    got = {r.seq: (r.action, r.answers) for r in apply_redirect(df, "10.9.9.9").collect()}
    assert got == {1: ("sinkholed", ["10.9.9.9"]), **{i: (None, ["1.2.3.4"]) for i in (2, 3, 4, 5)}}
    assert apply_redirect(df, None).filter("action is not null").count() == 0


def test_score_filters_stay_above_scoring(scored):
    plan = score_events(scored).filter("threat_level <> 'low'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert len(dims.RECORD_TYPES) == 46
