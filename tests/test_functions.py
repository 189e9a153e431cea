from __future__ import annotations

import math
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from dnslens.functions import codes, rounding, text, threat, times


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_record_types(spark):
    cases = {
        None: "A", "": "A", "  ": "A", "1": "A", "28": "AAAA", "028": "AAAA", "0": "0", "000": "0", "10": "10",
        "0010": "10", "99999": "99999", "txt": "TXT", " mx ": "MX", "\t15\n": "MX", "28;1": "28;1", "32769": "DLV",
        "1234567890123456789012": "1234567890123456789012", "0x": "0X",
    }
    assert column(spark, cases, codes.resolve_record_type) == list(cases.values())


def test_rcodes(spark):
    cases = {
        None: "NOERROR", "0": "NOERROR", "3": "NXDOMAIN", " 3 ": "NXDOMAIN", "+2": "SERVFAIL", "03": "NXDOMAIN",
        "11": "RCODE_11", "011": "RCODE_011", "-1": "RCODE_-1", "-0": "NOERROR", "refused": "REFUSED", "3.5": "3.5",
    }
    assert column(spark, cases, codes.resolve_rcode) == list(cases.values())


def test_ports_and_addresses(spark):
    df = spark.createDataFrame([("853", ""), ("", "53"), ("", "")], "tcp string, udp string")
    rows = df.select(codes.pick_transport(F.col("tcp")), codes.pick_port(F.col("tcp"), F.col("udp"))).collect()
    assert [tuple(r) for r in rows] == [("tcp", "853"), ("udp", "53"), ("udp", "53")]
    df = spark.createDataFrame([("a", "b"), ("", "b"), ("", "")], "v4 string, v6 string")
    assert [r[0] for r in df.select(codes.pick_address(F.col("v4"), F.col("v6"))).collect()] == ["a", "b", "unknown"]


def test_first_ttl(spark):
    assert column(spark, ["300;60", "x;1", "", None, " 5 "], codes.first_ttl) == [300, None, None, None, 5]


def test_normalize_target(spark):
    cases = {
        "https://User:pw@WWW.Example.COM:8443/a?b#c": "www.example.com",
        "http://[2001:DB8::1]:80/": "2001:db8::1",
        "  Example.ORG. ": "Example.ORG",
        "http://host.example..": "host.example",
        "https:///path": None,
        "": None,
        "ftp://a b.example/x|y": "a b.example",
    }
    assert column(spark, cases, text.normalize_target) == list(cases.values())


def test_short_label(spark):
    names = ["a" * 28, "b" * 29]
    assert column(spark, names, text.short_label) == ["a" * 28, "b" * 26 + "…"]


def test_epoch(spark):
    values = ["1700000000.25", "bad", "", "nan", "1e400", "-1", "1700000000.1234567"]
    got = column(spark, values, lambda c: F.unix_micros(times.epoch_to_ts(c)))
    assert got == [1700000000250000, None, None, None, None, -1000000, 1700000000123457]


def test_iso(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024", "nonsense", "", None]
    got = column(spark, values, lambda c: F.unix_micros(times.parse_iso(c)))
    base = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).timestamp()
    assert got == [int(base * 1e6), int((base - 7200 + 0.5) * 1e6), None, None, None, None]


def test_iso_text(spark):
    values = [0, 1_700_000_000_000_000, 1_700_000_000_250_001]
    stamp = lambda c: F.timestamp_micros(c)
    got = column(spark, values, lambda c: times.iso_micros(stamp(c)), "bigint")
    assert got == [datetime.fromtimestamp(v / 1e6, tz=timezone.utc).isoformat() for v in values]
    assert column(spark, values[2:], lambda c: times.iso_millis(stamp(c)), "bigint") == ["2023-11-14T22:13:20.250Z"]


def test_age_and_duration(spark):
    ages = {0: "Just now", 4_499_999: "Just now", 4_500_000: "5s ago", 59_600_000: "1m ago", 3_599_400_000: "59m ago", 7_200_000_000: "2h ago"}
    got = column(spark, ages, lambda c: times.age_label(F.timestamp_micros(F.lit(0)), F.timestamp_micros(c)), "bigint")
    assert got == list(ages.values())
    got = column(spark, [125_900_000], lambda c: times.duration_label(F.timestamp_micros(F.lit(0)), F.timestamp_micros(c)), "bigint")
    assert got == ["2m 5s"]


def test_rounding_agrees_with_printf(spark):
    values = [0.15, 0.25, 0.35, 0.45, 2.25, 2.35, 1 / 3, 1e6 + 0.05, 0.0, 12.345, 7.125, 99.95, 0.05] + [n / 20 for n in range(200)]
    for digits in (1, 2):
        got = column(spark, values, lambda c: rounding.round_even(c, digits), "double")
        assert got == [float(f"{v:.{digits}f}") for v in values]
    assert column(spark, [0.125, 0.375, 0.005], lambda c: rounding.round_up(c, 2), "double") == [0.13, 0.38, 0.01]


def test_entropy_bounds(spark):
    names = ["aabbccddefghij.l", "abcdefghijklm.op", "aabbccdefghijk.m", "", "AaAa", "unknown", "ümläut.example"]

    def expected(name):
        low = name.lower()
        return -sum(n / len(low) * math.log2(n / len(low)) for n in Counter(low).values()) if low else 0.0

    got = column(spark, names, threat.entropy)
    assert got[0] == 3.5 and got[1] == 4.0 and got[2] == 3.625
    assert got == pytest.approx([expected(name) for name in names], abs=1e-12)


def test_names(spark):
    assert column(spark, ["a.B.Com", "nodot", ".", "x."], threat.tld) == ["com", "", "", ""]
    assert column(spark, ["a.b.c", "nodot", "x."], threat.label_count) == [3, 1, 2]
    assert column(spark, ["bcdf", "bcdfg", "abcdfghaxyzxyzq", "BCDFGH", ""], threat.consonant_run) == [0, 5, 7, 0, 0]


def test_typosquat_targets(spark):
    cases = {
        "google.com": None, "GOOGLE.com.": None, "goog1e.com": "google.com", "g00gle.com": "google.com",
        "gogle.com": "google.com", "googlee.com": "google.com", "gooogle.com": "google.com", "oogle.com": "google.com",
        "googel.com": None, "1inked1n.c0m": "linkedin.com", "llnkedln.com": "linkedin.com", "paypal.co": "paypal.com",
        "paypal.comm": "paypal.com", "chas.com": "chase.com", "xchase.com": "chase.com", "example.org": None, "": None,
    }
    assert column(spark, cases, threat.typosquat_target) == list(cases.values())
