"""Record types, response codes, protocols, ports and addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.text import first_non_empty, non_empty, strip


def lookup(code: Column, names: dict[int, str]) -> Column:
    """Name of a code given as text without leading zeros; null when unknown."""
    pairs = [F.lit(item) for item in chain.from_iterable((str(k), v) for k, v in names.items())]
    return F.try_element_at(F.create_map(*pairs), code)


def resolve_record_type(col: Column) -> Column:
    """Record type name from a number or a text; missing means ``A``."""
    # white space at the ends, and zeros before a number
    noise = r"(?U)^\s*0+(?=[0-9]+\s*$)|^\s+|\s+$"
    text = F.regexp_replace(col.cast("string"), noise, "")
    return F.coalesce(lookup(text, dims.RECORD_TYPES), F.upper(non_empty(text)), F.lit("A"))


def resolve_rcode(col: Column) -> Column:
    """Response code name from a number or a text; missing means ``NOERROR``."""
    text = col.cast("string")
    number = F.regexp_extract(text, r"(?U)^\s*(?:\+|-(?=0+\s*$))?0*([0-9]+)\s*$", 1)
    unnamed = F.when(text.rlike(r"(?U)^\s*[+-]?[0-9]+\s*$"), F.concat(F.lit("RCODE_"), text))
    return F.coalesce(lookup(number, dims.RCODES), unnamed, F.upper(text), F.lit("NOERROR"))


def detect_protocol(transport: Column, port: Column) -> Column:
    """DNS variant from transport and destination port (both text)."""
    tcp, udp = transport == "tcp", transport == "udp"
    return (
        F.when(tcp & (port == "853"), "DoT")
        .when(tcp & (port == "443"), "DoH")
        .when(udp & (port == "443"), "DoQ")
        .when(tcp & (port == "53"), "DNS/TCP")
        .otherwise("DNS")
    )


def pick_transport(tcp_port: Column) -> Column:
    """``tcp`` when a TCP port is present, else ``udp``."""
    return F.when(non_empty(tcp_port).isNotNull(), "tcp").otherwise("udp")


def pick_port(tcp_port: Column, udp_port: Column) -> Column:
    """TCP port, else UDP port, else 53."""
    return F.coalesce(first_non_empty(tcp_port, udp_port), F.lit("53"))


def pick_address(v4: Column, v6: Column) -> Column:
    """IPv4 address, else IPv6 address, else ``unknown``."""
    return F.coalesce(first_non_empty(v4, v6), F.lit("unknown"))


def method_class(protocol: Column, transport: Column) -> Column:
    """``doh``, ``dot`` or ``dns``."""
    name = F.upper(F.coalesce(non_empty(protocol), F.lit("DNS")))
    carrier = F.lower(F.coalesce(non_empty(transport), F.lit("udp")))
    return (
        F.when((name == "DOH") | (carrier == "https"), "doh")
        .when((name == "DOT") | (carrier == "tls"), "dot")
        .otherwise("dns")
    )


def collect_answers(*fields: Column) -> Column:
    """All non-empty answers of the ``;``-separated fields, in field order; null when none."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(field, F.lit("")), ";") for field in fields]))
    answers = F.filter(parts, lambda item: item != "")
    return F.when(F.size(answers) > 0, answers)


def first_ttl(col: Column) -> Column:
    """First value of a ``;``-separated TTL list; null when not a number."""
    head = strip(F.substring_index(col, ";", 1))
    return F.when(head.rlike("^[+-]?[0-9]+$"), head.try_cast("bigint"))


def min_ttl(col: Column) -> Column:
    """Smallest TTL of an array; null when empty."""
    return F.array_min(col)
