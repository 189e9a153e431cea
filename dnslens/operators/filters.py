"""Filters and searches over events.

All are plain predicates, so Catalyst merges them into one filter next to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.text import non_empty
from dnslens.session import cut_lineage

JOINED_FIELDS = ("domain", "record_type", "source_ip", "destination_ip", "tool", "mode", "transport")
ANY_FIELDS = (
    "domain",
    "record_type",
    "source_ip",
    "destination_ip",
    "transport",
    "tool",
    "mode",
    "protocol",
    "threat_level",
)
FIELD_COLUMNS = {"domain": "domain", "client": "source_ip", "resolver": "destination_ip", "type": "record_type"}

# Value that marks "not known" per dimension; the others only exclude empty values.
UNKNOWN = {"domain": "unknown", "source_ip": "unknown", "record_type": "UNKNOWN"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _holds(col: Column, term: str) -> Column:
    return F.contains(F.lower(col), F.lit(term.lower()))


# --- sources ------------------------------------------------------------------


def dns_ports(df: DataFrame, source: str = "source_port", destination: str = "destination_port") -> DataFrame:
    """Keep packets with a DNS port on either side."""
    return df.filter(F.col(source).isin(dims.DNS_PORTS) | F.col(destination).isin(dims.DNS_PORTS))


def dns_only(df: DataFrame, name: str = "domain", flag: str = "is_response") -> DataFrame:
    """Keep queries and responses that carry a question."""
    return df.filter(F.col(flag).isNotNull() & non_empty(F.rtrim(F.col(name), F.lit("."))).isNotNull())


def known(name: str) -> Column:
    """Whether a dimension value counts in breakdowns."""
    present = non_empty(F.col(name)).isNotNull()
    return present & (F.col(name) != UNKNOWN[name]) if name in UNKNOWN else present


# --- searches -------------------------------------------------------------------


def joined_match(term: str) -> Column:
    """Term found in seven fields joined by blanks (it may span two fields)."""
    joined = F.concat_ws(" ", *[_text(name) for name in JOINED_FIELDS])
    return _holds(joined, term.strip())


def search(df: DataFrame, term: str) -> DataFrame:
    """Joined-text search; an empty term keeps everything."""
    return df.filter(joined_match(term)) if term else df


def snapshot(df: DataFrame, term: str = "", limit: int = 0) -> DataFrame:
    """Newest events that match, at most ``limit`` (0 or less: all)."""
    found = search(df, term)
    return found.orderBy(F.col("seq").desc()).limit(limit) if limit > 0 else found


_CLASS_OR_SIGN = re.compile(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|\$", re.DOTALL)


def _java_pattern(body: str, multiline: bool) -> str:
    """A browser's regular expression in the dialect of the JVM.

    Inside a class ``[`` and ``&&`` are plain characters there; ``[^]`` is any character and
    ``[]`` none; ``$`` is the very end, not before a last line break.
    """
    def turned(found: re.Match) -> str:
        text = found[0]
        if text == "$":
            return "$" if multiline else r"\z"
        if text[0] != "[":
            return text
        if text in ("[^]", "[]"):
            return r"[\s\S]" if text == "[^]" else "(?!)"
        inside = re.sub(r"\\.|\[|&&", lambda m: {"[": r"\[", "&&": r"&\&"}.get(m[0], m[0]), text[1:-1], flags=re.DOTALL)
        return f"[{inside}]"

    return _CLASS_OR_SIGN.sub(turned, body)


def _pattern(term: str) -> str | None:
    """The JVM's form of a ``/pattern/flags`` term, null for other terms and invalid patterns."""
    parts = re.fullmatch(r"/(.+)/([gimsuy]*)", term)
    if not parts or len(set(parts[2])) != len(parts[2]):
        return None
    body, flags = parts.groups()
    body = _java_pattern(body, "m" in flags)
    inline = "i" + "".join(flag for flag in "ms" if flag in flags)
    pattern = f"(?{inline})" + (rf"\A(?:{body})" if "y" in flags else body)
    # constants of a local row are worked out while the query is planned: no job runs
    row = SparkSession.active().sql("VALUES ('')")
    try:
        row.select(F.lit("").rlike(pattern)).collect()
    except PySparkException as error:
        if (error.getCondition() or "").startswith("INVALID_PARAMETER_VALUE"):
            return None
        raise
    return pattern


def term_match(term: str, field: str = "all") -> Column:
    """Term found in one named field, or in at least one of nine fields on its own.

    ``/pattern/flags`` is a regular expression (never case-sensitive); when the
    pattern is invalid the whole term is searched as text.
    """
    pattern = _pattern(term)
    names = [FIELD_COLUMNS[field]] if field in FIELD_COLUMNS else list(ANY_FIELDS)
    if pattern is None:
        tests = [_holds(_text(name), term) for name in names]
    else:
        tests = [_text(name).rlike(pattern) for name in names]
    return reduce(lambda left, right: left | right, tests)


def search_field(df: DataFrame, field: str, term: str) -> DataFrame:
    """Search in ``domain``, ``client``, ``resolver`` or ``type``."""
    return df.filter(term_match(term, field))


def search_any(df: DataFrame, term: str, exclude: bool = False) -> DataFrame:
    """Search in any field; ``exclude`` keeps the rows that do not match."""
    match = term_match(term)
    return df.filter(~match if exclude else match)


# --- view filters -----------------------------------------------------------------


def type_group(df: DataFrame, group: str) -> DataFrame:
    """Keep one group of record types (``browser``, ``mail``, ``infrastructure``); others keep all."""
    types = dims.TYPE_GROUPS.get(group)
    return df if types is None else df.filter(F.upper(_text("record_type")).isin(types))


def focus(df: DataFrame, address: str) -> DataFrame:
    """Keep events whose source or destination contains ``address``."""
    if not address:
        return df
    return df.filter(_holds(_text("source_ip"), address) | _holds(_text("destination_ip"), address))


def latest_timestamp(df: DataFrame) -> Column:
    """The cutoff of "clear view" as a scalar subquery: the greatest timestamp present."""
    return df.agg(F.max("event_ts")).scalar()


def after_cutoff(df: DataFrame, cutoff: Column | datetime) -> DataFrame:
    """Keep events after ``cutoff``; events without a timestamp always stay."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return df.filter(F.col("event_ts").isNull() | limit.isNull() | (F.col("event_ts") > limit))


@dataclass(frozen=True)
class ViewSpec:
    """What a view shows. Empty values filter nothing."""

    cutoff: Column | datetime | None = None
    group: str = "all"
    address: str = ""
    term: str = ""
    field: str = "all"
    exclude: bool = False


def filtered_view(df: DataFrame, spec: ViewSpec) -> DataFrame:
    """Cutoff, type group, address focus and search, in that order."""
    if spec.cutoff is not None:
        df = after_cutoff(df, spec.cutoff)
    df = focus(type_group(df, spec.group), spec.address)
    term = spec.term.strip()
    if term:
        match = term_match(term, spec.field)
        df = df.filter(~match if spec.exclude else match)
    return df


def select_rows(view: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The selected rows of a view, or the whole view when none of them is selected.

    ``ids`` has a column ``id``.
    """
    if ids is None:
        return view
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    marked = cut_lineage(view.join(chosen, "id", "left"))  # read twice below, from one scan of the view and the ids
    any_chosen = marked.agg(F.coalesce(F.max("_chosen"), F.lit(False))).scalar()
    return marked.filter(F.col("_chosen") | ~any_chosen).drop("_chosen")


def view_counts(view: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows in the view and how many of them are selected."""
    if ids is None:
        view = view.withColumn("_chosen", F.lit(False))
    else:
        chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
        view = view.join(chosen, "id", "left")
    return view.agg(
        F.count("*").alias("results"), F.count_if(F.coalesce("_chosen", F.lit(False))).alias("selected")
    )
