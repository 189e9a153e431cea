"""The dashboard summary: totals, breakdowns, top lists and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.rounding import fixed_text, round_even, round_up
from dnslens.operators.filters import known
from dnslens.operators.ordered import newest_per_key
from dnslens.operators.windows import counts, top_k
from dnslens.session import cut_lineage

# Dimensions of the breakdowns.
DIMENSIONS = ("domain", "source_ip", "record_type", "transport", "rcode", "threat_level")


def breakdown(df: DataFrame, dimension: str) -> DataFrame:
    """Events per value of one dimension, unknown values left out.

    A missing threat level counts as low.
    """
    if dimension == "threat_level":
        df = df.withColumn("threat_level", F.coalesce("threat_level", F.lit("low")))
        return counts(df, ["threat_level"])
    return counts(df.filter(known(dimension)), [dimension])


def top_values(df: DataFrame, dimension: str, k: int) -> DataFrame:
    """The ``k`` most frequent known values of a dimension, with counts."""
    return top_k(breakdown(df, dimension), k).select(dimension, "events")


def breakdowns(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Several breakdowns in one scan and one shuffle: ``(dimension, value, events, first_seq, last_seq)``.

    Counts are added up in every task before the shuffle, so a hot value sends one
    row per task.
    """

    def entry(name: str) -> Column:
        if name == "threat_level":
            value = F.coalesce(F.col(name), F.lit("low"))
        else:
            value = F.when(known(name), F.col(name))
        return F.struct(F.lit(name).alias("dimension"), value.alias("value"))

    entries = F.array(*[entry(name) for name in dimensions])
    pairs = df.select("seq", F.explode(entries).alias("_e")).select("seq", "_e.dimension", "_e.value")
    return counts(pairs.filter(F.col("value").isNotNull()), ["dimension", "value"])


def top_per_dimension(broken_down: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of every dimension, ties to the newest seen."""
    return newest_per_key(broken_down, ["dimension"], k, [F.col("events").desc(), F.col("last_seq").desc()])


def events_per_minute() -> Column:
    """Aggregate: events over the span from the first to the last arrival, one decimal.

    Spans under a second count as a second; below two events, or without a readable
    timestamp at either end, the rate is 0.
    """
    newest, oldest = F.max_by("event_ts", "seq"), F.min_by("event_ts", "seq")
    seconds = (F.unix_micros(newest) - F.unix_micros(oldest)) / F.lit(1e6)
    minutes = F.greatest(seconds / F.lit(60.0), F.lit(1.0) / F.lit(60.0))
    rate = round_even(F.count("*") / minutes, 1)
    return F.when((F.count("*") >= 2) & seconds.isNotNull(), rate).otherwise(0.0)


def avg_qps(per_minute: Column) -> Column:
    """Queries per second as shown: two decimals, ``0.00`` at zero."""
    return fixed_text(round_up(per_minute / F.lit(60.0), 2), 2)


def totals(df: DataFrame) -> DataFrame:
    """One row: events, last event time and rates, in one pass."""
    row = df.agg(
        F.count("*").alias("total_events"),
        F.max_by("event_ts", "seq").alias("last_event_at"),
        events_per_minute().alias("events_per_minute"),
    )
    return row.withColumn("avg_qps", avg_qps(F.col("events_per_minute")))


def scalars(df: DataFrame, broken_down: DataFrame | None = None) -> DataFrame:
    """One row of totals, distinct names and the most common values.

    Pass ``windows.latest(df)`` for the summary of the event buffer. The tops are
    aggregates over the breakdown (one row per value), never over the events. No
    threat column is read: pass events without scores.
    """

    def top(name: str, alias: str) -> Column:
        rank = F.struct("events", "last_seq")
        return F.max_by(F.when(F.col("dimension") == name, F.col("value")), F.when(F.col("dimension") == name, rank)).alias(alias)

    if broken_down is None:
        broken_down = breakdowns(df, ("domain", "source_ip", "record_type"))
    tops = broken_down.agg(
        F.count_if(F.col("dimension") == "domain").alias("unique_domains"),
        top("domain", "top_domain"),
        top("source_ip", "top_source_ip"),
        top("record_type", "top_record_type"),
    )
    return attach_row(totals(df), tops)


def attach_row(left: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame by a scalar subquery."""
    packed = left.withColumn("_row", row.select(F.struct(*row.columns)).scalar())
    return packed.select(*left.columns, "_row.*")


def summary_long(df: DataFrame, top_domains: int = 8, top_sources: int = 5) -> DataFrame:
    """Breakdowns and top lists in long form: ``(section, value, events, last_seq)``.

    The breakdown (one row per value) is written once and read for every section, so
    the events are scanned and scored once.
    """
    return _sections(cut_lineage(breakdowns(df)), top_domains, top_sources)


def _sections(broken: DataFrame, top_domains: int, top_sources: int) -> DataFrame:
    small = broken.filter(F.col("dimension").isin("record_type", "transport", "rcode", "threat_level"))
    lists = broken.filter(F.col("dimension").isin("domain", "source_ip"))
    tops = top_per_dimension(lists, max(top_domains, top_sources))
    if top_domains != top_sources:
        size = F.when(F.col("dimension") == "domain", top_domains).otherwise(top_sources)
        order = [F.col("events").desc(), F.col("last_seq").desc()]
        place = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))
        tops = tops.withColumn("_n", place).filter(F.col("_n") <= size).drop("_n")
    return small.unionByName(tops).select(F.col("dimension").alias("section"), "value", "events", "last_seq")


def summary_record(
    df: DataFrame, top_domains: int = 8, top_sources: int = 5, feed: DataFrame | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """The summary as one row with maps and arrays (small: types, transports, codes, levels, tops).

    ``feed`` (``sessions.activity_feed``) adds ``recent_activity``, its newest entries, newest first; ``sessions``
    (stored ones) adds ``history_count``.
    """
    broken = cut_lineage(breakdowns(df))
    long = _sections(broken, top_domains, top_sources)
    entry = F.struct(F.col("value"), F.col("events"))

    def breakdown_map(name: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("section") == name, entry))).alias(name + "_breakdown")

    def top_list(name: str, alias: str) -> Column:
        ranked = F.collect_list(F.when(F.col("section") == name, F.struct("events", "last_seq", "value")))
        newest_first = F.sort_array(ranked, asc=False)
        return F.transform(newest_first, lambda e: F.struct(e["value"], e["events"])).alias(alias)

    packed = long.agg(
        *[breakdown_map(name) for name in ("transport", "record_type", "rcode", "threat_level")],
        top_list("domain", "top_domains"),
        top_list("source_ip", "top_source_ips"),
    )
    record = attach_row(scalars(df, broken), packed)
    if feed is not None:
        newest = feed.orderBy(F.desc("first_seq")).limit(dims.BUFFER_ACTIVITY)
        entry = F.struct("first_seq", "event_ts", "level", "message")
        told = F.transform(F.sort_array(F.collect_list(entry), asc=False), lambda e: e.dropFields("first_seq"))
        record = attach_row(record, newest.agg(told.alias("recent_activity")))
    if sessions is not None:
        record = attach_row(record, sessions.agg(F.count("*").alias("history_count")))
    return record
