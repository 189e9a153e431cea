"""Newest rows, paging, de-duplication, ordering and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.operators.ordered import newest_per_key


def latest(df: DataFrame, n: int = dims.BUFFER_EVENTS, seq: str = "seq") -> DataFrame:
    """The ``n`` newest arrivals, newest first (every task keeps its own top ``n``)."""
    return df.orderBy(F.col(seq).desc()).limit(n)


def limit_events(df: DataFrame, n: int = 0, seq: str = "seq") -> DataFrame:
    """The first ``n`` arrivals (0: all)."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("the event limit must be a non-negative integer")
    return df.orderBy(seq).limit(n) if n else df


def page(df: DataFrame, before: int | None = None, rows: int = dims.PAGE_ROWS, seq: str = "seq") -> DataFrame:
    """The next ``rows`` events older than arrival number ``before`` (a pushed-down range filter)."""
    if before is not None:
        df = df.filter(F.col(seq) < before)
    return latest(df, rows, seq)


def newest_before(df: DataFrame, rows: int = dims.PAGE_ROWS, before: int | None = None, seq: str = "seq") -> DataFrame:
    """``page`` over a store written in order of arrival, without reading it all.

    Asks for a bounded range of arrival numbers, twice as many as rows are wanted, and four times as many again while
    rows are missing; both bounds reach the scan, where the files' own statistics skip what lies outside.
    Each step counts one range; there are as many steps as the gaps in the numbers make necessary.
    """
    if before is None:
        before = (df.agg(F.max(seq)).first()[0] or 0) + 1
    least, width = None, 2 * rows
    while True:
        low = before - width
        part = df.filter((F.col(seq) >= low) & (F.col(seq) < before))
        if part.limit(rows).count() >= rows:
            break
        if least is None:
            least = df.agg(F.min(seq)).first()[0]
        if least is None or low <= least:
            break
        width *= 4
    return latest(part, rows, seq)


def latest_by_id(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per id: the newest record wins."""
    return newest_per_key(df, [key], 1, [F.col(seq).desc()])


def sort_by_time(df: DataFrame, ts: str = "event_ts", seq: str = "seq") -> DataFrame:
    """Time order, ties by arrival."""
    return df.orderBy(ts, seq)


def recent_sessions(df: DataFrame, n: int = dims.LEDGER_SESSIONS) -> DataFrame:
    """The most recently ended sessions first."""
    return df.orderBy(F.col("ended_at").desc_nulls_last(), F.col("id").desc()).limit(n)


def counts(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows per key with the first and last arrival, for tie-breaking."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("events"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    )


def top_k(counted: DataFrame, k: int, newest_first: bool = True) -> DataFrame:
    """The ``k`` most frequent rows of ``counts``; ties go to the newest or the earliest seen."""
    tie = F.col("last_seq").desc() if newest_first else F.col("first_seq").asc()
    return counted.orderBy(F.col("events").desc(), tie).limit(k)
