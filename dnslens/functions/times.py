"""Timestamps: parsing, ISO output, relative and duration labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnslens.functions.text import strip

# Years 1 to 9999, the range of a calendar timestamp.
_MIN_EPOCH, _MAX_EPOCH = -62135596800.0, 253402300799.0


def epoch_to_ts(col: Column, default: Column | None = None) -> Column:
    """Epoch seconds (number or text) to a timestamp, to the nearest microsecond.

    Unreadable values give ``default`` (null unless set; live jobs pass
    ``current_timestamp()``).
    """
    seconds = col.try_cast("double")
    valid = seconds.between(_MIN_EPOCH, _MAX_EPOCH)
    ts = F.when(valid, F.timestamp_micros(F.rint(seconds * F.lit(1e6)).cast("bigint")))
    return ts if default is None else F.coalesce(ts, default)


def parse_iso(col: Column) -> Column:
    """ISO-8601 text (``Z`` accepted) to a timestamp; null when unreadable."""
    text = strip(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(text))


def iso_micros(ts: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss[.ffffff]+00:00`` with the fraction left out when zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit("+00:00"),
    )


def iso_millis(ts: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss.fffZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_label(ts: Column, now: Column) -> Column:
    """``Just now``, ``12s ago``, ``5m ago`` or ``3h ago``."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6) + F.lit(0.5))
    return (
        F.when(ts.isNull(), F.lit("No updates yet"))
        .when(seconds < 5, F.lit("Just now"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    )


def duration_label(start: Column, end: Column) -> Column:
    """``Xm Ys`` between two timestamps."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6))
    return F.concat(
        F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")
    )


def session_id(ts: Column) -> Column:
    """``session-`` and the start in epoch milliseconds."""
    return F.concat(F.lit("session-"), F.unix_millis(ts).cast("string"))
