"""Threat alerts with suppression, focus alerts and the traffic series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens import dims
from dnslens.functions.text import fill, non_empty
from dnslens.operators.ordered import with_island, with_previous_max
from dnslens.session import broadcast_if_small, cut_lineage, written

DEFAULT_GAP = "10 seconds"
# Candidates one key may have before its suppression is split over many tasks.
MAX_GROUP_ROWS = 100_000


def gap_micros(gap: str) -> int:
    """Microseconds of a fixed interval such as ``10 seconds`` or ``6 hours``."""
    return int(pd.Timedelta(gap) / pd.Timedelta(1, "us"))


def alert_message() -> Column:
    """The first two reasons, or a default text."""
    text = F.array_join(F.slice(F.coalesce("threat_reasons", F.array().cast("array<string>")), 1, 2), " • ")
    return F.coalesce(non_empty(text), F.lit(dims.NOTE_ALERT))


def alert_candidates(events: DataFrame) -> DataFrame:
    """Medium and high events as ``(seq, event_ts, domain, threat_level, message)``."""
    level = F.coalesce("threat_level", F.lit("low"))
    return events.filter(level != "low").select(
        "seq", "event_ts", "domain", "threat_level", alert_message().alias("message")
    )


def keep_after_gap(times: np.ndarray, gap: int, last: int | None = None) -> list[int]:
    """Positions kept when an event within ``gap`` of the last kept one is dropped.

    ``times`` may step back; such rows are within the gap by definition, which is why
    a running maximum finds the next row to keep.
    """
    top = np.maximum.accumulate(times)
    kept: list[int] = []
    at = 0 if last is None else int(np.searchsorted(top, last + gap))
    while at < len(top):
        kept.append(at)
        at = int(np.searchsorted(top, top[at] + gap))
    return kept


def _kept_positions(gap: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def positions(times: pd.Series) -> pd.Series:
        return times.map(lambda row: keep_after_gap(np.asarray(row, dtype=np.int64), gap))

    # otherwise Spark repeats the call in a filter it derives from the explode
    return positions.asNondeterministic()


def _suppress_small(rows: DataFrame, gap: int, payload: list[str]) -> DataFrame:
    """Suppression for keys of bounded size: one array per key, sorted by ``(order, seq)``.

    Only the times cross to Python; many keys share one Arrow batch.
    """
    entry = F.struct("_order", "seq", "_time", *payload)
    grouped = rows.groupBy("_key").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    times = F.transform("_rows", lambda e: e["_time"])
    kept = grouped.withColumn("_kept", _kept_positions(gap)(times))
    picked = kept.select(F.explode("_kept").alias("_at"), "_rows").select(F.get("_rows", "_at").alias("_r"))
    return picked.select("_r.seq", *[f"_r.{name}" for name in payload])


def step_map(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a slice of sorted times does to the moment from which an alert is due again.

    ``(entries, exits)``: a moment up to ``entries[i]``, and after ``entries[i - 1]``, becomes ``exits[i]``; later ones stay as they are.
    A moment that enters is at most ``gap`` after the slice's first time, so only entries up to the first one behind that are kept.
    Every time points to the next one due; the pointers are followed to the slice's end in doubling strides.
    """
    count = len(times)
    onward = np.searchsorted(times, times + gap)
    last = np.where(onward < count, onward, np.arange(count))
    while (last[last] != last).any():
        last = last[last]
    exits = times[last] + gap
    used = min(count, int(np.searchsorted(times, times[0] + gap, "right")) + 1)
    entries, exits = times[:used], exits[:used]
    new = np.append(exits[1:] != exits[:-1], True)
    return entries[new], exits[new]


def _slice_maps(gap: int):
    @F.pandas_udf("entries array<bigint>, exits array<bigint>")
    def maps(times: pd.Series) -> pd.DataFrame:
        pairs = [step_map(np.asarray(row, dtype=np.int64), gap) for row in times]
        return pd.DataFrame({"entries": [entries for entries, _ in pairs], "exits": [exits for _, exits in pairs]})

    return maps


def _kept_from(gap: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def positions(times: pd.Series, due: pd.Series) -> pd.Series:
        return pd.Series([keep_after_gap(np.asarray(row, dtype=np.int64), gap, int(at) - gap) for row, at in zip(times, due, strict=True)])

    return positions.asNondeterministic()


def slice_count(points: int, slice_rows: int, cores: int) -> int:
    """Slices of about ``slice_rows`` points, but not more than four a core where those have up to ``MAX_GROUP_ROWS``."""
    return max(1, min(-(-points // slice_rows), max(4 * cores, -(-points // MAX_GROUP_ROWS))))


def _suppress_split(rows: DataFrame, gap: int, payload: list[str], slice_rows: int) -> DataFrame:
    """Suppression for keys of any size, cut into slices in order of time (``slice_count``).

    A task holds one slice, with the parts of all keys that fall into it, each an array. Only a key that lies in
    several slices, at most one for each border, needs their step maps: short ones, applied one after
    another to find the moment from which each slice may alert. Then all arrays pick their rows.
    """
    first = F.min_by(F.struct("seq", *payload), F.struct("_order", "seq"))
    points = written(rows.groupBy("_key", "_time").agg(first.alias("_row")))
    slices = slice_count(points.count(), slice_rows, points.sparkSession.sparkContext.defaultParallelism)
    parts = points.repartitionByRange(slices, "_key", "_time").withColumn("_slice", F.spark_partition_id())
    parts = written(parts.groupBy("_key", "_slice").agg(F.sort_array(F.collect_list(F.struct("_time", "_row"))).alias("_rows")))
    times = F.transform("_rows", lambda e: e["_time"])
    never = np.iinfo(np.int64).min // 2

    def follow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, due, dues = frame.sort_values("_slice"), never, []
        for entries, exits in zip(frame["entries"], frame["exits"], strict=True):
            dues.append(due)
            at = int(np.searchsorted(entries, due))
            due = int(exits[at]) if at < len(exits) else due
        return pd.DataFrame({"_key": key[0], "_slice": frame["_slice"], "due": dues})

    kind = parts.schema["_key"].dataType.simpleString()
    several = parts.groupBy("_key").count().filter("count > 1").select("_key")
    maps = parts.join(broadcast_if_small(several), "_key", "left_semi").select("_key", "_slice", _slice_maps(gap)(times).alias("_map"))
    maps = maps.select("_key", "_slice", "_map.entries", "_map.exits")
    due = written(maps.groupBy("_key").applyInPandas(follow, f"_key {kind}, _slice int, due bigint"))
    kept = parts.join(broadcast_if_small(due), ["_key", "_slice"], "left")
    kept = kept.withColumn("_kept", _kept_from(gap)(times, F.coalesce("due", F.lit(never))))
    picked = kept.select(F.explode("_kept").alias("_at"), "_rows").select(F.get("_rows", "_at")["_row"].alias("_r"))
    return picked.select("_r.*")


def alerts(
    events: DataFrame,
    gap: str = DEFAULT_GAP,
    scope: str = "domain",
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = dims.CHUNK_ROWS,
) -> DataFrame:
    """Medium and high events, without repeats within ``gap`` of the last alert.

    ``scope='domain'``: per name, in time order; a suppressed event does not restart
    the gap. ``scope='arrival'``: only the name of the last alert is remembered, in
    arrival order, so a different name in between lifts the suppression.

    An event without a time can be within no gap: it always alerts, and takes no part
    in the suppression of others.

    The candidates are scored once and kept as a compact table. Keys with up to
    ``max_group_rows`` candidates (counted) are then handled in one shuffle, larger
    ones are split by time; both give the same rows.
    """
    wanted = gap_micros(gap)
    payload = ["event_ts", "domain", "threat_level", "message"]
    if scope not in ("domain", "arrival"):
        raise ValueError(f"unknown scope: {scope}")
    candidates = cut_lineage(alert_candidates(events))
    untimed = candidates.filter(F.col("event_ts").isNull()).select("seq", *payload)
    rows = candidates.filter(F.col("event_ts").isNotNull()).withColumn("_time", F.unix_micros("event_ts"))
    if scope == "domain":
        rows = rows.withColumns({"_key": F.col("domain"), "_order": F.col("_time")})
    else:
        runs = with_island(rows, [], ["domain"], island="_key", chunk_rows=chunk_rows)
        rows = cut_lineage(runs.withColumn("_order", F.col("seq")))  # read three times below

    hot = rows.groupBy("_key").count().filter(F.col("count") > max_group_rows).select("_key")
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return _suppress_small(rows, wanted, payload).unionByName(untimed)
    hot = broadcast_if_small(hot)
    large = rows.join(hot, "_key", "left_semi")
    if scope == "arrival":
        # a row can only be kept when it is later than everything before it in its run
        large = with_previous_max(large, ["_key"], "_time", chunk_rows=chunk_rows)
        large = large.filter(F.col("previous_max").isNull() | (F.col("_time") > F.col("previous_max")))
    split = _suppress_split(large, wanted, payload, max_group_rows)
    small = _suppress_small(rows.join(hot, "_key", "left_anti"), wanted, payload)
    return small.unionByName(split).unionByName(untimed)


def focus_alerts(events: DataFrame, address: str) -> DataFrame:
    """One note per event from or to ``address``; error level for high threats."""
    note = fill(dims.NOTE_FOCUS, address, F.col("domain"))
    level = F.when(F.col("threat_level") == "high", "error").otherwise("warning")
    hit = (F.col("source_ip") == address) | (F.col("destination_ip") == address)
    return events.filter(hit).select("seq", "event_ts", level.alias("level"), note.alias("message"))


def traffic_counts(events: DataFrame, bucket: str = "1 second") -> DataFrame:
    """Events per time bucket (batch or stream): ``(bucket_start, events)``."""
    counted = events.groupBy(F.window("event_ts", bucket)).agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("bucket_start"), "events")


def traffic_series(events: DataFrame, bucket: str = "1 second", buckets: int = 60) -> DataFrame:
    """The last ``buckets`` time buckets up to the newest event, idle ones with 0.

    The newest time comes first (one number); only events of the buckets shown are counted.
    """
    step = gap_micros(bucket)
    newest = events.agg(F.max(F.unix_micros("event_ts")).alias("at"))
    last = newest.select((F.col("at") - F.pmod("at", F.lit(step))).alias("last")).filter(F.col("last").isNotNull())
    first = newest.select(F.timestamp_micros(F.col("at") - F.pmod("at", F.lit(step)) - F.lit((buckets - 1) * step))).scalar()
    counted = traffic_counts(events.filter(F.col("event_ts") >= first), bucket)
    places = F.sequence(F.col("last") - F.lit((buckets - 1) * step), F.col("last"), F.lit(step).cast("long"))
    grid = last.select(F.explode(places).alias("at")).select(F.timestamp_micros("at").alias("bucket_start"))
    joined = grid.join(counted, "bucket_start", "left")
    return joined.select("bucket_start", F.coalesce("events", F.lit(0)).alias("events"))
