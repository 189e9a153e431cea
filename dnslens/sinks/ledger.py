"""The session ledger on disk: the newest 50 sessions as one JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.operators.windows import recent_sessions
from dnslens.session import cut_lineage
from dnslens.sinks.keyed import KeyedTable
from dnslens.sources.sessions import RENAMED, read_sessions


def ledger_rows(sessions: DataFrame, keep: int = dims.LEDGER_SESSIONS) -> DataFrame:
    """The newest ``keep`` sessions, newest first."""
    return recent_sessions(sessions, keep)


def write_sessions(sessions: DataFrame, path: str, keep: int = dims.LEDGER_SESSIONS) -> None:
    """Replace the ledger. At most ``keep`` records, so they fit into one array."""
    back = {new: old for old, new in RENAMED.items()}
    rows = ledger_rows(sessions, keep)
    place = F.struct(F.coalesce(F.unix_micros("ended_at"), F.lit(0)).alias("at"), F.col("id").alias("key"))
    record = F.struct(*[F.col(name).alias(back.get(name, name)) for name in rows.columns])
    packed = rows.select(place.alias("place"), record.alias("record"))
    newest = F.sort_array(F.collect_list(F.struct("place.at", "place.key", "record")), asc=False)
    text = packed.agg(F.to_json(F.transform(newest, lambda e: e["record"])).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def append_sessions(sessions: DataFrame, path: str, keep: int = dims.LEDGER_SESSIONS) -> None:
    """Add sessions to the ledger. The old records (at most ``keep``) are read before the write."""
    old = read_sessions(sessions.sparkSession, path)
    merged = ledger_rows(old.unionByName(sessions, allowMissingColumns=True), keep)
    write_sessions(cut_lineage(merged), path, keep)


class Ledger:
    """Session records kept by numbered batches: a repeated batch changes nothing, a failed one leaves the records as they were.

    Every session ever merged stays; ``newest`` is the list that is shown, ``export`` writes it as the JSON array.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8) -> None:
        self._table = KeyedTable(spark, path, ["id"], "version", buckets)

    def merge(self, records: DataFrame, batch: int) -> bool:
        """Add or replace sessions (``session_records``); of two records of a session the one with the later arrival stays."""
        return self._table.merge(records.filter(F.col("id").isNotNull()), batch)

    def newest(self, keep: int = dims.LEDGER_SESSIONS) -> DataFrame | None:
        """The ``keep`` sessions that ended last; none before the first batch."""
        records = self._table.read()
        return None if records is None else ledger_rows(records.drop("version"), keep)

    def export(self, path: str, keep: int = dims.LEDGER_SESSIONS) -> bool:
        """Write the newest sessions for ``read_sessions``; nothing before the first batch."""
        rows = self.newest(keep)
        if rows is None:
            return False
        write_sessions(rows, path, keep)
        return True

    def vacuum(self) -> int:
        """Delete what no reader needs any more."""
        return self._table.vacuum()
