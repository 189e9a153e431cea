"""CSV and JSON exports of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.operators.summary import attach_row
from dnslens.operators.views import csv_rows, json_rows
from dnslens.session import held


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per event (``value``): every cell quoted, quotes doubled."""

    def quoted(name: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"'))

    order = [name for name in df.columns if name == "_seq"]
    return csv_rows(df, order).select(F.concat_ws(",", *[quoted(f"`{name}`") for name in dims.CSV_HEADER]).alias("value"), *order)


def export_csv(df: DataFrame, path: str) -> bool:
    """Write a view as CSV, newest event first; nothing is written when it is empty.

    The part files in name order make up the report; the header is the first line of
    the first part. The view is worked out once: its lines are laid down and then sorted.
    """
    lines = csv_lines(df.select("*", F.col("seq").alias("_seq")))
    with held(lines) as (rows, count):
        if not count:
            return False
        header = df.sparkSession.createDataFrame([(",".join(dims.CSV_HEADER),)], "value string")
        header.coalesce(1).union(rows.orderBy(F.desc("_seq")).select("value")).write.mode("overwrite").text(path)
    return True


def export_metadata(view: DataFrame, filters: dict[str, str] | None = None, summary: DataFrame | None = None) -> DataFrame:
    """One row: when exported, how many events, the filters and the summary record."""
    filters = filters or {}
    named = {name: filters.get(name, "") for name in ("search", "field", "target")}
    row = view.agg(F.count("*").alias("eventCount")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"),
        "eventCount",
        F.struct(*[F.lit(value).alias(name) for name, value in named.items()]).alias("filters"),
    )
    if summary is not None:
        row = attach_row(row, summary.select(F.struct(*summary.columns).alias("sessionSummary")))
    return row


def export_json(
    df: DataFrame, path: str, filters: dict[str, str] | None = None, summary: DataFrame | None = None
) -> bool:
    """Write ``path/events`` (one record per line) and ``path/metadata``; nothing when empty. The view is worked out once."""
    with held(json_rows(df.select("*", F.col("seq").alias("_seq")), ["_seq"])) as (rows, count):
        if not count:
            return False
        ordered = rows.orderBy(F.desc("_seq")).drop("_seq")
        ordered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/events")
        export_metadata(rows, filters, summary).write.mode("overwrite").json(f"{path}/metadata")
    return True
