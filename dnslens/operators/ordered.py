"""Ordered operators that stay exact when one key holds most of the rows.

A window over a whole key puts that key into one task. Here a key's rows are cut
into chunks by their arrival number ``seq`` (unique, so a chunk holds at most
``chunk_rows`` rows). Windows run per (key, chunk); what a chunk needs to know of
the chunks before it is one small summary row per chunk, carried over by a window
over the summaries and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens import dims

_CHUNK = "_chunk"


_KEY = "_k"


def _with_chunk(df: DataFrame, keys: Sequence[str], seq: str, chunk_rows: int) -> DataFrame:
    """Rows with their chunk and their key as one value that is never null (a struct of nulls equals itself).

    Window, summary and join all use this pair, so they share one exchange of the rows.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({_KEY: key, _CHUNK: F.col(seq) - F.pmod(F.col(seq), F.lit(chunk_rows))})


def _join_back(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Join the chunk summaries to the rows."""
    return rows.join(summary, [_KEY, _CHUNK])


def _before():
    """All earlier chunks of the key (a window over summaries only)."""
    return Window.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_rank(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", rank: str = "rank", chunk_rows: int = dims.CHUNK_ROWS
) -> DataFrame:
    """Exact ``row_number`` per key by ``seq``."""
    rows = _with_chunk(df, keys, seq, chunk_rows)
    sizes = rows.groupBy(_KEY, _CHUNK).agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        _KEY, _CHUNK, F.coalesce(F.sum("_rows").over(_before()), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(_KEY, _CHUNK).orderBy(seq)
    rows = rows.withColumn("_local", F.row_number().over(local))
    ranked = _join_back(rows, offsets)
    return ranked.withColumn(rank, F.col("_local") + F.col("_offset")).drop("_local", "_offset", _CHUNK, _KEY)


def with_island(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    seq: str = "seq",
    island: str = "island",
    chunk_rows: int = dims.CHUNK_ROWS,
) -> DataFrame:
    """Label runs of consecutive rows with equal ``values``: the ``seq`` of the run's first row."""
    value = F.struct(*values)
    local = Window.partitionBy(_KEY, _CHUNK).orderBy(seq)
    rows = _with_chunk(df, keys, seq, chunk_rows)
    rows = rows.withColumn("_value", value).withColumn("_prev", F.lag("_value").over(local))
    changed = F.col("_prev").isNotNull() & ~F.col("_value").eqNullSafe(F.col("_prev"))
    rows = rows.withColumn("_start", F.when(changed, F.col(seq)))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_local", F.max("_start").over(running))

    summary = rows.groupBy(_KEY, _CHUNK).agg(
        F.min(seq).alias("_first_seq"),
        F.min_by("_value", seq).alias("_first_value"),
        F.max_by("_value", seq).alias("_last_value"),
        F.max("_start").alias("_last_start"),
    )
    by_chunk = Window.partitionBy(_KEY).orderBy(_CHUNK)
    summary = summary.withColumn("_tail", F.lag("_last_value").over(by_chunk))
    continues = F.col("_tail").isNotNull() & F.col("_first_value").eqNullSafe(F.col("_tail"))
    opened = F.when(~continues, F.col("_first_seq"))
    summary = summary.withColumn("_opened", opened)
    latest = F.coalesce(F.col("_last_start"), F.col("_opened"))
    summary = summary.withColumn("_latest", latest)
    carried = F.last("_latest", ignorenulls=True).over(_before())
    entry = summary.select(_KEY, _CHUNK, F.coalesce(F.col("_opened"), carried).alias("_entry"))

    labelled = _join_back(rows, entry)
    return labelled.withColumn(island, F.coalesce("_local", "_entry")).drop(
        "_value", "_prev", "_start", "_local", "_entry", _CHUNK, _KEY
    )


def with_previous_max(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    seq: str = "seq",
    out: str = "previous_max",
    chunk_rows: int = dims.CHUNK_ROWS,
) -> DataFrame:
    """Greatest ``col`` among the earlier rows of the key (null for the first)."""
    local = Window.partitionBy(_KEY, _CHUNK).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_chunk(df, keys, seq, chunk_rows)
    tops = rows.groupBy(_KEY, _CHUNK).agg(F.max(col).alias("_top"))
    tops = tops.select(_KEY, _CHUNK, F.max("_top").over(_before()).alias("_before"))
    rows = rows.withColumn("_local", F.max(col).over(local))
    joined = _join_back(rows, tops)
    return joined.withColumn(out, F.greatest("_local", "_before")).drop("_local", "_before", _CHUNK, _KEY)


def newest_per_key(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Spark cuts every key to ``n`` rows before the shuffle (window group limit, for
    ``n`` up to 1000), so a hot key sends few rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")
