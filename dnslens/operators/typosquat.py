"""Typosquat matching against a brand table by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.threat import homoglyph_form
from dnslens.session import broadcast_if_small


def default_brands(spark) -> DataFrame:
    """The built-in popular names as a brand table."""
    rows = [(brand, position) for position, brand in enumerate(dims.POPULAR_DOMAINS)]
    return spark.createDataFrame(rows, "brand string, position int")


def _match_keys(name: Column) -> Column:
    """Keys two names share when they are look-alikes or at most one edit apart.

    A folded key for look-alikes; the name and its one-deletion variants for edits
    (two names one edit apart always share one of those).
    """
    deletions = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.concat(
            F.lit("d:"), F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))
        ),
    )
    own = F.array(F.concat(F.lit("h:"), homoglyph_form(name)), F.concat(F.lit("d:"), name))
    return F.array_distinct(F.concat(own, deletions))


def typosquat_matches(names: DataFrame, brands: DataFrame) -> DataFrame:
    """``(domain, brand)`` for every distinct name that imitates a brand.

    ``names`` has ``domain``; ``brands`` has ``brand`` and ``position`` (the first
    position wins). Names that are brands themselves are excluded. Works on distinct
    names, so a name that fills a third of the events is one row here.
    """
    plain = F.rtrim(F.lower(F.col("domain")), F.lit("."))
    distinct = names.select("domain").distinct().withColumn("_plain", plain).filter("_plain <> ''")
    brands = brands.select("brand", "position")
    exact = broadcast_if_small(brands.select(F.col("brand").alias("_plain")))
    squatters = distinct.join(exact, "_plain", "left_anti")
    left = squatters.select("domain", "_plain", F.explode(_match_keys(F.col("_plain"))).alias("_key"))
    right = broadcast_if_small(
        brands.select("brand", "position", F.explode(_match_keys(F.col("brand"))).alias("_key"))
    )
    alike = F.startswith(F.col("_key"), F.lit("h:")) | (
        F.levenshtein(F.col("_plain"), F.col("brand"), 1) == 1
    )
    return (
        left.join(right, "_key")
        .filter(alike)
        .groupBy("domain")
        .agg(F.min_by("brand", "position").alias("brand"))
    )
