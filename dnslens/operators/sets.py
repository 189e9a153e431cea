"""Unions of event sources and address sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of several sources under one schema; missing columns are null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def address_sets(df: DataFrame, name: str = "domain", answers: str = "answers") -> DataFrame:
    """Distinct answer addresses per name and family, in long form: ``(domain, family, address)``.

    A distinct shuffles pre-aggregated rows by all columns, so a name with very many
    answers is spread over tasks. Sort the result for ordered lists.
    """
    pairs = df.select(F.col(name).alias("domain"), F.explode(answers).alias("address"))
    family = (
        F.when(F.col("address").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(F.col("address").rlike(r"^[0-9A-Fa-f]*:[0-9A-Fa-f:.]*$"), "ipv6")
    )
    return pairs.withColumn("family", family).filter(F.col("family").isNotNull()).select(
        "domain", "family", "address"
    ).distinct()
