"""Threat scoring of events, and the redirect policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions import threat as rules
from dnslens.functions.text import non_empty
from dnslens.operators.typosquat import typosquat_matches

FEATURES = (
    "tld",
    "entropy",
    "name_length",
    "first_label",
    "label_count",
    "consonant_run",
    "typo_target",
)
_PREFIX = "_f_"
_POINTS = "_p_"


def name_features(df: DataFrame, name: str = "domain", prefix: str = "", typosquat: bool = True) -> DataFrame:
    """Add the features the rules need (see ``FEATURES``) as columns.

    With ``typosquat`` off, ``typo_target`` is left to the caller (brand tables).
    """
    col = F.col(name)
    # the loops over characters and brands read these often, so they are columns of their own
    df = df.withColumns({"_n_lower": F.lower(col), "_n_size": F.length(col)})
    df = df.withColumn("_n_label", rules.first_label(col))
    features = {
        "tld": rules.tld(col),
        "entropy": rules.entropy_of(F.col("_n_lower"), F.col("_n_size")),
        "name_length": F.col("_n_size"),
        "first_label": F.col("_n_label"),
        "label_count": rules.label_count(col),
        "consonant_run": rules.consonant_run(F.col("_n_label")),
    }
    if typosquat:
        features["typo_target"] = rules.typosquat_of(F.rtrim(F.col("_n_lower"), F.lit(".")))
    df = df.withColumns({prefix + key: value for key, value in features.items()})
    return df.drop("_n_lower", "_n_size", "_n_label")


def _apply_rules(df: DataFrame) -> DataFrame:
    """Points, score, level and reasons from feature columns; drops the helpers.

    Score and level come out of ``inline``: a filter on them stays above it and is
    evaluated on ready values, where a plain projection would let Spark push the
    filter down and compute every rule twice. Filters on other columns still reach
    the scan, and unused reasons are pruned.
    """
    features = {key: F.col(_PREFIX + key) for key in FEATURES}
    record_type, rcode = F.col("record_type"), F.col("rcode")
    points = rules.rule_points(features, record_type, rcode)
    df = df.withColumns({_POINTS + key: value for key, value in points.items()})
    points = {key: F.col(_POINTS + key) for key in points}
    score = rules.total_score(points)
    result = F.struct(score.alias("threat_score"), rules.threat_level(score).alias("threat_level"))
    df = df.select("*", F.inline(F.array(result)))
    df = df.withColumn("threat_reasons", rules.rule_reasons(points, features, record_type, rcode))
    return df.drop(*[c for c in df.columns if c.startswith((_PREFIX, _POINTS))])


def score_events(df: DataFrame, per_name: bool = False, brands: DataFrame | None = None) -> DataFrame:
    """Add ``threat_score``, ``threat_level`` and ``threat_reasons``.

    Needs ``domain``, ``record_type`` and ``rcode``. The plain form is one narrow
    stage: no shuffle, so a hot name costs nothing extra; use it by default.

    ``per_name`` computes the features once per distinct name and joins them back.
    It pays when few names make up most rows and the table is partitioned by name
    already; AQE picks the join and splits a hot name's partition.

    ``brands`` (``brand``, ``position``) replaces the built-in list of popular names.
    """
    if not per_name and brands is None:
        return _apply_rules(name_features(df, prefix=_PREFIX))
    names = df.select("domain").distinct()
    features = name_features(names, prefix=_PREFIX, typosquat=brands is None)
    if brands is not None:
        targets = typosquat_matches(names, brands).select("domain", F.col("brand").alias(_PREFIX + "typo_target"))
        features = features.join(targets, "domain", "left")
    return _apply_rules(df.join(features, "domain", "left"))


def rule_breakdown(df: DataFrame) -> DataFrame:
    """One row per event with the points of every rule (``points_<rule>``)."""
    df = name_features(df, prefix=_PREFIX)
    features = {key: F.col(_PREFIX + key) for key in FEATURES}
    points = rules.rule_points(features, F.col("record_type"), F.col("rcode"))
    df = df.withColumns({"points_" + key: value for key, value in points.items()})
    return df.drop(*[_PREFIX + key for key in FEATURES])


def apply_redirect(df: DataFrame, address: str | None) -> DataFrame:
    """Mark high-threat IPv4 UDP queries as redirected to ``address``.

    ``answers`` becomes the address, ``answer_count`` stays. Without an address the
    events pass unchanged. Needs ``is_response``; no packet is sent.
    """
    if not address:
        return df.withColumn("action", F.lit(None).cast("string"))
    ipv4 = F.col("source_ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    redirected = (
        (F.col("threat_level") == "high")
        & ~F.coalesce(F.col("is_response"), F.lit(True))
        & (F.col("transport") == "udp")
        & ipv4
    )
    return df.withColumns(
        {
            "action": F.when(redirected, F.lit(dims.ACTION_REDIRECTED)),
            "answers": F.when(redirected, F.array(F.lit(address))).otherwise(F.col("answers")),
        }
    )


def reason_counts(df: DataFrame) -> DataFrame:
    """How often each kind of reason occurs (the text before the bracket).

    The outer form keeps Spark from filtering on the array below the scoring, which
    would compute the scores twice.
    """
    kind = F.trim(F.regexp_replace(F.col("reason"), r"(\(.*| of .*)$", ""))
    return (
        df.select(F.explode_outer("threat_reasons").alias("reason"))
        .filter(F.col("reason").isNotNull())
        .groupBy(kind.alias("reason"))
        .agg(F.count("*").alias("events"))
    )


def tld_reputation(df: DataFrame) -> DataFrame:
    """Events per weighted top-level domain: counts first, then a lookup join on the totals."""
    spark = df.sparkSession
    weights = spark.createDataFrame(sorted(dims.TLD_WEIGHTS.items()), "tld string, weight int")
    totals = df.groupBy(non_empty(rules.tld(F.col("domain"))).alias("tld")).agg(F.count("*").alias("events"))
    # the weight table is a constant of this library, 21 rows
    return totals.join(F.broadcast(weights), "tld")
