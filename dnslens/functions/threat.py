"""Threat scoring rules as column expressions.

The rules split into features of the name (dear to compute, used several times)
and points, which are cheap once the features are columns. ``operators.threat``
puts them into two projections, so that each feature is computed once per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.rounding import fixed_text, round_even
from dnslens.functions.text import fill


# --- features of the name ----------------------------------------------------


def tld(name: Column) -> Column:
    """Last label in lower case; empty when the name has no dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def first_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def label_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def entropy(name: Column) -> Column:
    """Shannon entropy in bits per character of the lower-case name, dots included."""
    return entropy_of(F.lower(name), F.length(name))


def entropy_of(text: Column, size: Column) -> Column:
    """``entropy`` of a lower-case text of known length (columns, as the loop reads them often)."""

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)

    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)
    return F.when(size > 0, bits).otherwise(0.0)


def consonant_run(label: Column) -> Column:
    """Longest run of lower-case consonants; 0 below the alert length, which is all that counts."""
    long_run = f"([{dims.CONSONANTS}]{{{dims.CONSONANT_RUN},}})"
    runs = F.regexp_extract_all(label, F.lit(long_run), 1)
    longest = F.array_max(F.transform(runs, lambda run: F.length(run)))
    return F.when(label.rlike(long_run), longest).otherwise(0)


def homoglyph_form(name: Column) -> Column:
    """The name with look-alike characters folded together."""
    return F.translate(name, dims.HOMOGLYPHS_FROM, dims.HOMOGLYPHS_TO)


def typosquat_target(name: Column, brands: Sequence[str] = tuple(dims.POPULAR_DOMAINS)) -> Column:
    """The first brand the name imitates (look-alike or one edit away); null when none.

    For the short fixed list. Long brand tables go through
    ``operators.typosquat.typosquat_matches``.
    """
    return typosquat_of(F.rtrim(F.lower(name), F.lit(".")), brands)


def typosquat_of(plain: Column, brands: Sequence[str] = tuple(dims.POPULAR_DOMAINS)) -> Column:
    """``typosquat_target`` of a lower-case name without trailing dots."""
    folded = homoglyph_form(plain)
    pairs = [F.struct(F.lit(brand).alias("brand"), F.lit(_fold(brand)).alias("form")) for brand in brands]
    forms: dict[str, str] = {}
    for brand in brands:
        forms.setdefault(_fold(brand), brand)
    alike = F.try_element_at(
        F.create_map(*[F.lit(item) for pair in forms.items() for item in pair]), folded
    )
    # one edit leaves the first or the second half of a brand intact
    heads = "|".join(re.escape(brand[: len(brand) // 2]) for brand in brands)
    tails = "|".join(re.escape(brand[len(brand) // 2 :]) for brand in brands)
    lengths = [len(brand) for brand in brands]
    near = F.length(plain).between(min(lengths) - 1, max(lengths) + 1) & plain.rlike(
        f"^(?:{heads})|(?:{tails})$"
    )
    hits = F.filter(
        F.array(*pairs),
        lambda pair: (folded == pair["form"]) | (F.levenshtein(plain, pair["brand"], 1) == 1),
    )
    target = F.when(near, F.get(hits, F.lit(0))["brand"]).otherwise(alike)
    return F.when(~plain.isin(list(brands)), target)


def _fold(brand: str) -> str:
    return brand.translate(str.maketrans(dims.HOMOGLYPHS_FROM, dims.HOMOGLYPHS_TO))


# --- points and reasons ------------------------------------------------------


def rule_points(features: dict[str, Column], record_type: Column, rcode: Column) -> dict[str, Column]:
    """Points per rule. ``features`` holds columns named as in ``name_features``."""
    weights = dims.TLD_WEIGHTS.items()
    bad = [name for name, weight in weights if weight >= dims.TLD_BAD_WEIGHT]
    poor = [name for name, weight in weights if dims.TLD_POOR_WEIGHT <= weight < dims.TLD_BAD_WEIGHT]
    f = features
    numeric = f["first_label"].rlike(rf"\p{{Nd}}{{{dims.NUMERIC_RUN},}}")
    return {
        "tld": F.when(f["tld"].isin(bad), dims.POINTS_TLD_BAD)
        .when(f["tld"].isin(poor), dims.POINTS_TLD_POOR)
        .otherwise(0),
        "entropy": F.when(f["entropy"] > dims.ENTROPY_HIGH, dims.POINTS_ENTROPY_HIGH)
        .when(f["entropy"] > dims.ENTROPY_ELEVATED, dims.POINTS_ENTROPY_ELEVATED)
        .otherwise(0),
        "length": F.when(f["name_length"] > dims.NAME_VERY_LONG, dims.POINTS_NAME_VERY_LONG)
        .when(f["name_length"] > dims.NAME_LONG, dims.POINTS_NAME_LONG)
        .otherwise(0),
        "numeric": F.when(numeric, dims.POINTS_NUMERIC_LABEL).otherwise(0),
        "consonants": F.when(f["consonant_run"] >= dims.CONSONANT_RUN, dims.POINTS_CONSONANT_RUN).otherwise(0),
        "depth": F.when(f["label_count"] > dims.MAX_LABELS, dims.POINTS_DEPTH).otherwise(0),
        "record_type": F.when(record_type.isin(dims.UNUSUAL_TYPES), dims.POINTS_UNUSUAL_TYPE).otherwise(0),
        "rcode": F.when(rcode == "NXDOMAIN", dims.POINTS_NXDOMAIN)
        .when(rcode.isin("SERVFAIL", "REFUSED"), dims.POINTS_ERROR_RESPONSE)
        .otherwise(0),
        "typosquat": F.when(f["typo_target"].isNotNull(), dims.POINTS_TYPOSQUAT).otherwise(0),
    }


def rule_reasons(
    points: dict[str, Column], features: dict[str, Column], record_type: Column, rcode: Column
) -> Column:
    """Reason texts of the rules that scored, in rule order."""
    f = features

    def when(rule: str, texts: dict[int, Column]) -> Column:
        """The text that belongs to the points a rule gave."""
        choice = None
        for value, text in texts.items():
            hit = points[rule] == value
            choice = F.when(hit, text) if choice is None else choice.when(hit, text)
        return choice

    bits = fixed_text(round_even(f["entropy"], 2), 2)
    choices = [
        when("tld", {
            dims.POINTS_TLD_BAD: fill(dims.REASON_TLD_BAD, f["tld"]),
            dims.POINTS_TLD_POOR: fill(dims.REASON_TLD_POOR, f["tld"]),
        }),
        when("entropy", {
            dims.POINTS_ENTROPY_HIGH: fill(dims.REASON_ENTROPY_HIGH, bits),
            dims.POINTS_ENTROPY_ELEVATED: fill(dims.REASON_ENTROPY_ELEVATED, bits),
        }),
        when("length", {
            dims.POINTS_NAME_VERY_LONG: fill(dims.REASON_NAME_VERY_LONG, f["name_length"]),
            dims.POINTS_NAME_LONG: fill(dims.REASON_NAME_LONG, f["name_length"]),
        }),
        when("numeric", {dims.POINTS_NUMERIC_LABEL: F.lit(dims.REASON_NUMERIC_LABEL)}),
        when("consonants", {dims.POINTS_CONSONANT_RUN: fill(dims.REASON_CONSONANT_RUN, f["consonant_run"])}),
        when("depth", {dims.POINTS_DEPTH: fill(dims.REASON_DEPTH, f["label_count"])}),
        when("record_type", {dims.POINTS_UNUSUAL_TYPE: fill(dims.REASON_UNUSUAL_TYPE, record_type)}),
        when("rcode", {
            dims.POINTS_NXDOMAIN: F.lit(dims.REASON_NXDOMAIN),
            dims.POINTS_ERROR_RESPONSE: fill(dims.REASON_ERROR_RESPONSE, rcode),
        }),
        when("typosquat", {dims.POINTS_TYPOSQUAT: fill(dims.REASON_TYPOSQUAT, f["typo_target"])}),
    ]
    return F.array_compact(F.array(*choices))


def total_score(points: dict[str, Column]) -> Column:
    """Sum over the rules (may exceed 100)."""
    return reduce(lambda left, right: left + right, points.values()).cast("int")


def threat_level(score: Column) -> Column:
    return (
        F.when(score >= dims.LEVEL_HIGH, "high").when(score >= dims.LEVEL_MEDIUM, "medium").otherwise("low")
    )
