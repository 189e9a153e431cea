"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnslens import dims


def strip(col: Column) -> Column:
    """Remove white space (not only blanks) at both ends."""
    return F.trim(col, F.lit(dims.WHITESPACE))


def rstrip(col: Column) -> Column:
    """Remove white space at the right end."""
    return F.rtrim(col, F.lit(dims.WHITESPACE))


def non_empty(col: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(col, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[non_empty(col) for col in cols])


def fill(template: str, *values: Column | str) -> Column:
    """A fixed text with its ``%s`` places filled in order (plain concatenation)."""
    parts = template.split("%s")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit(part)]
    return F.concat(*pieces)


def clean_domain(col: Column) -> Column:
    """A query name without trailing dots; null when nothing is left (drop those rows)."""
    return non_empty(F.rtrim(col, F.lit(".")))


def normalize_target(col: Column) -> Column:
    """Host of a URL (lower case), or the bare name as given; null when empty."""
    text = strip(col)
    authority = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]?|[^:/?#]*)"
    host = F.translate(F.lower(F.regexp_extract(text, authority, 1)), "[]", "")
    picked = F.when(F.contains(text, F.lit("://")), host).otherwise(text)
    return F.when(picked != "", F.rtrim(picked, F.lit(".")))


def short_label(col: Column) -> Column:
    """Chart label: names over 28 characters become their first 26 and an ellipsis."""
    return F.when(F.length(col) > 28, F.concat(F.substring(col, 1, 26), F.lit("…"))).otherwise(col)
