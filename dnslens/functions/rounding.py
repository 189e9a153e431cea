"""Rounding of the exact binary value of a double.

``round`` and ``bround`` look at the shortest decimal text of a double, so 0.15
(stored a little below) becomes 0.2. ``%.1f`` of C-like languages gives 0.1. The
functions here scale with an exact error term, so they agree with the latter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of two that add up to the scale; scaling by each is exact.
_SCALES = {1: (8.0, 2.0), 2: (64.0, 32.0, 4.0)}


def _scaled(col: Column, digits: int) -> tuple[Column, Column]:
    """``col * 10**digits`` as a sum and the rounding error of that sum."""
    terms = [col * F.lit(part) for part in _SCALES[digits]]
    total, error = terms[0], F.lit(0.0)
    for term in terms[1:]:
        grown = total + term
        back = grown - total
        error = error + ((total - (grown - back)) + (term - back))
        total = grown
    return total, error


def round_even(col: Column, digits: int) -> Column:
    """Nearest decimal, exact ties to the even digit (``%.Nf``)."""
    return _round(col, digits, ties_up=False)


def round_up(col: Column, digits: int) -> Column:
    """Nearest decimal, exact ties upwards."""
    return _round(col, digits, ties_up=True)


def _round(col: Column, digits: int, ties_up: bool) -> Column:
    total, error = _scaled(col.cast("double"), digits)
    low = F.floor(total)
    rest = total - low
    tie = (rest == 0.5) & (error == 0.0)
    up = (rest > 0.5) | ((rest == 0.5) & (error > 0.0))
    up = up | (tie if ties_up else tie & (F.pmod(low, F.lit(2)) == 1))
    return (low + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(10**digits))


def fixed_text(rounded: Column, digits: int) -> Column:
    """Text of a value already rounded to ``digits`` places."""
    return F.format_string(f"%.{digits}f", rounded)
