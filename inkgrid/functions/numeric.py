"""Rounding and clamping the way the engine's numbers are defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def trunc(x) -> Column:
    """Towards zero."""
    return col(x).cast("int")


def half_even(x, digits: int = 0) -> Column:
    """To the nearest, ties to the even digit."""
    return F.bround(col(x).cast("double"), digits)


def scaled_round(x, digits: int) -> Column:
    """rint(x * 10^digits) / 10^digits: array rounding, which works on the scaled binary value."""
    scale = 10.0**digits
    return F.rint(col(x) * F.lit(scale)) / F.lit(scale)


def clamp(x, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def saturating_add(a, b) -> Column:
    """Sum of two byte values, at most 255."""
    return F.least(F.lit(255), col(a) + col(b))


def to_multiple(x, step: int = 32) -> Column:
    """The nearest multiple of ``step``, ties to the even multiple."""
    return (half_even(col(x) / F.lit(float(step))) * step).cast("int")
