"""Rounding and fixed-point averages.

Scores are reported with four digits and ties go to the even digit. ``rint``
is an IEEE operation, so it stays inside code generation and gives the same
bits on every executor (``bround`` goes through BigDecimal row by row).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column, digits: int = 4) -> Column:
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def to_fixed(col: Column, digits: int = 4) -> Column:
    """Rounded value as an integer number of 10**-digits units."""
    return F.rint(col * F.lit(float(10**digits))).cast("long")


def mean_fixed(units: Column, digits: int = 4) -> Column:
    """Mean of :func:`to_fixed` values, rounded to ``digits``.

    Integer sums do not depend on the order in which partitions merge, so the
    result is reproducible after any shuffle or task retry.
    """
    return F.rint(F.sum(units) / F.count(units)) / F.lit(float(10**digits))


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
