"""Vector expressions over ``array<float>`` columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, single_frame: bool = False) -> Column:
    """Scale to unit length with a norm floor of 1e-8.

    A batch divides by ``max(norm, 1e-8)``; a single frame whose norm does not
    exceed the floor becomes a zero vector.
    """
    n = norm(v)
    if single_frame:
        return F.transform(v, lambda x: F.when(n > 1e-8, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-8)))


def unit_clip(sim: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, negative values clipped to zero."""
    return unit_clip(dot(a, b))
