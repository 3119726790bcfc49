"""Complex numbers as pairs of columns, and phase helpers; Spark has no complex type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def cmul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def cabs(a: Pair) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1])


def cangle(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def polar(phase: Column) -> Pair:
    return F.cos(phase), F.sin(phase)


def wrap(phase: Column) -> Column:
    """Phase brought to (-pi, pi]."""
    return F.atan2(F.sin(phase), F.cos(phase))


def unit(a: Pair) -> Pair:
    """a / |a|; zero stays zero."""
    r = cabs(a)
    return F.when(r > 0, a[0] / r).otherwise(0.0), F.when(r > 0, a[1] / r).otherwise(0.0)


def arrays_sum(values: Column, step) -> Column:
    """Sum of step(x, index) over an array, in one pass without exploding it."""
    indexed = F.transform(values, step)
    return F.aggregate(indexed, F.lit(0.0), lambda total, x: total + x)


def dot(values: Column, weights: list[float]) -> Column:
    """Dot product of an array column with a small constant vector."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(values, w, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
