"""Phase summed on a grid, and looked up from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgrid.functions.cplx import polar


def cell(v: Column, least: Column, size: float, eps: float = 1e-6) -> Column:
    """1-based cell of a coordinate: ceil((v - least + eps) / size)."""
    return F.ceil((v - least + eps) / size).cast("int")


def with_cells(points: DataFrame, group: list[str], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """points with 0-based gi (along y) and gj (along x); the last cell of an axis is folded into the one before it."""
    least = points.groupBy(*group).agg(F.min(y).alias("_y0"), F.min(x).alias("_x0"), F.max(y).alias("_y1"), F.max(x).alias("_x1"))
    j = points.join(least, group)
    out = j
    for name, v, lo, hi in (("gi", y, "_y0", "_y1"), ("gj", x, "_x0", "_x1")):
        last = cell(F.col(hi), F.col(lo), size)
        own = cell(F.col(v), F.col(lo), size)
        out = out.withColumn(name, F.when((own == last) & (last > 1), own - 1).otherwise(own) - 1)
    return out.select(*points.columns, "gi", "gj")


def accumulate(samples: DataFrame, keys: list[str], phase: str, weight: str | None = None) -> DataFrame:
    """keys, re, im, n: complex sums; map-side sums keep the shuffle at one row per cell and task."""
    re, im = polar(F.col(phase))
    w = F.col(weight) if weight else F.lit(1.0)
    return samples.groupBy(*keys).agg(F.sum(w * re).alias("re"), F.sum(w * im).alias("im"), F.count("*").alias("n"))
