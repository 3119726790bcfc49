"""Velocities and displacement time series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a year as velocities count them.
YEAR = 365.25


def phase_to_mm(phase: Column, wavelength: Column) -> Column:
    """Radians to millimetres towards the sensor's line of sight."""
    return -phase * wavelength * 1000 / (4 * math.pi)


def reference_means(samples: DataFrame, keys: list[str], phase: str, in_reference: Column) -> DataFrame:
    """(keys, ref): mean phase over the reference area; over all points where the area holds none of them."""
    ok = F.col(phase).isNotNull() & ~F.isnan(phase)
    return samples.groupBy(*keys).agg(F.coalesce(F.avg(F.when(ok & in_reference, F.col(phase))), F.avg(F.when(ok, F.col(phase)))).alias("ref"))


def velocity(series: DataFrame, point: list[str], phase: str, day: str, wavelength: str, weight: str | None = None) -> DataFrame:
    """(point, velocity mm a year, n): least squares on an offset and the day, weighted where a weight is given."""
    w = F.col(weight) if weight else F.lit(1.0)
    t, p = F.col(day).cast("double"), F.col(phase).cast("double")
    sums = series.groupBy(*point).agg(
        F.count("*").alias("n"), F.max(wavelength).alias("_l"), F.min(t).alias("_t0"),
        F.sum(w).alias("sw"), F.sum(w * t).alias("st"), F.sum(w * p).alias("sp"), F.sum(w * t * t).alias("stt"), F.sum(w * t * p).alias("stp"),
    )
    det = F.col("sw") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when(det > 1e-9, (F.col("sw") * F.col("stp") - F.col("st") * F.col("sp")) / det)
    return sums.select(*point, (-slope * YEAR / (4 * math.pi) * F.col("_l") * 1000).alias("velocity"), "n")


def gap_filled(grid: DataFrame, point: str, order: str, value: str) -> DataFrame:
    """grid with `filled`: missing values interpolated between the nearest present ones, then nearest, then 0; re-zeroed at the first.

    Two windows over the same partitioning and order, so one shuffle and one sort.
    """
    back = Window.partitionBy(point).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(point).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    held = grid.withColumn("_v", v)
    at = F.when(F.col("_v").isNotNull(), F.col(order))
    pv, nv = F.last("_v", True).over(back), F.first("_v", True).over(ahead)
    pt, nt = F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = pv + (nv - pv) * (F.col(order) - pt) / F.when(nt > pt, nt - pt)
    filled = F.coalesce("_v", between, pv, nv, F.lit(0.0))
    out = held.withColumn("filled", filled)
    return out.withColumn("filled", F.col("filled") - F.first("filled").over(back)).drop("_v")


def wide(series: DataFrame, point: list[str], order: str, value: str, columns: dict[int, str]) -> DataFrame:
    """One row per point with a column per date; the columns are known, so no extra pass looks for them."""
    return series.groupBy(*point).agg(*(F.max(F.when(F.col(order) == k, F.col(value))).alias(name) for k, name in columns.items()))
