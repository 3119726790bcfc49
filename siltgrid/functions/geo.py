"""Map projection and axes of a scene."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 semi-major axis in metres and eccentricity.
AXIS, ECCENTRICITY = 6378137.0, 0.08209443794970


def _meridian_terms() -> list[tuple[float, int]]:
    e2 = ECCENTRICITY**2
    e4, e6 = e2 * e2, e2**3
    return [
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 0),
        (-(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024), 2),
        (15 * e4 / 256 + 45 * e6 / 1024, 4),
        (-35 * e6 / 3072, 6),
    ]


def meridian(lat: Column) -> Column:
    """Metres along the meridian from the equator; lat in radians."""
    total = None
    for factor, k in _meridian_terms():
        term = factor * (lat if k == 0 else F.sin(k * lat))
        total = term if total is None else total + term
    return AXIS * total


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north of (lon0, lat0) on the polyconic projection, in metres; the equator is its own case."""
    la, la0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    e = d * F.sin(la)
    n = AXIS / F.sqrt(1 - ECCENTRICITY**2 * F.sin(la) ** 2)
    cot = F.cos(la) / F.sin(la)
    x = F.when(lat == 0, AXIS * d).otherwise(n * cot * F.sin(e))
    y = F.when(lat == 0, -meridian(la0)).otherwise(meridian(la) - meridian(la0) + n * cot * (1 - F.cos(e)))
    return x, y


def heading_angle(heading: Column) -> Column:
    """Rotation of a scene's axes in radians: 180 degrees less the heading, within (-pi, pi]."""
    t = F.radians(180 - heading)
    return F.when(t > math.pi, t - 2 * math.pi).otherwise(t)


def rotated(points: DataFrame, group: list[str], x: str = "x", y: str = "y", angle: str = "angle") -> DataFrame:
    """points with x and y turned by each group's angle, where that strictly shrinks both of its spans.

    Spans are aggregated per group before anything is joined back, so a group with a third of all rows costs a row per task.
    """
    c, s = F.cos(angle), F.sin(angle)
    turned = points.withColumn("_x", c * F.col(x) + s * F.col(y)).withColumn("_y", -s * F.col(x) + c * F.col(y))
    span = lambda k: F.max(k) - F.min(k)
    better = turned.groupBy(*group).agg(((span("_x") < span(x)) & (span("_y") < span(y))).alias("_better"))
    joined = turned.join(better, group)
    pick = lambda a, b: F.when(F.col("_better"), F.col(a)).otherwise(F.col(b))
    return joined.withColumn(x, pick("_x", x)).withColumn(y, pick("_y", y)).withColumnRenamed("_better", "is_rotated").drop("_x", "_y")


def to_millimetres(metres: Column) -> Column:
    """Rounded to the millimetre, halves to even."""
    return F.rint(metres * 1000) / 1000


def angle_in_radians(degrees: Column) -> Column:
    """Degrees to radians; 0 stands for no value and stays 0."""
    return F.when(degrees != 0, F.radians(degrees)).otherwise(degrees)
