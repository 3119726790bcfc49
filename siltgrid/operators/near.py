"""Points near other points on the ground, as an equi-join on grid cells of earth-centred coordinates.

Positions are put on a sphere in metres, so longitudes 360 apart, the antimeridian and the poles need no care. Each
point stays once in its home cell on one side of the join and is copied on the other to the few cells that lie
within the radius; a pair is therefore found exactly once, in the home cell of its smaller id. The join is
keyed by cell, so a crowded cell is split by the adaptive skew join; its pairs are the wanted result.

Defined cases: null, NaN or infinite coordinates, latitudes beyond 90 and the place (0, 0) are no places; points at the
very same place are near each other; a point is not near itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH = 6371008.8


def has_place(lon: Column, lat: Column) -> Column:
    finite = ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) < float("inf")) & (F.abs(lat) <= 90)
    return F.coalesce(finite & ~((lon == 0) & (lat == 0)), F.lit(False))


def with_positions(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points that have a place, with earth-centred metres ex, ey, ez."""
    lo, la = F.radians(lon), F.radians(lat)
    kept = [c for c in points.columns if c.lower() not in ("ex", "ey", "ez")]
    return points.where(has_place(F.col(lon), F.col(lat))).select(
        *kept, (F.lit(EARTH) * F.cos(la) * F.cos(lo)).alias("ex"), (F.lit(EARTH) * F.cos(la) * F.sin(lo)).alias("ey"), (F.lit(EARTH) * F.sin(la)).alias("ez")
    )


def near_pairs(points: DataFrame, id_column: str, radius: float, within: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """(id_a, id_b, metres) of all pairs at most `radius` metres apart; id_a < id_b.

    points: id and ex, ey, ez, and the columns in `within`, which must be equal in a pair. cell: side of a grid cell
    in metres; four radii keep the copies under two a point and the cells small.
    """
    within = within or []
    side = cell or 4 * radius
    floor = lambda c: F.floor(c / side).cast("int")
    own = points.select(F.col(id_column).alias("id_a"), *(F.col(w).alias(f"w{k}") for k, w in enumerate(within)), "ex", "ey", "ez")
    home = own.select("*", floor(F.col("ex")).alias("cx"), floor(F.col("ey")).alias("cy"), floor(F.col("ez")).alias("cz"))
    halo = points.select(F.col(id_column).alias("id_b"), *(F.col(w).alias(f"w{k}") for k, w in enumerate(within)), *(F.col(f"e{a}").alias(f"f{a}") for a in "xyz"))
    for a in "xyz":
        e = F.col(f"f{a}")
        halo = halo.withColumn(f"c{a}", F.explode(F.sequence(floor(e - radius), floor(e + radius))))
    apart = (F.col("ex") - F.col("fx")) ** 2 + (F.col("ey") - F.col("fy")) ** 2 + (F.col("ez") - F.col("fz")) ** 2
    keys = [f"w{k}" for k in range(len(within))] + ["cx", "cy", "cz"]
    pairs = home.join(halo, keys).where((F.col("id_a") < F.col("id_b")) & (apart <= radius * radius))
    return pairs.select("id_a", "id_b", F.sqrt(apart).alias("metres"))
