"""Spatial partitions with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patch_bounds(width: int, length: int, n_range: int, n_azimuth: int, overlap: int) -> list[tuple[int, ...]]:
    """(patch, rg1, rg2, az1, az2, and the same without overlap), 1-based and inclusive, numbered range-major.

    Sizes are floor divisions, the last patch takes the remainder, overlaps are clamped to the raster.
    """
    out = []
    step_r, step_a = width // n_range, length // n_azimuth
    for i in range(n_range):
        r1, r2 = i * step_r + 1, (i + 1) * step_r if i < n_range - 1 else width
        for j in range(n_azimuth):
            a1, a2 = j * step_a + 1, (j + 1) * step_a if j < n_azimuth - 1 else length
            out.append((len(out) + 1, max(1, r1 - overlap), min(width, r2 + overlap), max(1, a1 - overlap), min(length, a2 + overlap), r1, r2, a1, a2))
    return out


COLUMNS = "patch int, rg1 int, rg2 int, az1 int, az2 int, in_rg1 int, in_rg2 int, in_az1 int, in_az2 int"


def assign(points: DataFrame, bounds: list[tuple[int, ...]], az: str = "az", rg: str = "rg") -> DataFrame:
    """points in every patch whose bounds hold them, with is_inner for the patch without its overlap.

    The patch list is a constant of the job (patches, not points), so it is written into the plan as one literal array and
    each point is matched where it lies: no shuffle and no join.
    """
    fields = [c.split()[0] for c in COLUMNS.split(", ")]
    table = F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, b))) for b in bounds))
    inside = lambda p, pre: F.col(az).between(p[f"{pre}az1"], p[f"{pre}az2"]) & F.col(rg).between(p[f"{pre}rg1"], p[f"{pre}rg2"])
    held = points.withColumn("_p", F.explode(F.filter(table, lambda p: inside(p, ""))))
    return held.select(*points.columns, F.col("_p.patch").alias("patch"), inside(F.col("_p"), "in_").alias("is_inner"))
