"""Patches merged into one table of points, whole or resampled to cells.

Defined cases: of a pixel that several patches hold, one row wins whole, with every estimate of its patch, however the others differ;
null and NaN scores count lowest, ties go to the smallest id; patches without an inner point are left out when keep_margin is
false; in resampling null and NaN values take no part, a coherence of null is 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltgrid.operators.phasegrid import cell
from siltgrid.operators.weeding import best_of

#: Phase accuracy in degrees, and seed and size of the sample that bounds a merged coherence.
ACCURACY, NOISE_SEED, NOISE_SIZE = 10.0, 1001, 1000


def attainable_coherence(accuracy: float = ACCURACY) -> float:
    """Coherence of a large sample of noise at the phase accuracy: what a point can reach at most."""
    noise = np.random.RandomState(NOISE_SEED).randn(NOISE_SIZE) * math.radians(accuracy)
    return float(np.abs(np.exp(1j * noise).sum()) / NOISE_SIZE)


def merge_points(points: DataFrame, group: list[str], score: str, id_column: str, keep_margin: bool = True) -> DataFrame:
    """One row per pixel: a patch that holds it outside its overlap goes first, then the lowest patch, then the higher score, then
    the smallest id; its row is taken whole. Then one row per place, the most coherent. keep_margin=False drops pixels that only
    overlaps hold.

    Both steps are aggregations with map-side combine; nothing is collected per patch.
    """
    rows = points if keep_margin else points.where("is_inner")
    s = F.coalesce(F.when(~F.isnan(score), F.col(score).cast("double")), F.lit(float("-inf")))
    order = F.struct(F.when(F.col("is_inner"), 0).otherwise(1), "patch", -s, F.col(id_column))
    pixel = [*group, "az", "rg"]
    won = rows.groupBy(*pixel).agg(F.min_by(F.struct(*(c for c in points.columns if c not in pixel)), order).alias("_w"))
    return best_of(won.select(*pixel, "_w.*").select(*points.columns), [*group, "lon", "lat"], score, id_column)


def point_noise(residual: Column, c: Column, with_c: bool) -> tuple[Column, Column]:
    """(variance, coherence) of a point's residual phases about its offset c; with_c counts c itself as one more image."""
    z = F.transform(residual, lambda r: F.atan2(F.sin(r - c), F.cos(r - c)))
    z = F.concat(z, F.array(c)) if with_c else z
    total = lambda f: F.aggregate(z, F.lit(0.0), lambda a, v: a + f(v))
    n = F.size(z)
    mean = total(lambda v: v) / n
    variance = F.when(n > 1, F.aggregate(z, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (n - 1))
    return variance, F.sqrt(total(F.cos) ** 2 + total(F.sin) ** 2) / F.size(residual)


def resample(
    points: DataFrame,
    group: list[str],
    size: float,
    coherence: str,
    values: list[str],
    least_deviation: float = float("inf"),
    residual: str | None = None,
    offset: str | None = None,
    small_baseline: bool = False,
    sums: tuple[str, ...] = (),
    arrays: tuple[str, ...] = (),
    rounded: tuple[str, ...] = (),
    n_images: int = 0,
) -> DataFrame:
    """One row per cell of `size` metres within each group: weighted means, n, weight, and merged coherence.

    Weights are 1 / variance of a point's residuals about its offset, never more than those of the phase accuracy, and that where no residuals are
    known. snr = 1 / (1 / coh^2 - 1) of each point is summed and gives the cell's coherence sqrt(1 / (1 + 1 / sqrt(sum snr^2))); coh is that of
    the residuals, else the stored one, and never more than noise of the phase accuracy reaches. Cells whose weights sum to less than 1 /
    least_deviation^2 fall away. values: means by weight; rounded: the same, to whole numbers, halves to even; arrays: means of
    arrays by weight; sums: arrays of phases, summed as unit vectors by snr over n_images images, as <name>_re and <name>_im.
    """
    floor = math.radians(ACCURACY) ** 2
    coh = F.coalesce(F.nanvl(F.col(coherence).cast("double"), F.lit(0.0)), F.lit(0.0))
    w: Column = F.lit(1 / floor)
    if residual and offset:
        variance, found = point_noise(F.col(residual), F.col(offset), not small_baseline)
        w = 1 / F.greatest(F.coalesce(F.nanvl(variance, F.lit(floor)), F.lit(floor)), F.lit(floor))
        coh = F.coalesce(found, coh)
    coh = F.greatest(F.lit(0.0), F.least(F.lit(min(attainable_coherence(), 1 - 1e-6)), coh))
    snr = F.when(coh > 0, 1 / (1 / (coh * coh) - 1)).otherwise(0.0)
    corner = points.groupBy(*group).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"))
    celled = points.join(corner, group).withColumn("ci", cell(F.col("y"), F.col("_y0"), size, 1e-9)).withColumn("cj", cell(F.col("x"), F.col("_x0"), size, 1e-9))
    celled = celled.withColumn("_weight", w).withColumn("_snr", snr)
    mean = lambda v: F.sum(F.col("_weight") * v) / F.sum(F.when(v.isNotNull(), F.col("_weight")))
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = lambda f: F.array(*(f(k) for k in range(n_images)))
    out = celled.groupBy(*group, "ci", "cj").agg(
        F.count("*").alias("n"), F.sum("_weight").alias("weight"), F.sqrt(F.sum(F.col("_snr") * F.col("_snr"))).alias("_s"),
        *(mean(usable(v)).alias(v) for v in values), *(F.bround(mean(usable(v))).cast("int").alias(v) for v in rounded),
        *(each(lambda k: mean(F.col(a)[k])).alias(a) for a in arrays),  # noqa: B023
        *(each(lambda k: F.sum(F.col("_snr") * f(F.col(a)[k]))).alias(f"{a}_{part}") for a in sums for f, part in ((F.cos, "re"), (F.sin, "im"))),  # noqa: B023
    )
    merged = F.when(F.col("_s") > 0, F.sqrt(1 / (1 + 1 / F.col("_s")))).otherwise(0.0)
    least = 0.0 if math.isinf(least_deviation) else 1 / least_deviation**2
    return out.where(F.col("weight") >= least).withColumn("coh", merged).drop("_s")
