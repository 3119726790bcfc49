"""Amplitude calibration and the choice of stable points by amplitude dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calibration(samples: DataFrame, image: str = "image_ix", amplitude: str = "amp", floor: float = 0.001) -> DataFrame:
    """(image, calibration): mean amplitude of each image over samples above the floor; 0 where there is none."""
    return samples.groupBy(image).agg(F.coalesce(F.avg(F.when(F.col(amplitude) > floor, F.col(amplitude))), F.lit(0.0)).alias("calibration"))


def calibrated(samples: DataFrame, constants: DataFrame, image: str = "image_ix", amplitude: str = "amp") -> DataFrame:
    """samples with the amplitude divided by the image's constant (constants are a row per image)."""
    return samples.join(constants, image).withColumn(amplitude, F.when(F.col("calibration") != 0, F.col(amplitude) / F.col("calibration")).otherwise(F.lit(float("inf"))))


def dispersion(samples: DataFrame, point: list[str], amplitude: str = "amp", threshold: float = 0.4, least: float = 5e-5) -> DataFrame:
    """Candidates: point, dispersion. The squared dispersion is n * sum(a^2) / sum(a)^2 - 1.

    Amplitudes at or below `least` are zeroed, and a point with a zeroed sample is no candidate. A negative threshold
    keeps points at or above its size instead. One aggregation with map-side sums, whatever the number of images.
    """
    a = F.when(F.col(amplitude) > least, F.col(amplitude)).otherwise(0.0)
    sums = samples.withColumn("_a", a).groupBy(*point).agg(
        F.count("*").alias("n"), F.sum("_a").alias("s1"), F.sum(F.col("_a") * F.col("_a")).alias("s2"), F.min("_a").alias("least")
    )
    squared = F.when(F.col("s1") > 0, F.col("n") * F.col("s2") / (F.col("s1") * F.col("s1")) - 1)
    wanted = F.col("squared") < threshold**2 if threshold >= 0 else F.col("squared") >= threshold**2
    return sums.withColumn("squared", squared).where((F.col("least") > 0) & wanted & ~F.isnan("squared")).select(
        *point, F.sqrt(F.greatest("squared", F.lit(0.0))).alias("dispersion"), F.col("s1").alias("sum_amp")
    )


def dispersion_of_pairs(samples: DataFrame, pairs: DataFrame, point: list[str], amplitude: str = "amp", threshold: float = 0.6) -> DataFrame:
    """Candidates of a pair network: sqrt(mean over pairs of (a1 - a2)^2) over the mean amplitude of all pair entries.

    samples: point, image_ix, amplitude; pairs: img1, img2 (a small table). Two joins on (point, image) follow one scan.
    """
    one = samples.select(*point, F.col("image_ix").alias("img1"), F.col(amplitude).alias("a1"))
    two = samples.select(*point, F.col("image_ix").alias("img2"), F.col(amplitude).alias("a2"))
    both = one.join(pairs, "img1").join(two, [*point, "img2"])
    d = F.sqrt(F.avg((F.col("a1") - F.col("a2")) ** 2)) / (F.sum(F.col("a1") + F.col("a2")) / (2 * F.count("*")))
    return both.groupBy(*point).agg(F.count("*").alias("n_pairs"), d.alias("dispersion")).where(F.col("dispersion") < threshold)
