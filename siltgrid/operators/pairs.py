"""The pair graph of a small-baseline network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_axis(dates: DataFrame, date: str) -> DataFrame:
    """(image_ix, date): distinct dates numbered from 0. The axis has a row per image, so one window task is enough."""
    from pyspark.sql import Window

    return dates.select(date).where(F.col(date).isNotNull()).distinct().withColumn("image_ix", F.row_number().over(Window.orderBy(date)) - 1)


def consecutive_pairs(axis: DataFrame, neighbours: int = 3) -> DataFrame:
    """(ifg_ix, img1, img2): each image with its next `neighbours` images, written as an explode and not as a range join."""
    last = axis.agg(F.max("image_ix").alias("last"))
    later = axis.crossJoin(F.broadcast(last)).select(
        F.col("image_ix").alias("img1"), F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("gap"), "last"
    )
    pairs = later.withColumn("img2", F.col("img1") + F.col("gap")).where("img2 <= last")
    from pyspark.sql import Window

    return pairs.select((F.row_number().over(Window.orderBy("img1", "img2")) - 1).alias("ifg_ix"), "img1", "img2")


def pair_baselines(pairs: DataFrame, axis: DataFrame, baseline: str = "bperp") -> DataFrame:
    """pairs with the difference of their images' baselines."""
    side = lambda k: axis.select(F.col("image_ix").alias(f"img{k}"), F.col(baseline).alias(f"_b{k}"))
    return pairs.join(side(1), "img1").join(side(2), "img2").select(*pairs.columns, (F.col("_b2") - F.col("_b1")).alias(baseline))


def unknown_dates(wanted: DataFrame, axis: DataFrame, date: str) -> DataFrame:
    """Dates of a pair list that no image has; a valid list leaves none."""
    return wanted.select(date).distinct().join(axis.select(date), date, "left_anti")
