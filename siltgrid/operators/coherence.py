"""Coherence histograms, survival ratios, order-statistic bins and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 100


def coherence_bin(coh: Column) -> Column:
    """Bin 0..99 of width 0.01 on 0..1, the last closed on the right; null for anything else."""
    return F.when((coh >= 0) & (coh <= 1) & ~F.isnan(coh), F.least(F.floor(coh * BINS), F.lit(BINS - 1)).cast("int"))


def histogram(points: DataFrame, keys: list[str], coh: str) -> DataFrame:
    return points.withColumn("bin", coherence_bin(F.col(coh))).where("bin is not null").groupBy(*keys, "bin").count().withColumnRenamed("count", "n")


def survival(hist: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """hist with `above`: the count in this bin and all higher ones. At most 100 rows a key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("above", F.sum(n).over(w))


def dispersion_edges(points: DataFrame, group: list[str], value: str) -> DataFrame:
    """Bin edges of a value: every 10,000th (50,000 rows and more) or 2,000th (10,000 and more) in order, with 0 and the
    largest at the ends; fewer rows are one bin from 0 to 1. Ranks are distributed, so one group may hold all rows."""
    from siltgrid.operators.ranking import distributed_rank

    clean = points.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, value)
    total = clean.groupBy(*group).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    ranked = distributed_rank(clean, group, [F.col(value)])
    joined = ranked.join(total, group).where("n >= 10000").withColumn("step", F.when(F.col("n") >= 50000, 10000).otherwise(2000))
    inner = joined.where("(rank + 1) % step = 0 and rank + 1 <= n - step").select(*group, F.col(value).cast("double").alias("edge"))
    ends = total.select(*group, F.explode(F.when(F.col("n") >= 10000, F.array(F.lit(0.0), F.col("most").cast("double"))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).alias("edge"))
    return inner.unionByName(ends)


def coherence(re: Column, im: Column, size: Column) -> Column:
    """|sum z| / sum |z| from its sums."""
    return F.when(size > 0, F.sqrt(re * re + im * im) / size)
