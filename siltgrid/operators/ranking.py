"""Exact ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltgrid.session import stored


def distributed_rank(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with a 0-based rank of each row within its group, in `order`.

    Rows are range-partitioned by (group, order), so even one group that holds all rows is spread over all tasks; each
    partition's rank starts where the groups's earlier partitions end. `order` should name a unique column last;
    ties would otherwise be ranked arbitrarily, though still without gaps. With group=[] it numbers all rows.
    """
    keys = [F.col(c) for c in group]
    split = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "rank")
    counts = split.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    on = F.col("o._part") == F.col("s._part")
    for c in group:
        on &= F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    within = Window.partitionBy("s._part", *(F.col(f"s.{c}") for c in group)).orderBy(*order)
    joined = split.alias("s").join(offsets.alias("o"), on, "inner")
    return joined.select(*(F.col(f"s.{c}") for c in df.columns), (F.col("o._before") + F.row_number().over(within) - 1).alias(name))
