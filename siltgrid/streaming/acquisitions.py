"""Acquisitions that arrive over time: velocities kept up to date from running sums.

A stack is processed as a whole; this is an extension for readings that keep coming. Each micro-batch adds its
normal-equation sums per point to a table of sums, so old readings are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUMS = ("n", "st", "sp", "stt", "stp")


def sums(readings: DataFrame, day0: float) -> DataFrame:
    """Sums of one batch by point; days are counted from day0."""
    t, p = F.col("day") - day0, F.col("ph")
    return readings.where("ph is not null and not isnan(ph) and day is not null").groupBy("ps_id").agg(
        F.count("*").cast("double").alias("n"), F.sum(t).alias("st"), F.sum(p).alias("sp"), F.sum(t * t).alias("stt"), F.sum(t * p).alias("stp")
    )


def slopes(table: DataFrame) -> DataFrame:
    """(ps_id, slope radians a day, n) from all batches' sums."""
    s = table.groupBy("ps_id").agg(*(F.sum(c).alias(c) for c in SUMS))
    det = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    return s.select("ps_id", F.when(det > 1e-9, (F.col("n") * F.col("stp") - F.col("st") * F.col("sp")) / det).alias("slope"), F.col("n").cast("long").alias("n"))


def follow(stream: DataFrame, folder: str, day0: float, checkpoint: str | None = None) -> StreamingQuery:
    """Append the sums of each micro-batch of a stream (ps_id, day, ph) to Parquet under folder.

    A batch writes to a folder of its own number and overwrites it when it is run again, so each reading counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums(batch, day0).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{folder.rstrip('/')}/_progress")
    return q.trigger(availableNow=True).start()
