"""Comparison of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summaries(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, mean, deviation, least, most, n) of finite values, in one pass over the table."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in fields))).alias("r")).select("r.*")
    ok = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return ok.groupBy("field").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str, is_phase: bool = False) -> DataFrame:
    """One row: rows on either side and on both, and mean, largest and root mean square difference; phases are compared on the circle."""
    a = left.select(*keys, F.col(value).cast("double").alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(value).cast("double").alias("_b"), F.lit(1).alias("_r"))
    d = F.col("_a") - F.col("_b")
    d = F.abs(F.atan2(F.sin(d), F.cos(d))) if is_phase else F.abs(d)
    j = a.join(b, keys, "full").withColumn("_d", F.when(~F.isnan(d), d))
    return j.agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.sum(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1).otherwise(0)).alias("n_both"),
        F.avg("_d").alias("mean_abs"), F.max("_d").alias("max_abs"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"),
    )


def shared_fields(left: DataFrame, right: DataFrame, aliases: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Columns both tables have, by name or alias."""
    aliases = aliases or {}
    return [(c, aliases.get(c, c)) for c in left.columns if aliases.get(c, c) in right.columns]


def sampled(df: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """At most `most` rows at equal strides of the hashed key: the same rows of any table with these keys, whatever its order."""
    n = df.count()
    stride = -(-n // most)
    return df if stride <= 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(stride)) == 0)


def report(left: DataFrame, right: DataFrame, keys: list[str], aliases: dict[str, str] | None = None, phases: tuple[str, ...] = (), most: int | None = None) -> list[dict]:
    """A dict per field that both tables hold, by name or alias: rows on each side, differences, and whether it is compared as a phase.

    Arrays are compared element by element as far as both reach, and their sizes are told. most: compare a strided sample of about that many rows.
    """
    if most:
        left, right = sampled(left, keys, most), sampled(right, keys, most)
    out = []
    for a, b in shared_fields(left, right, aliases):
        if a in keys:
            continue
        is_array = left.schema[a].dataType.typeName() == "array"
        x, y = left.select(*keys, F.col(a).alias("v")), right.select(*keys, F.col(b).alias("v"))
        over = keys
        entry = {"field": a, "other": b, "is_phase": a in phases}
        if is_array:
            sizes = [r[0] for r in (df.agg(F.max(F.size("v"))).first() for df in (x, y))]
            entry["sizes"] = sizes
            x, y = (df.select(*keys, F.posexplode(F.slice("v", 1, min(s or 0 for s in sizes))).alias("at", "v")) for df in (x, y))
            over = [*keys, "at"]
        elif left.schema[a].dataType.typeName() not in ("double", "float", "integer", "long", "short", "byte", "boolean"):
            differs = x.join(y.withColumnRenamed("v", "w"), keys).where(~F.col("v").eqNullSafe(F.col("w"))).count()
            out.append({**entry, "n_left": x.count(), "n_right": y.count(), "n_differs": differs})
            continue
        out.append({**entry, **difference(x.withColumn("v", F.col("v").cast("double")), y.withColumn("v", F.col("v").cast("double")), over, "v", a in phases).first().asDict()})
    return out
