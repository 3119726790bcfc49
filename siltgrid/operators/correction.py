"""Correlated error: look-angle phase, ramps, low-passes in time and space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.series import groups_of, numbers, whole_groups
from siltgrid.operators.spikes import like_lengths
from siltgrid.session import spread


def look_angle_error(series: DataFrame, point: str, order: str, phase: str, baseline: str, day: str) -> DataFrame:
    """(point, k, n): slope on the baseline of successive phase differences, with an offset and a drift in the days between.

    One window per point for the differences and one aggregation of normal-equation sums, solved in closed form.
    """
    w = Window.partitionBy(point).orderBy(order)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    d = series.select(point, step(phase).alias("p"), step(baseline).alias("b"), step(day).cast("double").alias("t")).where("p is not null")
    s = lambda e: F.sum(F.expr(e))
    m = d.groupBy(point).agg(
        F.count("*").cast("double").alias("n"), s("b").alias("sb"), s("t").alias("st"), s("b*b").alias("sbb"), s("b*t").alias("sbt"), s("t*t").alias("stt"),
        s("p").alias("sp"), s("p*b").alias("spb"), s("p*t").alias("spt"),
    )
    det = "(n*(sbb*stt-sbt*sbt) - sb*(sb*stt-sbt*st) + st*(sb*sbt-sbb*st))"
    num = "(n*(spb*stt-sbt*spt) - sp*(sb*stt-sbt*st) + st*(sb*spt-spb*st))"
    return m.where("n >= 4").select(point, F.expr(f"CASE WHEN abs({det}) > 1e-9 THEN {num} / {det} END").alias("k"), F.col("n").cast("long").alias("n"))


def ramps(samples: DataFrame, keys: list[str], phase: str, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, r0, rx, ry): plane fitted to the phases of each image; a row per image from one aggregation.

    Coordinates are kilometres about nothing in particular: the plane is fitted with centred sums, so their offset is harmless.
    """
    a = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(phase).alias("mp"),
        F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, phase).alias("cxp"), F.covar_pop(y, phase).alias("cyp"),
    )
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    rx = F.when(det > 1e-12, (F.col("cxp") * F.col("vy") - F.col("cyp") * F.col("cxy")) / det).otherwise(0.0)
    ry = F.when(det > 1e-12, (F.col("cyp") * F.col("vx") - F.col("cxp") * F.col("cxy")) / det).otherwise(0.0)
    fitted = a.where("n > 5").withColumn("rx", rx).withColumn("ry", ry)
    return fitted.select(*keys, (F.col("mp") - F.col("rx") * F.col("mx") - F.col("ry") * F.col("my")).alias("r0"), "rx", "ry")


def deramped(samples: DataFrame, keys: list[str], phase: str, x: str = "x", y: str = "y") -> DataFrame:
    """samples less the plane of their image; images with too few points keep their phase."""
    r = ramps(samples, keys, phase, x, y)
    plane = F.coalesce(F.col("r0") + F.col("rx") * F.col(x) + F.col("ry") * F.col(y), F.lit(0.0))
    return samples.join(r, keys, "left").withColumn(phase, F.col(phase) - plane).drop("r0", "rx", "ry")


def polynomial_terms(x: np.ndarray, y: np.ndarray, degree: float) -> np.ndarray:
    """Design of a ramp of degree 1, 1.5 (with xy), 2 or 3; x and y in kilometres."""
    one = np.ones_like(x)
    terms = [one, x, y]
    if degree >= 1.5:
        terms.append(x * y)
    if degree >= 2:
        terms += [x * x, y * y]
    if degree >= 3:
        terms += [x**3, y**3, x * x * y, x * y * y]
    return np.stack(terms, 1)


def polynomial_ramps(samples: DataFrame, keys: list[str], phase: str, degree: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, coefficients): ramps of any degree from normal-equation sums gathered per batch and added in Spark.

    Each batch of rows gives one small matrix per image; the sums meet under (keys), and a last step solves a row per image.
    """
    n = {1.0: 3, 1.5: 4, 2.0: 6, 3.0: 10}[degree]
    types = [samples.schema[k] for k in keys]
    sums = T.StructType([*types, T.StructField("cell", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def gather(batches):
        for batch in batches:
            f = batch.to_pandas()
            if not len(f):
                continue
            for key, g in f.groupby(keys, dropna=False):
                ok = np.isfinite(g[phase].to_numpy(float))
                a = polynomial_terms(g[x].to_numpy(float)[ok] / 1000, g[y].to_numpy(float)[ok] / 1000, degree)
                flat = np.concatenate([(a.T @ a).ravel(), a.T @ g[phase].to_numpy(float)[ok], [ok.sum()]])
                m = len(flat)
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * m, pa.int64()).cast(batch.schema.field(k).type) for v, k in zip(key, keys)), pa.array(np.arange(m, dtype=np.int32)), pa.array(flat)], names=sums.names)

    total = samples.select(*keys, phase, x, y).mapInArrow(gather, sums).groupBy(*keys, "cell").agg(F.sum("v").alias("v"))
    packed = total.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda s: s.v).alias("v"))

    @F.pandas_udf("array<double>")
    def solve(rows):
        def one(v):
            v = np.asarray(v, float)
            if v[-1] <= n + 2:
                return None
            a = v[: n * n].reshape(n, n)
            scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))  # terms of like size, so that none is lost to rounding
            return (scale * np.linalg.lstsq(a * np.outer(scale, scale), v[n * n : n * n + n] * scale, rcond=None)[0]).tolist()

        return rows.map(one)

    return packed.select(*keys, solve("v").alias("coefficients"))


def temporal_low_pass(series: DataFrame, point: str, day: str, phase: str, width_days: float, is_reference: str) -> DataFrame:
    """series with `low`: Gaussian mean over time of each point, its reference image left out of the weights.

    Rows come sorted by point in a stream; points with about as many images are weighed together in NumPy, so nothing is joined or exploded.
    """
    schema = T.StructType([*series.schema.fields, T.StructField("low", T.DoubleType())])
    names = series.columns

    def run(batches):
        for chunk in whole_groups(batches, names.index(point)):
            ids = numbers(chunk[point], np.int64, 0)
            start, _, _ = groups_of(ids)
            d, p = numbers(chunk[day], np.float64, np.nan), numbers(chunk[phase], np.float64, np.nan)
            ref = numbers(chunk[is_reference], np.bool_, False)
            low = np.full(len(ids), np.nan)
            sizes = np.diff(np.r_[start, len(ids)])
            for of in like_lengths(sizes):
                width = int(sizes[of].max())
                step = max(1, 4_000_000 // (width * width))
                for part in (of[k : k + step] for k in range(0, len(of), step)):
                    row = np.repeat(np.arange(len(part)), sizes[part])
                    place = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, sizes[part][:-1]]), sizes[part])
                    at = start[part][row] + place
                    t, y, counts = (np.full((len(part), width), fill) for fill in (np.nan, 0.0, 0.0))
                    t[row, place], y[row, place], counts[row, place] = d[at], np.nan_to_num(p[at]), ~ref[at] & ~np.isnan(p[at])
                    w = np.nan_to_num(np.exp(-((t[:, :, None] - t[:, None, :]) ** 2) / (2 * width_days * width_days))) * counts[:, None, :]
                    total = w.sum(2)
                    mean = np.divide(np.einsum("gij,gj->gi", w, y), total, out=np.full(total.shape, np.nan), where=total > 0)
                    low[at] = mean[row, place]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in chunk.columns), pa.array(low, from_pandas=True)], names=schema.names)

    return spread(series, point).sortWithinPartitions(point, day).mapInArrow(run, schema)


def spatial_low_pass(points: DataFrame, id_column: str, values: str, scale: float, within: list[str] | None = None) -> DataFrame:
    """(id, low): Gaussian mean of an array of values over each point and those within four scales of it.

    points: id, ex, ey, ez, values, and the columns in `within`, which must be equal. Points of a cell and those around it meet in one task, each
    shipped once to its own cell and to the few whose halo holds it; no pair is written. A cell holds what the ground does: a point for each pixel.
    """
    within = within or []
    radius, side = 4 * scale, 8 * scale
    rows = points.select(*(F.col(w).alias(f"w{k}") for k, w in enumerate(within)), F.col(id_column).alias("id"), "ex", "ey", "ez", F.col(values).alias("v"))
    halo = rows
    for a in "xyz":
        e = F.col(f"e{a}")
        halo = halo.withColumn(f"c{a}", F.explode(F.sequence(F.floor((e - radius) / side).cast("int"), F.floor((e + radius) / side).cast("int"))))
    home = F.lit(True)
    for a in "xyz":
        home &= F.col(f"c{a}") == F.floor(F.col(f"e{a}") / side).cast("int")
    keys = [*(f"w{k}" for k in range(len(within))), "cx", "cy", "cz"]
    schema = T.StructType([T.StructField("id", points.schema[id_column].dataType), T.StructField("low", T.ArrayType(T.DoubleType()))])

    def one(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(table.column("home").to_numpy())
        e = np.stack([table.column(f"e{a}").to_numpy() for a in "xyz"], 1)
        flat = table.column("v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(e), -1)
        low = np.empty((len(own), v.shape[1]))
        step = max(1, 2_000_000 // max(1, len(e)))
        for k in range(0, len(own), step):
            d2 = ((e[own[k : k + step], None, :] - e[None, :, :]) ** 2).sum(2)
            w = np.where(d2 <= radius * radius, np.exp(-d2 / (2 * scale * scale)), 0)
            low[k : k + step] = w @ v / w.sum(1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, max(1, v.shape[1]), dtype=np.int32)), pa.array(low.ravel()))
        return pa.table({"id": table.column("id").take(pa.array(own)), "low": lists})

    return spread(halo.withColumn("home", home), *keys).groupBy(*keys).applyInArrow(one, schema)


def less_delay(samples: DataFrame, delays: DataFrame, keys: list[str], phase: str, delay: str = "delay") -> DataFrame:
    """samples less a delay phase where one is known for their keys; the others stay as they are."""
    known = delays.select(*keys, F.col(delay).alias("_delay"))
    return samples.join(known, keys, "left").withColumn(phase, F.col(phase) - F.coalesce(F.nanvl("_delay", F.lit(0.0)), F.lit(0.0))).drop("_delay")


def from_coarse_grid(points: DataFrame, grid: DataFrame, id_column: str, row: str, column: str, step_row: float, step_column: float, value: str) -> DataFrame:
    """(id, value) interpolated between the four nodes of a coarse grid (gi, gj, value) around each point.

    Each point asks for its four corners by equi-join on the node; corners the grid lacks leave the others their share.
    """
    r, c = F.col(row) / step_row, F.col(column) / step_column
    fr, fc = r - F.floor(r), c - F.floor(c)
    corners = [(a, b, (fr if a else 1 - fr) * (fc if b else 1 - fc)) for a in (0, 1) for b in (0, 1)]
    asked = F.explode(F.array(*(F.struct((F.floor(r) + a).cast("int").alias("gi"), (F.floor(c) + b).cast("int").alias("gj"), w.alias("w")) for a, b, w in corners)))
    rows = points.select(F.col(id_column).alias("id"), asked.alias("_k")).select("id", "_k.*").where("w > 0")
    met = rows.join(grid.select("gi", "gj", F.col(value).alias("_v")), ["gi", "gj"])
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
