"""The chain from candidate points to displacement: gamma, selection, weeding, correction, merging, unwrapping, look-angle error, noise, export.

Every step takes and gives DataFrames; points carry their phases as an array over the phase axis: the images of the stack where all share one
reference, or the pairs of a network. Pairs are inverted to image series after unwrapping; from there on both are alike.
Driver decisions are limited to what is global and small: histograms of a hundred bins, thresholds, convergence,
matrices over the images. Stage results are written once to the shared folder, or under their names to a folder of the caller's from
which a later run goes on; so no lineage grows and a lost executor costs its tasks only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.functions import kernels
from siltgrid.functions.cplx import dot, wrap
from siltgrid.operators import coherence, correction, merging, mesh, network, phasegrid, topofit, unwrapping, weeding
from siltgrid.params import Params, deramp_list, image_list
from siltgrid.session import spread, stored

ARRAY = T.ArrayType(T.DoubleType())
#: Distance to the scene in metres, incidence where nothing is known of it, and what it exceeds the look angle by.
RANGE, INCIDENCE, BEYOND_LOOK = 830000.0, 21 * np.pi / 180, 0.052


@dataclass
class Images:
    """The image axis: day numbers, baselines, the reference's place, wavelength in metres; pairs (first, second image) of a network."""

    day: list[float]
    bperp: list[float]
    reference: int
    wavelength: float = 0.056
    mean_incidence: float = 0.40
    pairs: list[tuple[int, int]] = field(default_factory=list)
    max_topo_err: float = 20.0

    @property
    def phase_bperp(self) -> list[float]:
        """Baseline of each phase: of the image, or the pair's second image less its first."""
        return [self.bperp[j] - self.bperp[i] for i, j in self.pairs] if self.pairs else list(self.bperp)

    @property
    def wraps(self) -> float:
        """Turns of phase over the range of baselines at the largest height error."""
        top = self.max_topo_err / (self.wavelength * RANGE * np.sin(self.mean_incidence) / (4 * np.pi))
        return float(np.ptp(self.phase_bperp) * top / (2 * np.pi))


def mean_incidence(points: DataFrame) -> float:
    """Mean incidence of points that have one, else their mean look angle and three degrees, else 21 degrees."""
    there = lambda c, ok: F.avg(F.when(ok & ~F.isnan(c), F.col(c).cast("double"))) if c in points.columns else F.lit(None).cast("double")
    inc, la = points.agg(there("inc", F.col("inc") != 0) if "inc" in points.columns else F.lit(None), there("la", F.col("la").isNotNull()) if "la" in points.columns else F.lit(None)).first()
    return float(inc) if inc is not None else float(la) + BEYOND_LOOK if la is not None else INCIDENCE


def _series(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1] if values.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width or 1, dtype=np.int32)), pa.array(values.ravel().astype(float)))


def grid_sums(points: DataFrame, bperp: list[float], patch: str = "patch") -> DataFrame:
    """(patch, img, gi, gj, re, im): weighted phases less each point's look-angle phase, summed in cells."""
    b = F.array(*map(F.lit, bperp))
    rows = points.select(patch, "gi", "gj", "k", "w", F.posexplode("ph").alias("img", "p"), b.alias("b"))
    z = rows.select(patch, "img", "gi", "gj", "w", (F.col("p") - F.coalesce(F.nanvl("k", F.lit(0.0)), F.lit(0.0)) * F.col("b")[F.col("img")]).alias("q"))
    return phasegrid.accumulate(z.where("q is not null and not isnan(q)"), [patch, "img", "gi", "gj"], "q", "w")


def filtered_cells(sums: DataFrame, params: Params, patch: str = "patch") -> DataFrame:
    """(patch, gi, gj, f array over images): each image's grid of a patch through the adaptive filter, phases by cell."""
    cell, window = params.get("filter_grid_size"), int(params.get("clap_win"))
    low, alpha, beta = params.get("clap_low_pass_wavelength"), params.get("clap_alpha"), params.get("clap_beta")
    schema = T.StructType([sums.schema[patch], *(T.StructField(c, T.IntegerType()) for c in ("img", "gi", "gj")), T.StructField("f", T.DoubleType())])

    def one(t: pa.Table) -> pa.Table:
        i, j = (t.column(c).to_numpy() for c in ("gi", "gj"))
        grid = np.zeros((i.max() + 1, j.max() + 1), complex)
        grid[i, j] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        out = kernels.clap(grid, cell, int(window * 0.75), window - int(window * 0.75), low, alpha, beta)
        return pa.table({patch: t.column(patch), "img": t.column("img").cast(pa.int32()), "gi": t.column("gi").cast(pa.int32()), "gj": t.column("gj").cast(pa.int32()), "f": np.angle(out[i, j])})

    found = spread(sums, patch, "img").groupBy(patch, "img").applyInArrow(one, schema)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("img", "f"))), lambda s: s.f)
    return found.groupBy(patch, "gi", "gj").agg(ordered.alias("f"))


def reestimated_cells(sums: DataFrame, wanted: DataFrame, params: Params, patch: str = "patch") -> DataFrame:
    """(patch, gi, gj, f): for each wanted cell the filter of a whole window around it, its own cell zeroed, read at the cell.

    Cells are computed once and joined to their points later, whatever the number of points in them.
    """
    n, cell, low = int(params.get("clap_win")), params.get("filter_grid_size"), params.get("clap_low_pass_wavelength")
    near = int(params.get("slc_osf")) - 1  # oversampled images: the cells around are no more independent of the point
    alpha, beta = params.get("clap_alpha"), params.get("clap_beta")
    marked = sums.join(wanted.select(patch, "gi", "gj").distinct().withColumn("wanted", F.lit(1)), [patch, "gi", "gj"], "left")
    schema = T.StructType([sums.schema[patch], *(T.StructField(c, T.IntegerType()) for c in ("img", "gi", "gj")), T.StructField("f", T.DoubleType())])

    def one(t: pa.Table) -> pa.Table:
        i, j = (t.column(c).to_numpy() for c in ("gi", "gj"))
        grid = np.zeros((max(n, i.max() + 1), max(n, j.max() + 1)), complex)
        grid[i, j] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        at = np.flatnonzero(~np.isnan(t.column("wanted").to_numpy(zero_copy_only=False).astype(float)))
        value = np.zeros(len(at))
        for start in range(0, len(at), 256):
            part = at[start : start + 256]
            a = np.clip(i[part] - n // 2, 0, grid.shape[0] - n)
            b = np.clip(j[part] - n // 2, 0, grid.shape[1] - n)
            windows = np.stack([grid[x : x + n, y : y + n] for x, y in zip(a, b)])
            rows = np.arange(len(part))
            for di in range(-near, near + 1):
                for dj in range(-near, near + 1):
                    windows[rows, (i[part] - a + di).clip(0, n - 1), (j[part] - b + dj).clip(0, n - 1)] = 0
            value[start : start + 256] = np.angle(kernels.clap_windows(windows, cell, low, alpha, beta)[rows, i[part] - a, j[part] - b])
        take = pa.array(at)
        return pa.table({patch: t.column(patch).take(take), **{c: t.column(c).take(take).cast(pa.int32()) for c in ("img", "gi", "gj")}, "f": value})

    found = spread(marked, patch, "img").groupBy(patch, "img").applyInArrow(one, schema)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("img", "f"))), lambda s: s.f)
    return found.groupBy(patch, "gi", "gj").agg(ordered.alias("f"))


def _fit(points: DataFrame, images: Images) -> DataFrame:
    """points (with ph and the patch phase f) and their k, c, coh, residual."""
    schema = T.StructType([*points.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("k2", "c2", "coh2")), T.StructField("residual", ARRAY)])
    b = np.asarray(images.phase_bperp, float)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ph, f = (_series(batch.column(c), n) for c in ("ph", "f"))
            z = np.where(np.isnan(ph) | np.isnan(f), 0, np.exp(1j * np.nan_to_num(ph - f)))
            k, c, coh, _, r = topofit.topofit(z, b, images.wraps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (k, c, coh)), _lists(r)], names=schema.names)

    return points.mapInArrow(run, schema)


def estimate_gamma(points: DataFrame, images: Images, params: Params, patch: str = "patch") -> tuple[DataFrame, np.ndarray]:
    """(points with gi, gj, k, c, coh, f, residual, w; scaled null histogram): the fixpoint of patch phase, fit and weights.

    points: pid, patch, x, y, d_a, ph (array). At most gamma_max_iterations rounds; each writes its table.
    """
    state = phasegrid.with_cells(points, [patch], params.get("filter_grid_size"))
    state = stored(state.select("*", F.lit(0.0).alias("k"), F.lit(0.0).alias("c"), F.lit(0.0).alias("coh"), (1 / F.greatest(F.coalesce("d_a", F.lit(1.0)), F.lit(1e-3))).alias("w")), "gamma")
    null = kernels.random_coherence(np.asarray(images.phase_bperp, float), images.wraps, pairs=images.pairs or None)
    before, keep = None, [*points.columns, "gi", "gj"]
    by_snr = str(params.get("filter_weighting")).upper() == "SNR"
    for _ in range(int(params.get("gamma_max_iterations"))):
        cells = filtered_cells(grid_sums(state, images.phase_bperp, patch), params, patch)
        fitted = _fit(state.drop("f", "residual").join(cells, [patch, "gi", "gj"]).select(*keep, "w", "coh", "f"), images)
        fitted = stored(fitted, "gamma")
        change = fitted.agg(F.sqrt(F.avg((F.col("coh2") - F.col("coh")) ** 2))).first()[0] or 0.0
        counts = np.zeros(100)
        for r in coherence.histogram(fitted, [], "coh2").collect():
            counts[r["bin"]] = r["n"]
        table, scaled = kernels.weights_from_null(counts, null, 15 if images.pairs else 31)
        weight = F.array(*(F.lit(float(x)) for x in table))
        # phases are of unit size: signal over noise is the mean cosine over what it leaves of 1
        g = F.aggregate("residual", F.lit(0.0), lambda a, r: a + F.cos(r)) / F.size("residual")
        snr = F.when(g * g < 1, g / F.sqrt((1 - g * g) / 2)).otherwise(0.0)
        chosen = snr if by_snr else weight[F.least(F.bround(F.col("coh2") * 1000), F.lit(len(table) - 1)).cast("int")]
        state = fitted.select(*keep, F.col("k2").alias("k"), F.col("c2").alias("c"), F.col("coh2").alias("coh"), "f", "residual", chosen.alias("w"))
        if before is not None and abs(change - before) < params.get("gamma_change_convergence"):
            break
        before = change
    return state, scaled


def select_points(state: DataFrame, null: np.ndarray, images: Images, params: Params, patch: str = "patch") -> DataFrame:
    """Points above the coherence threshold of their dispersion bin, re-estimated with their own cell left out.

    Adds k2, c2, coh2 and threshold; keeps coh2 above it and a look-angle error that moved less than a turn over the baselines.
    """
    box = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    edges = sorted({r[0] for r in coherence.dispersion_edges(state.select("d_a").withColumn("all", F.lit(1)), ["all"], "d_a").select("edge").collect()})
    edges[-1] = max(edges[-1], 1.0)
    by_share = str(params.get("select_method")).upper() == "PERCENT"
    area = max(1e-6, (box[1] - box[0]) * (box[3] - box[2]) / 1e6)
    most = params.get("percent_rand") if by_share else params.get("density_rand") * area / max(1, len(edges) - 1)
    place = sum((F.when(F.coalesce("d_a", F.lit(1.0)) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    rows = state.withColumn("bin_d", place)
    hist: dict[int, np.ndarray] = {}
    for r in coherence.histogram(rows, ["bin_d"], "coh").collect():
        hist.setdefault(r["bin_d"], np.zeros(100))[r["bin"]] = r["n"]
    means = {r[0]: r[1] for r in rows.groupBy("bin_d").agg(F.avg(F.coalesce("d_a", F.lit(1.0)))).collect()}
    found = {}
    for k, counts in hist.items():
        low = 15 if images.pairs else 31
        share = null * counts[:low].sum() / max(1e-9, null[:low].sum())
        t = kernels.coherence_threshold(counts, share, most, by_share)
        if t is not None:
            found[k] = t
    if not found:
        slope, base = 0.0, 0.3
    elif len(found) == 1:
        slope, base = 0.0, next(iter(found.values()))
    else:
        slope, base = np.polyfit([means[k] for k in found], list(found.values()), 1)
        if slope <= 0:
            slope, base = 0.0, float(np.polyval([slope, base], 0.35))
    limit = F.lit(float(base)) + F.lit(float(slope)) * F.coalesce("d_a", F.lit(1.0))
    chosen = rows.withColumn("threshold", limit).where("coh > threshold").drop("bin_d", "f")
    if params.get("gamma_stdev_reject") > 0:
        chosen = reject_part_time(chosen, "residual", params.get("gamma_stdev_reject")).drop("coh_std")
    chosen = stored(chosen.drop("residual"), "selected")
    if params.get("select_reest_gamma_flag") != "y":
        return chosen.select("*", F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("coh").alias("coh2"))
    cells = reestimated_cells(grid_sums(state, images.phase_bperp, patch), chosen, params, patch)
    again = _fit(chosen.join(cells, [patch, "gi", "gj"]), images)
    turn = 2 * np.pi / max(1e-9, float(np.ptp(images.phase_bperp)))
    return stored(again.where((F.col("coh2") > F.col("threshold")) & ~F.isnan("k2") & (F.abs(F.col("k") - F.col("k2")) < turn)), "selected")


def bootstrap_matrix(n: int, resamples: int = 100, seed: int = 42) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, n, (resamples, n))


def reject_part_time(points: DataFrame, residual: str, limit: float) -> DataFrame:
    """points whose coherence varies less than `limit` over resampled images; one shared matrix of resamples."""
    fields = [*points.schema.fields, T.StructField("coh_std", T.DoubleType())]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            z = np.exp(1j * _series(batch.column(residual), n))
            ix = bootstrap_matrix(z.shape[1])
            coh = np.stack([np.abs(z[:, row].mean(1)) for row in ix], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coh.std(1))], names=schema.names)

    return points.mapInArrow(run, schema).where(F.col("coh_std") < limit)


def arc_noise(points: DataFrame, arcs: DataFrame, phase: str, images: Images, width: float, dropped: list[int] | None = None) -> DataFrame:
    """(a, b, std, most): noise of each arc's series less a local weighted line around each date and a slope over the baselines.

    Two equi-joins fetch the ends; the rest is local to the arc, but for the variance of each image over all arcs that
    weighs the slope: a number per image.
    """
    end = lambda k: points.select(F.col("pid").alias(k), F.col(phase).alias(f"p_{k}"))
    rows = arcs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "p_a", "p_b")
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in "ab"), *(T.StructField(c, ARRAY) for c in ("noise", "without"))])
    used = [k for k in range(len(images.phase_bperp)) if k not in (dropped or [])]
    day, b = np.asarray(images.day, float), np.asarray(images.phase_bperp, float)[used]
    day = day if images.pairs else day[used]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            dph = np.exp(1j * (_series(batch.column("p_b"), n) - _series(batch.column("p_a"), n)))[:, used]
            if images.pairs:  # pairs are short: what they hold beside the slope is noise
                noise = without = np.angle(np.nan_to_num(dph))
            else:
                noise, without = weeding.series_noise(np.nan_to_num(dph), day, width)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), _lists(noise), _lists(without)], names=schema.names)

    found = stored(rows.mapInArrow(run, schema), "arcs")
    variance = np.array([v or 1.0 for v in found.agg(*(F.var_samp(F.col("without")[k]) for k in range(len(used)))).first()])
    weights = b / variance
    slope = dot(F.col("noise"), (weights / ((weights * b).sum() or 1.0)).tolist())
    flat = F.zip_with("noise", F.array(*map(F.lit, b.tolist())), lambda v, x: v - F.col("_k") * x)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mean = total(F.col("_v")) / len(used)
    deviation = F.sqrt(total(F.transform("_v", lambda v: (v - F.col("_m")) ** 2)) / max(1, len(used) - 1))
    out = found.withColumn("_k", slope).select("a", "b", flat.alias("_v")).withColumn("_m", mean)
    return out.select("a", "b", deviation.alias("std"), F.array_max(F.transform("_v", F.abs)).alias("most"))


def weed_points(selected: DataFrame, images: Images, params: Params, patch: str = "patch", target: int = weeding.TILE) -> DataFrame:
    """Selected points without adjacent, low, duplicate and noisy ones; adds ps_std and ps_max.

    Noise is the least over a point's arcs in the triangulation of its tile with halo; tiles of about `target` points are cut
    anew, whatever the patches are. A point without any arc can't be told from noise and is left out.
    """
    rows = selected
    if params.get("weed_neighbours") == "y":
        rows = weeding.weed_adjacent(rows, [patch], "pid", "coh2")
    if params.get("weed_zero_elevation") == "y":
        rows = rows.where("hgt >= 1e-6")
    rows = stored(weeding.best_of(rows, ["x", "y"], "coh2", "pid"), "weeded")
    most_std, most_max = params.get("weed_standard_dev"), params.get("weed_max_noise")
    if most_std >= np.pi and most_max >= np.pi:
        return rows.select("*", F.lit(None).cast("double").alias("ps_std"), F.lit(None).cast("double").alias("ps_max"))
    b = F.array(*map(F.lit, images.phase_bperp))
    left = F.zip_with("ph", b, lambda p, x: p - F.col("k2") * x)
    flat = rows.select("pid", (left if images.pairs else F.transform(left, lambda v, i: F.when(i == images.reference, F.col("c2")).otherwise(v))).alias("q"))
    tiled = stored(weeding.tiles(rows, "pid", target=target), "tiles")
    found = mesh.delaunay_arcs(tiled, "tile", "pid", lines=True).withColumnRenamed("patch", "tile")
    ends = found.select("tile", F.explode(F.array("a", "b")).alias("pid"), "a", "b")
    ends = stored(ends.join(tiled.where("home").select("tile", "pid"), ["tile", "pid"]).select("pid", "a", "b"), "arcs")
    noise = arc_noise(flat, ends.select("a", "b").distinct(), "q", images, params.get("weed_time_win"), image_list(params.get("drop_ifg_index"), len(images.phase_bperp)))
    least = ends.join(noise, ["a", "b"]).groupBy("pid").agg(F.min("std").alias("ps_std"), F.min("most").alias("ps_max"))
    inf = F.lit(float("inf"))
    quiet = (F.coalesce("ps_std", inf) < most_std) & (F.coalesce("ps_max", inf) < most_max)
    return stored(rows.join(least, "pid", "left").where(quiet), "weeded")


def correct_phase(points: DataFrame, images: Images) -> DataFrame:
    """points with rc: phase less look-angle error and, over images, less the reference's noise; 0 at the reference."""
    b = F.array(*map(F.lit, images.phase_bperp))
    if images.pairs:
        return points.withColumn("rc", F.transform(F.zip_with("ph", b, lambda p, x: p - F.col("k2") * x), wrap))
    rc = F.zip_with("ph", b, lambda p, x: p - F.col("k2") * x - F.col("c2"))
    return points.withColumn("rc", F.transform(rc, lambda v, i: F.when(i == images.reference, F.lit(0.0)).otherwise(wrap(v))))


def merge_patches(points: DataFrame, images: Images, params: Params, patch: str = "patch") -> DataFrame:
    """Corrected points of all patches as one table: pixel by pixel, or resampled to cells of merge_resample_size metres.

    Points without az and rg, or patches without overlap (no is_inner), have nothing to merge and pass as they are. Resampled points take the
    smallest id of their cell; their phases are those of the sums weighted by signal over noise.
    """
    size = params.get("merge_resample_size")
    rows = points if "is_inner" in points.columns else points.withColumn("is_inner", F.lit(True))
    if not size > 0:
        if not {"az", "rg", "is_inner"} <= set(points.columns):
            return points
        return merging.merge_points(rows.withColumnRenamed(patch, "patch"), [], "coh2", "pid").drop("is_inner")
    n = len(images.phase_bperp)
    b = F.array(*map(F.lit, images.phase_bperp))
    residual = F.zip_with(F.zip_with("ph", b, lambda p, x: p - F.col("k2") * x), F.col("f") if "f" in points.columns else F.array_repeat(F.lit(0.0), n), lambda p, f: wrap(p - f))
    inner = rows.where("is_inner").withColumn("residual", residual)
    means = [c for c in ("lon", "lat", "x", "y", "k2", "c2", "hgt", "inc", "la") if c in points.columns]
    whole = tuple(c for c in ("az", "rg") if c in points.columns)
    merged = merging.resample(
        inner, [patch], size, "coh2", means, params.get("merge_standard_dev"), "residual", "c2", bool(images.pairs), ("ph", "rc", *(["f"] if "f" in points.columns else [])), (), whole, n
    )
    first = inner.groupBy(patch).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"))
    ids = inner.select("pid", patch, "x", "y").join(first, patch).groupBy(patch, phasegrid.cell(F.col("y"), F.col("_y0"), size, 1e-9).alias("ci"), phasegrid.cell(F.col("x"), F.col("_x0"), size, 1e-9).alias("cj")).agg(F.min("pid").alias("pid"))
    angle = lambda c: F.zip_with(f"{c}_im", f"{c}_re", lambda y, x: F.atan2(y, x)).alias(c)
    return merged.join(ids, [patch, "ci", "cj"]).select("pid", patch, *means, *whole, F.col("coh").alias("coh2"), *(angle(c) for c in ("ph", "rc", *(["f"] if "f" in points.columns else []))))


def image_deviations(points: DataFrame, images: Images) -> list[float]:
    """Root mean square over all points of what patch phase, look-angle error and reference noise leave of each phase."""
    n = len(images.phase_bperp)
    if "f" not in points.columns:
        return [1.0] * n
    b = images.phase_bperp
    left = lambda k: wrap(F.col("ph")[k] - F.col("f")[k] - F.col("k2") * b[k] - F.col("c2"))
    row = points.agg(*(F.sqrt(F.avg(left(k) * left(k))) for k in range(n))).first()
    return [float(v) if v is not None else 1.0 for v in row]


def unwrap_points(points: DataFrame, images: Images, params: Params) -> DataFrame:
    """(pid, uw array over `used` phases): phases unwrapped on the grid by unwrap_method, and the points' residuals added back."""
    count = len(images.phase_bperp)
    dropped = image_list(params.get("drop_ifg_index"), count)
    if not images.pairs:
        dropped = sorted({*dropped, images.reference})
    used = [k for k in range(count) if k not in dropped]
    cells = phasegrid.with_cells(points.withColumn("all", F.lit(1)).drop("gi", "gj"), ["all"], params.get("unwrap_grid_size"), "x", "y")
    b = F.array(*map(F.lit, images.phase_bperp))
    if params.get("unwrap_patch_phase") == "y":
        if "f" not in points.columns:
            raise ValueError("unwrap_patch_phase needs the patch phase f of the points")
        wanted = F.col("f")
    else:
        wanted = F.zip_with("rc", b, lambda p, x: p + F.col("k2") * x)
    of = {k: n for n, k in enumerate(used)}
    place = F.create_map(*(F.lit(v) for pair in of.items() for v in pair))
    rows = cells.select("pid", "gi", "gj", F.posexplode(wanted).alias("k", "p")).where(F.col("k").isin(used)).select("pid", "gi", "gj", place[F.col("k")].alias("img"), "p")
    rows = stored(rows, "unwrap-in")
    sums = phasegrid.accumulate(rows, ["img", "gi", "gj"], "p")
    pairs = [images.pairs[k] for k in used] if images.pairs else [(images.reference, k) for k in used]
    grid = unwrapping.unwrap_space_time(
        sums, pairs, images.day, [images.phase_bperp[k] for k in used], params.get("unwrap_method"), params.get("unwrap_time_win"),
        images.wraps if params.get("unwrap_la_error_flag") == "y" else None, int(params.get("unwrap_gold_n_win")), params.get("unwrap_gold_alpha"), params.get("unwrap_prefilter_flag") == "y",
    ).withColumnRenamed("ph", "g")
    z = F.col("p") - F.col("g")
    back = rows.join(grid, ["img", "gi", "gj"]).select("pid", "img", (F.col("g") + wrap(z)).alias("u"))
    ordered = F.array_sort(F.collect_list(F.struct("img", "u")))
    long = back.groupBy("pid").agg(F.transform(ordered, lambda s: s.u).alias("uw"))
    return long.withColumn("used", F.array(*map(F.lit, used)))


def invert_pairs(points: DataFrame, images: Images) -> tuple[DataFrame, np.ndarray]:
    """(points with uw over all images, 0 at the reference, and what the pairs hold beyond it in `misfit`; covariance of the images)."""
    used = list(points.select("used").first()[0])
    pairs = [images.pairs[k] for k in used]
    n = len(images.day)
    matrix = network.inverse(pairs, n, images.reference)
    fit = network.design(pairs, n) @ matrix - np.eye(len(pairs))
    rows = stored(points.withColumn("misfit", network.invert("uw", -fit)).withColumn("uw", network.invert("uw", matrix)), "inverted")
    variance = rows.agg(*(F.var_pop(F.when(~F.isnan(F.col("misfit")[k]), F.col("misfit")[k])) for k in range(len(pairs)))).first()
    return rows.withColumn("used", F.array(*map(F.lit, range(n)))), network.covariance_of_images(matrix, [v or 0.0 for v in variance])


def full_series(points: DataFrame, images: Images) -> DataFrame:
    """points with uw over all images: 0 at the reference, NaN where an image was dropped."""
    used = F.map_from_arrays("used", "uw")
    whole = F.array(*(F.lit(0.0) if k == images.reference else F.coalesce(used[k], F.lit(float("nan"))) for k in range(len(images.day))))
    return points.withColumn("uw", whole)


def _good(images: Images, *dropped) -> list[int]:
    gone = {k for d in dropped for k in d}
    return [k for k in range(len(images.day)) if k not in gone]


def less_tropo(points: DataFrame, params: Params, column: str = "uw") -> DataFrame:
    """points less the delay phases of `tropo_<method>`, an array over the images, where they have one and subtr_tropo says so."""
    name = f"tropo_{params.get('tropo_method')}"
    if params.get("subtr_tropo") != "y" or name not in points.columns:
        return points
    return points.withColumn(column, F.coalesce(F.when(F.size(name) == F.size(column), F.zip_with(column, name, lambda u, t: u - F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)))), F.col(column)))


def look_angle(points: DataFrame, images: Images, params: Params | None = None, covariance: np.ndarray | None = None) -> DataFrame:
    """points (pid, uw) with k_uw, c_uw and scla: the look-angle slope of successive differences, its phase in each image, and the
    offset of what it leaves, beside a velocity, weighted by the images' covariance. Dropped images take no part.
    """
    params = params or Params()
    gone = [*image_list(params.get("drop_ifg_index"), len(images.day))] if not images.pairs else []
    use = _good(images, gone, image_list(params.get("scla_drop_index"), len(images.day)))
    b, day = np.asarray(images.bperp, float), np.asarray(images.day, float)
    # a network knows the baselines of its images only against the reference, which drops out of its differences
    steps = [k for k in use if not (images.pairs and k == images.reference)]
    db, dd = np.diff(b[steps]), np.diff(day[steps])
    design = np.stack([np.ones_like(db), db, *([dd] if len(db) >= 4 else [])], 1)
    weights = np.zeros(len(b))  # the slope as one dot product with the images themselves
    row = network.lscov(design)[1]
    np.add.at(weights, steps[1:], row)
    np.add.at(weights, steps[:-1], -row)
    bcol = F.array(*map(F.lit, (b - b[images.reference]).tolist()))
    clean = F.transform("uw", lambda v: F.nanvl(v, F.lit(0.0)))
    k = _l1(points, "uw", design, steps) if params.get("scla_method") == "L1" else points.withColumn("k_uw", dot(clean, weights.tolist()))
    rows = k.withColumn("scla", F.transform(bcol, lambda x: x * F.col("k_uw")))
    rest = [i for i in use if i != images.reference]
    t = np.stack([np.ones(len(rest)), day[rest] - day[images.reference]], 1)
    offset = np.zeros(len(day))
    offset[rest] = network.lscov(t, None if covariance is None else covariance[np.ix_(rest, rest)])[0]
    return rows.withColumn("c_uw", dot(F.zip_with(clean, "scla", lambda u, s: u - s), offset.tolist()))


def _l1(points: DataFrame, column: str, design: np.ndarray, steps: list[int]) -> DataFrame:
    """points with k_uw: least absolute differences by reweighting, all points of a batch at once."""
    schema = T.StructType([*points.schema.fields, T.StructField("k_uw", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            d = np.nan_to_num(np.diff(_series(batch.column(column), n)[:, steps], axis=1))
            x = d @ np.linalg.pinv(design).T
            for _ in range(30):
                w = 1 / np.maximum(np.abs(d - x @ design.T), 1e-6)
                a = np.einsum("np,pi,pj->nij", w, design, design)
                x = np.linalg.solve(a, np.einsum("np,pi->ni", w * d, design)[..., None])[..., 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 1])], names=schema.names)

    return points.mapInArrow(run, schema)


def spatial_noise(points: DataFrame, images: Images, params: Params) -> DataFrame:
    """(pid, scn array): phase that is smooth in space and rough in time, relative to the point of the smallest id, 0 at the reference.

    points: pid, x, y, ex, ey, ez, uw less look-angle error. High-pass in time is local to the point; differences along arcs are linear in it, so
    putting them together again would give the same up to the first point's own. The planes of the images in scn_deramp_ifg pass the high-pass
    untouched. The low-pass in space goes cell by cell with its halo.
    """
    day, n = np.asarray(images.day, float), len(images.day)
    gone = image_list(params.get("drop_ifg_index"), n) if not images.pairs else []
    use = _good(images, gone)
    w = np.exp(-((day[:, None] - day[None, :]) ** 2) / (2 * params.get("scn_time_win") ** 2))
    w[:, images.reference] = 0
    w[:, gone] = 0
    high = np.eye(n) - w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    high[gone] = 0
    rows = points.withColumn("uw", F.transform("uw", lambda v: F.nanvl(v, F.lit(0.0))))
    planes = [use[k] for k in deramp_list(params.get("scn_deramp_ifg"), use, n)]
    if planes:
        long = rows.select("pid", "x", "y", F.posexplode("uw").alias("img", "p")).where(F.col("img").isin(planes))
        found = {r["img"]: (r["r0"], r["rx"], r["ry"]) for r in correction.ramps(long, ["img"], "p").collect()}
        plane = F.array(*(F.lit(found[k][0]) + F.lit(found[k][1]) * F.col("x") + F.lit(found[k][2]) * F.col("y") if k in found else F.lit(0.0) for k in range(n)))
        rows = rows.withColumn("_plane", plane).withColumn("uw", F.zip_with("uw", "_plane", lambda u, v: u - v))
        rough = rows.withColumn("rough", F.zip_with(network.invert("uw", high), "_plane", lambda u, v: u + v))
    else:
        rough = rows.withColumn("rough", network.invert("uw", high))
    rough = stored(rough.select("pid", "ex", "ey", "ez", "rough"), "rough")
    scale = params.get("scn_wavelength")
    mean = stored(correction.spatial_low_pass(rough, "pid", "rough", scale).select(F.col("id").alias("pid"), F.col("low").alias("m")), "smooth-noise")
    first = mean.agg(F.min_by("m", "pid")).first()[0] or [0.0] * n
    base = F.array(*map(F.lit, first))
    return mean.select("pid", F.transform(F.zip_with("m", base, lambda v, f: v - f), lambda v, i: F.when(i == images.reference, F.lit(0.0)).otherwise(v)).alias("scn"))


def in_reference(params: Params) -> Column:
    """Is a point in the reference area: the lon/lat box, and within the radius of its centre if there is one."""
    (lon0, lon1), (lat0, lat1), radius = params.get("ref_lon"), params.get("ref_lat"), params.get("ref_radius")
    inside = F.lit(True)
    for c, lo, hi in (("lon", lon0, lon1), ("lat", lat0, lat1)):
        if np.isfinite(lo):
            inside &= F.col(c) >= float(lo)
        if np.isfinite(hi):
            inside &= F.col(c) <= float(hi)
    if np.isfinite(radius):
        x, y = params.get("ref_centre_lonlat")
        metres = 111319.5
        d2 = ((F.col("lon") - float(x)) * metres * float(np.cos(np.radians(y)))) ** 2 + ((F.col("lat") - float(y)) * metres) ** 2
        inside &= d2 <= float(radius) ** 2
    return F.coalesce(inside, F.lit(False))


def referenced(points: DataFrame, params: Params, n: int, column: str = "uw") -> DataFrame:
    """points with the reference area's mean taken off each image; all points are the reference where the area holds none.

    The means, a number per image, are the only thing that reaches the driver.
    """
    inside = in_reference(params)
    value = lambda k: F.when(~F.isnan(F.col(column)[k]), F.col(column)[k])
    row = points.agg(*(F.coalesce(F.avg(F.when(inside, value(k))), F.avg(value(k)), F.lit(0.0)) for k in range(n))).first()
    mean = F.array(*(F.lit(float(v)) for v in row))
    return points.withColumn(column, F.zip_with(column, mean, lambda a, b: a - b))


def deramped_series(points: DataFrame, column: str = "uw") -> DataFrame:
    """points with a plane taken off each image; x and y in metres."""
    long = points.select("pid", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"), F.posexplode(column).alias("img", "p"))
    flat = correction.deramped(long, ["img"], "p")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("img", "p"))), lambda s: s.p)
    return points.drop(column).join(flat.groupBy("pid").agg(ordered.alias(column)), "pid")


#: Corrections an export may name.
MODES = ("v", "v-d", "v-do", "v-s", "v-so", "v-ds", "v-dso")


def export_points(points: DataFrame, images: Images, corrections: str = "v-dso", covariance: np.ndarray | None = None, dropped: list[int] | None = None) -> DataFrame:
    """pid, lon, lat, vel and a displacement column per date in mm: unwrapped phase less what `corrections` names.

    'd' takes the look-angle phase off, 's' the spatial noise; the offset c_uw goes with exactly 'v-d'; 'o' stands for ramps, which have their own
    parameter. The velocity is that of generalised least squares over the images without the reference and those dropped.
    """
    import datetime as dt

    if corrections not in MODES:
        raise ValueError(f"corrections {corrections!r}: one of {', '.join(MODES)}")
    flags = corrections.split("-")[1] if "-" in corrections else ""
    for flag, column in (("d", "scla"), ("s", "scn")):
        if flag in flags and column not in points.columns:
            raise ValueError(f"corrections {corrections!r} need the column {column}")
    phase = F.col("uw")
    if "d" in flags:
        phase = F.zip_with(phase, "scla", lambda u, s: u - s)
    if "s" in flags:
        phase = F.zip_with(phase, "scn", lambda u, s: u - s)
    if corrections == "v-d":
        phase = F.transform(phase, lambda u: u - F.col("c_uw"))
    from siltgrid.operators.export import YEAR

    day = np.asarray(images.day, float)
    use = _good(images, dropped or [], [images.reference])
    slope = np.zeros(len(day))
    design = np.stack([np.ones(len(use)), day[use] - day[images.reference]], 1)
    slope[use] = network.lscov(design, None if covariance is None else covariance[np.ix_(use, use)])[1]
    mm = -images.wavelength * 1000 / (4 * np.pi)
    rows = points.withColumn("_p", F.transform(phase, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))
    names = ["D" + (dt.date(1970, 1, 1) + dt.timedelta(days=int(d) - 719529)).strftime("%Y%m%d") for d in images.day]
    return rows.select(
        "pid", "lon", "lat", (dot(F.col("_p"), (slope * YEAR * mm).tolist())).alias("vel"),
        *(((F.col("_p")[k] - F.col("_p")[0]) * mm).alias(n) for k, n in enumerate(names)),
    )


#: Steps in order; run() does those from start to end.
STEPS = ("gamma", "select", "weed", "correct", "merge", "unwrap", "scla", "scn", "export")


class Stages:
    """Tables of the steps under their names in a folder that all executors share; a step counts as done once its table is written whole.

    Small products (the null histogram, the covariance of the images) are one-column tables beside them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def done(self) -> list[str]:
        """Steps that are done, up to the first that is not."""
        out = []
        for step in STEPS:
            if not self._there(step):
                break
            out.append(step)
        return out

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def put(self, name: str, values: np.ndarray) -> None:
        v = np.asarray(values, float)
        self.write(name, self.spark.createDataFrame([(list(v.shape), v.ravel().tolist())], "shape array<int>, v array<double>"))

    def get(self, name: str) -> np.ndarray | None:
        if not self._there(name):
            return None
        shape, v = self.read(name).first()
        return np.asarray(v).reshape(shape)

    def forget(self, names: list[str]) -> None:
        """Remove tables, so that nothing later than a step that runs again is taken for its result."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def run(points: DataFrame, images: Images, params: Params | None = None, start: str | None = None, end: str = "export", state: dict | None = None, folder: str | None = None, corrections: str = "v-dso") -> dict:
    """Tables of the steps by name. points: pid, patch, x, y, lon, lat, d_a, hgt, ph, and where there are inc, la, az, rg, is_inner, tropo_<method>.

    folder: where the tables are kept under their steps' names; without `start` the run goes on after the last step that is done there.
    state: tables of earlier steps to resume from instead. A step without points leaves an empty table and the rest is skipped.
    """
    params, done = (params or Params()).checked(), dict(state or {})
    stages = Stages(points.sparkSession, folder) if folder else None
    if stages:
        if start is None:
            ready = stages.done()
            start = STEPS[min(len(ready), len(STEPS) - 1)]
            if len(ready) == len(STEPS):
                return {s: stages.read(s) for s in STEPS}
        stages.forget([s for s in STEPS[STEPS.index(start) :]])
        for s in STEPS[: STEPS.index(start)]:
            done.setdefault(s, stages.read(s))
        done.setdefault("null", stages.get("null"))
        done.setdefault("covariance", stages.get("covariance"))
    start = start or STEPS[0]
    if STEPS.index(start) > STEPS.index(end):
        raise ValueError("start comes after end")
    from siltgrid.operators.near import with_positions

    keep = stages.write if stages else lambda name, df: stored(df, name)
    images = Images(images.day, images.bperp, images.reference, images.wavelength, images.mean_incidence, images.pairs, params.get("max_topo_err"))
    if {"inc", "la"} & set(points.columns):
        images.mean_incidence = mean_incidence(points)
    n = len(images.day)
    dropped = [] if images.pairs else image_list(params.get("drop_ifg_index"), n)
    for step in STEPS[STEPS.index(start) : STEPS.index(end) + 1]:
        if step == "gamma":
            table, done["null"] = estimate_gamma(points, images, params)
            if stages:
                stages.put("null", done["null"])
        elif step == "select":
            table = select_points(done["gamma"], done["null"], images, params)
        elif step == "weed":
            table = weed_points(done["select"], images, params)
        elif step == "correct":
            table = correct_phase(done["weed"], images)
        elif step == "merge":
            table = merge_patches(done["correct"], images, params)
        elif step == "unwrap":
            table = stored(done["merge"].join(unwrap_points(done["merge"], images, params), "pid"), "unwrapped")
            if table.isEmpty():
                covariance = None
            elif images.pairs:
                table, covariance = invert_pairs(table, images)
            else:
                covariance = np.diag(np.maximum(np.asarray(image_deviations(table, images)), 1e-3) ** 2)
            table = full_series(table, images)
            done["covariance"] = covariance
            if stages and covariance is not None:
                stages.put("covariance", covariance)
        elif step == "scla":
            table = less_tropo(done["unwrap"], params)
            table = deramped_series(table) if params.get("scla_deramp") == "y" else table
            table = look_angle(referenced(table, params, n), images, params, done.get("covariance"))
        elif step == "scn":
            clean = done["scla"].withColumn("uw", F.zip_with("uw", "scla", lambda u, s: u - s))
            scn = spatial_noise(with_positions(clean.select("pid", "lon", "lat", "x", "y", "uw")), images, params)
            table = done["scla"].join(scn, "pid")
        else:
            table = export_points(referenced(done["scn"], params, n), images, corrections, done.get("covariance"), dropped)
        done[step] = table if step == "export" and not stages else keep(step, table)
        if step != "export" and done[step].isEmpty():
            break
    return done
