"""From the rasters of a stack to the first table of the chain: candidates with their phases, places and baselines.

A scan reads the same rows of every image in one task, so amplitude statistics, the choice of candidates and pair phases are local to a
pixel's row; only candidates, a small part of all pixels, are joined with anything. Layouts: one folder for each date around a single
reference, or a merged stack of images with pair folders.

Defined cases: a pixel with a sample of (nearly) no amplitude, or masked, is no candidate; a negative threshold takes the pixels at or above its size;
candidates are numbered from 1 by y, then x; coordinates are rounded to the millimetre after that; files that end early
are padded with zeros; pairs of dates without an image are an error; pair points with more than one phase of exactly 0 are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrid.functions import geo
from siltgrid.operators.patches import assign, patch_bounds
from siltgrid.operators.ranking import distributed_rank
from siltgrid.plans.pipeline import Images
from siltgrid.session import stored
from siltgrid.sources import metadata, rasters

#: Amplitudes that count for an image's mean, and those that count as none once divided by it.
LEAST_MEAN, LEAST = 0.001, 5e-5


@dataclass
class StackFiles:
    """What a stack consists of. images: path by date (yyyymmdd); interferograms: path by date (single reference) or by pair."""

    width: int
    length: int
    reference: int
    images: dict[int, str]
    interferograms: dict = field(default_factory=dict)
    bperp: dict[int, float] = field(default_factory=dict)
    lon: str | None = None
    lat: str | None = None
    dem: str | None = None
    inc: str | None = None
    la: str | None = None
    mask: str | None = None
    heading: float = 0.0
    wavelength: float = 0.056
    real: str = "f4"
    angles_in_degrees: bool = True

    @property
    def dates(self) -> list[int]:
        return sorted({*self.images, self.reference})


def serial_of(date: int) -> int:
    """Serial day number of yyyymmdd, 0000-01-01 being day 1."""
    return dt.date(date // 10000, date // 100 % 100, date % 100).toordinal() + 366


def as_dates(values: Iterable[float], known: set[int]) -> list[int]:
    """Days as yyyymmdd: written so, or as serial day numbers of whichever of the two day-ones makes more of them dates of the stack."""
    values = [int(v) for v in values]
    if all(v > 10_000_000 for v in values):
        return values
    read = lambda shift: [int(dt.date.fromordinal(v - shift).strftime("%Y%m%d")) if v > shift else 0 for v in values]
    return max((read(366), read(0)), key=lambda days: len(known & set(days)))


def single_reference_layout(folder: str | Path) -> StackFiles:
    """A project of date folders with slave.slc and isce_minrefdem.int around <reference>/master/master.slc, and its text files."""
    here = Path(folder)
    shape = [int(metadata.vector(here / n)[0]) for n in ("width.txt", "len.txt")]
    folders = sorted(p for p in here.iterdir() if p.is_dir() and metadata.path_date(p.name))
    own = {metadata.path_date(p.name): p for p in folders if not p.name.startswith("master_")}
    images = {d: str(p / "slave.slc") for d, p in own.items() if (p / "slave.slc").is_file()}
    given = metadata.find(here, "master_day.1.in")
    known = set(images)
    master = [p for p in folders if (p / "master" / "master.slc").is_file()]
    reference = as_dates(metadata.vector(given), known)[0] if given else metadata.path_date(master[0].name)
    if master:
        images[reference] = str(master[0] / "master" / "master.slc")
    listed = metadata.find(here, "day.1.in")
    days = as_dates(metadata.vector(listed), known) if listed else sorted(known)
    base = metadata.find(here, "bperp.1.in")
    place = lambda *names: next((str(here / n) for n in names if (here / n).is_file()), None)
    return StackFiles(
        shape[0], shape[1], reference, images, {d: str(own[d] / "isce_minrefdem.int") for d in days if (own[d] / "isce_minrefdem.int").is_file()},
        {**dict(zip(days, metadata.vector(base) if base else [0.0] * len(days))), reference: 0.0}, place("lon.raw"), place("lat.raw"), place("dem.raw"), place("inc_angle.raw"), place("look_angle.raw"), place("mask.raw"),
        *(metadata.vector(metadata.find(here, n))[0] if metadata.find(here, n) else v for n, v in (("heading.1.in", 0.0), ("lambda.1.in", 0.056))),
    )


def merged_layout(folder: str | Path, reference: int | None = None, heading: float = 0.0, wavelength: float = 0.056, width: int | None = None, length: int | None = None) -> StackFiles:
    """A merged stack: merged/SLC/<date>, merged/interferograms/<pair>, baselines/<pair>, geometry beside them."""
    here = Path(folder)
    images = metadata.discover_images(here / "merged" / "SLC")
    pairs = metadata.discover_pairs([here / "merged" / "interferograms"])
    folders = [str(p) for p in (here / "baselines").glob("*")] if (here / "baselines").is_dir() else []
    reference = reference or metadata.reference_date({}, folders) or min(images)
    bperp = {reference: 0.0}
    for f in folders:
        pair = metadata.path_pair(f)
        reports = sorted(Path(f).glob("*.txt"))
        if pair and reference in pair and reports:
            value = metadata.average_baseline(reports[0])
            bperp[pair[0] if pair[1] == reference else pair[1]] = (value or 0.0) * (1 if pair[0] == reference else -1)
    at = lambda *names: next((str(p) for n in names for d in ("merged/geom_reference", "merged/geom_master", ".") if (p := here / d / n).is_file()), None)
    lon = at("lon.rdr.full", "lon.raw", "lon.rdr")
    xml = rasters.sidecar(lon) if lon else {}
    width = width or int(xml.get("width", 0)) or int(metadata.vector(here / "width.txt")[0])
    length = length or int(xml.get("length", 0)) or Path(next(iter(images.values()))).stat().st_size // (8 * width)
    return StackFiles(
        width, length, reference, images, pairs, bperp, lon, at("lat.rdr.full", "lat.raw", "lat.rdr"), at("hgt.rdr.full", "dem.raw", "hgt.rdr"), at("inc_angle.raw"), at("look_angle.raw"), at("mask.raw"), heading, wavelength,
        rasters.XML_TYPES.get(xml.get("data_type", "").upper(), "f4"),
    )


def calibrations(stack: DataFrame, n: int) -> list[float]:
    """Mean amplitude of each image over its samples above the floor; 0 where there is none."""
    size = lambda k: F.sqrt(F.col("re")[k] ** 2 + F.col("im")[k] ** 2)
    row = stack.agg(*(F.coalesce(F.avg(F.when(size(k) > LEAST_MEAN, size(k))), F.lit(0.0)) for k in range(n))).first()
    return [float(v or 0.0) for v in row]


def candidates(stack: DataFrame, constants: list[float], threshold: float, pairs: list[tuple[int, int]]) -> DataFrame:
    """stack's stable pixels with d_a: by the dispersion of calibrated amplitudes, or by that of their differences in pairs."""
    scale = F.array(*(F.lit(1 / c if c else float("inf")) for c in constants))
    size = F.zip_with(F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)), scale, lambda a, c: a * c)
    rows = stack.withColumn("_a", F.transform(size, lambda a: F.when(a > LEAST, a).otherwise(0.0)))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda t, v: t + f(v))
    n, s1, s2 = F.size("_a"), total("_a", lambda v: v), total("_a", lambda v: v * v)
    if pairs:
        of = F.array(*(F.struct(F.col("_a")[i].alias("a"), F.col("_a")[j].alias("b")) for i, j in pairs))
        d = F.sqrt(total(of, lambda p: (p.a - p.b) ** 2) / len(pairs)) / (total(of, lambda p: p.a + p.b) / (2 * len(pairs)))
    else:
        d = F.sqrt(F.greatest(n * s2 / (s1 * s1) - 1, F.lit(0.0)))
    wanted = F.col("d_a") < threshold if threshold >= 0 else F.col("d_a") >= -threshold
    rows = rows.withColumn("d_a", F.when((F.array_min("_a") > 0) & (s1 > 0), d)).drop("_a")
    return rows.where(wanted & ~F.isnan("d_a"))


def _angles(rows: DataFrame, re: str, im: str) -> DataFrame:
    zero = F.zip_with(re, im, lambda a, b: F.when((a != 0) | (b != 0), F.atan2(b, a)))
    return rows.withColumn("ph", zero)


def prepare(spark: SparkSession, files: StackFiles, mode: str = "ps", threshold: float = 0.4, pairs: list[tuple[int, int]] | None = None, patches: tuple[int, int] = (1, 1), overlap: int = 50) -> tuple[DataFrame, Images]:
    """(first table of the chain, its image axis). mode: 'ps' for a single reference, 'sb' for a pair network.

    pairs: of dates; by default those with an interferogram, else each date with the next. The table has pid, az, rg, lon, lat, x, y, d_a, hgt,
    inc, la, patch, is_inner and ph; a point of an overlap has a row in every patch that holds it.
    """
    if mode not in ("ps", "sb"):
        raise ValueError(f"mode {mode!r}: ps or sb")
    dates = files.dates
    place = {d: k for k, d in enumerate(dates)}
    listed: list[tuple[int, int]] = []
    if mode == "sb":
        listed = sorted(pairs or [p for p in files.interferograms if isinstance(p, tuple)] or list(zip(dates, dates[1:])))
        unknown = sorted({d for p in listed for d in p} - set(files.images))
        if unknown:
            raise ValueError(f"pairs of dates without an image: {', '.join(map(str, unknown))}")
    network = [(place[a], place[b]) for a, b in listed]
    shape = {"width": files.width, "length": files.length}
    stack = rasters.read_stack(spark, [files.images[d] for d in sorted(files.images)], dtype="c64", **shape)
    if files.mask:
        stack = rasters.unmasked(stack, rasters.read_raster(spark, files.mask, dtype="u1", **shape))
    order = {d: k for k, d in enumerate(sorted(files.images))}
    constants = calibrations(stack, len(order))
    found = candidates(stack, constants, threshold, [(order[a], order[b]) for a, b in listed])
    if mode == "sb":  # first image times the conjugate of the second
        product = lambda i, j: (F.col("re")[i] * F.col("re")[j] + F.col("im")[i] * F.col("im")[j], F.col("im")[i] * F.col("re")[j] - F.col("re")[i] * F.col("im")[j])
        z = [product(order[a], order[b]) for a, b in listed]
        found = _angles(found.withColumn("_re", F.array(*(a for a, _ in z))).withColumn("_im", F.array(*(b for _, b in z))), "_re", "_im").drop("_re", "_im", "re", "im")
        found = found.where(F.size(F.filter("ph", lambda p: p.isNull())) <= 1)
    else:
        used = [d for d in dates if d != files.reference]
        missing = [d for d in used if d not in files.interferograms]
        if not missing:
            ifgs = rasters.read_stack(spark, [files.interferograms[d] for d in used], dtype="c64", **shape)
            found = found.drop("re", "im").join(_angles(ifgs, "re", "im").select("az", "rg", "ph"), ["az", "rg"])
        else:  # formed from the images: reference times the conjugate of the other
            r = order[files.reference]
            parts = [(F.col("re")[r] * F.col("re")[order[d]] + F.col("im")[r] * F.col("im")[order[d]], F.col("im")[r] * F.col("re")[order[d]] - F.col("re")[r] * F.col("im")[order[d]]) for d in used]
            found = _angles(found.withColumn("_re", F.array(*(a for a, _ in parts))).withColumn("_im", F.array(*(b for _, b in parts))), "_re", "_im").drop("_re", "_im", "re", "im")
        at = place[files.reference]
        found = found.withColumn("ph", F.concat(F.slice("ph", 1, at) if at else F.array().cast("array<double>"), F.array(F.lit(0.0)), F.slice("ph", at + 1, len(used))))
    for name, path in (("lon", files.lon), ("lat", files.lat), ("hgt", files.dem), ("inc", files.inc), ("la", files.la)):
        if path:
            found = rasters.gather(found, rasters.read_raster(spark, path, dtype=files.real, **shape), {"value": name})
            if name in ("inc", "la") and files.angles_in_degrees:
                found = found.withColumn(name, geo.angle_in_radians(F.col(name)))
        else:
            found = found.withColumn(name, F.lit(None).cast("double"))
    found = stored(found.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat", "hgt", "inc", "la")}), "candidates")
    box = found.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    lon0, lat0 = ((a + b) / 2 if a is not None else 0.0 for a, b in (box[:2], box[2:]))
    x, y = geo.local_metres(F.col("lon"), F.col("lat"), F.lit(lon0), F.lit(lat0))
    placed = found.withColumn("x", x).withColumn("y", y).withColumn("all", F.lit(1)).withColumn("angle", geo.heading_angle(F.lit(float(files.heading))))
    placed = geo.rotated(placed, ["all"]).drop("all", "angle", "is_rotated")
    numbered = distributed_rank(placed, [], [F.col("y"), F.col("x"), F.col("az"), F.col("rg")], "pid")
    numbered = numbered.withColumn("pid", F.col("pid") + 1).withColumns({c: geo.to_millimetres(F.col(c)) for c in ("x", "y")})
    bounds = patch_bounds(files.width, files.length, *patches, overlap)
    whole = numbered.withColumn("az", F.col("az") + 1).withColumn("rg", F.col("rg") + 1)
    held = assign(whole, bounds).withColumn("az", F.col("az") - 1).withColumn("rg", F.col("rg") - 1)
    table = stored(held.select("pid", "patch", "is_inner", "az", "rg", "lon", "lat", "x", "y", "d_a", "hgt", "inc", "la", F.transform("ph", lambda p: F.coalesce(p, F.lit(float("nan")))).alias("ph")), "step-1")
    base = [files.bperp.get(d, 0.0) for d in dates]
    images = Images([float(serial_of(d)) for d in dates], base, place[files.reference], files.wavelength, pairs=network)
    return table, images


def write_text_products(folder: str | Path, files: StackFiles, table: DataFrame, constants: list[float] | None = None, pairs: list[tuple[int, int]] | None = None) -> None:
    """The text files that other programs of this kind read: dates, baselines, shape, heading, calibration, pair list, patches' candidates."""
    here = Path(folder)
    here.mkdir(parents=True, exist_ok=True)
    others = [d for d in files.dates if d != files.reference]
    lines = {
        "width.txt": [files.width], "len.txt": [files.length], "heading.1.in": [files.heading], "lambda.1.in": [files.wavelength], "master_day.1.in": [files.reference], "day.1.in": others,
        "bperp.1.in": [files.bperp.get(d, 0.0) for d in others], "pscphase.in": [files.width, *(files.interferograms.get(d, "") for d in others)] if not pairs else [files.width, *(f"{a}_{b}" for a, b in pairs)],
    }
    if pairs:
        lines["small_baselines.list"] = [f"{a} {b}" for a, b in pairs]
    if constants:
        lines["calamp.out"] = [f"{files.images[d]} {c:.6g}" for d, c in zip(sorted(files.images), constants)]
    for name, values in lines.items():
        (here / name).write_text("".join(f"{v}\n" for v in values))
    write_candidates(table, f"{here}/candidates")


def write_candidates(table: DataFrame, path: str) -> None:
    """Candidates as text, a folder a patch: number, azimuth, range; and their dispersions with six digits."""
    ij = table.select("patch", F.concat_ws(" ", "pid", "az", "rg").alias("value"))
    ij.write.mode("overwrite").partitionBy("patch").text(f"{path}/ij")
    table.select("patch", F.format_string("%.6g", F.col("d_a")).alias("value")).write.mode("overwrite").partitionBy("patch").text(f"{path}/da")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(pid, az, rg) of a candidate table of three numbers a line; an empty file has no rows."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 3).select(*(parts[k].try_cast("bigint").alias(n) for k, n in enumerate(("pid", "az", "rg"))))


def read_patch_bounds(path: str | Path) -> tuple[int, int, int, int]:
    """rg1, rg2, az1, az2 of a patch file, 1-based."""
    v = [int(x) for x in metadata.vector(path)]
    if len(v) < 4 or v[0] > v[1] or v[2] > v[3]:
        raise ValueError(f"{path}: four numbers rg1 rg2 az1 az2")
    return v[0], v[1], v[2], v[3]


def max_phase_error(table: DataFrame, other: DataFrame) -> float:
    """Largest difference on the circle between two first tables' phases, point by point."""
    d = F.zip_with("a", "b", lambda a, b: F.abs(F.atan2(F.sin(a - b), F.cos(a - b))))
    both = table.select("pid", F.col("ph").alias("a")).join(other.select("pid", F.col("ph").alias("b")), "pid")
    worst = both.agg(F.max(F.array_max(d))).first()[0]
    return float(worst) if worst is not None else float(np.nan)
