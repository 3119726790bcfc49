"""Neighbouring and duplicate points: owners, groups, the best of each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltgrid.operators.components import components

OFFSETS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def neighbour_arcs(points: DataFrame, group: list[str], id_column: str, az: str = "az", rg: str = "rg") -> DataFrame:
    """(id, other) of every two points in adjacent cells, both ways: eight shifted copies and one equi-join on the cell.

    A cell holds one point, so a hot cell can't arise; the copies are a constant factor of the points.
    """
    shifts = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(r).alias("r")) for a, r in OFFSETS)))
    moved = points.select(*group, F.col(id_column).alias("other"), F.col(az).alias("_a"), F.col(rg).alias("_r"), shifts.alias("_s"))
    moved = moved.select(*group, "other", (F.col("_a") + F.col("_s.a")).alias(az), (F.col("_r") + F.col("_s.r")).alias(rg))
    return points.select(*group, F.col(id_column).alias("id"), az, rg).join(moved, [*group, az, rg]).select("id", "other")


def owners(arcs: DataFrame) -> DataFrame:
    """(id, owner): the least neighbour of each point that has one."""
    return arcs.groupBy("id").agg(F.min("other").alias("owner"))


def adjacent_groups(arcs: DataFrame) -> DataFrame:
    """(node, component) of the points linked through their owners."""
    return components(owners(arcs), "id", "owner")


def best_of(points: DataFrame, keys: list[str], score: str, id_column: str) -> DataFrame:
    """For each key the row with the highest score, then the smallest id; null and NaN scores count lowest."""
    s = F.when(F.isnan(score), None).otherwise(F.col(score))
    best = points.groupBy(*keys).agg(F.max_by(id_column, F.struct(F.coalesce(s, F.lit(float("-inf"))), -F.col(id_column))).alias(id_column))
    return points.join(best.select(id_column), id_column, "left_semi")


def weed_adjacent(points: DataFrame, group: list[str], id_column: str, score: str) -> DataFrame:
    """points with only the best of each group of adjacent points."""
    labels = adjacent_groups(neighbour_arcs(points, group, id_column))
    labelled = points.join(labels.withColumnRenamed("node", id_column), id_column, "left").withColumn("_group", F.coalesce("component", F.col(id_column)))
    return best_of(labelled, ["_group"], score, id_column).drop("component", "_group")


def scatter(arcs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(id, least, most) of a value over each point's neighbours."""
    other = values.select(F.col("id").alias("other"), F.col(value).alias("_v"))
    return arcs.join(other, "other").groupBy("id").agg(F.min("_v").alias("least"), F.max("_v").alias("most"))


def clip_to_neighbours(points: DataFrame, arcs: DataFrame, value: str) -> DataFrame:
    """points with value clipped to the range of its neighbours' values; points without neighbours keep theirs."""
    held = points.join(scatter(arcs, points, value), "id", "left")
    return held.select(*points.columns, F.coalesce(F.least(F.greatest(F.col(value), "least"), "most"), F.col(value)).alias(f"{value}_smooth"))


#: Points of a tile without its halo, and the halo's share of the tile's sides.
TILE, HALO = 4000, 0.25


def tiles(points: DataFrame, id_column: str, x: str = "x", y: str = "y", target: int = TILE, halo: float = HALO) -> DataFrame:
    """(tile, id, x, y, home) of points in every tile whose halo holds them; home in exactly one.

    Strips of equal counts along x, each cut into equal counts along y, so a tile holds about `target` points however dense
    they lie. The driver sees the bounds only.
    """
    at = points.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})").select(id_column, x, y)
    n, *box = at.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    side = max(1, math.ceil(math.sqrt(n / target)))
    if side == 1:
        return at.select(F.lit(0).cast("long").alias("tile"), id_column, x, y, F.lit(True).alias("home"))
    shares = [k / side for k in range(1, side)]
    inner = at.agg(F.percentile_approx(x, shares, 10_000)).first()[0]
    number = lambda c, bounds: F.size(F.filter(bounds, lambda v: v <= c))
    lines = F.array(*(F.lit(float(v)) for v in inner))
    cuts = {r[0]: list(r[1]) for r in at.groupBy(number(F.col(x), lines).alias("s")).agg(F.percentile_approx(y, shares, 10_000)).collect()}
    boxes = []
    xs = [box[0], *inner, box[1]]
    for s in range(side):
        ys = [box[2], *cuts.get(s, []), box[3]]
        wide = halo * (xs[s + 1] - xs[s])
        rows = []
        for k in range(len(ys) - 1):
            tall = halo * (ys[k + 1] - ys[k])
            rows.append(F.struct(F.lit(s * side + k).cast("long").alias("tile"), F.lit(float(ys[k] - tall)).alias("y0"), F.lit(float(ys[k + 1] + tall)).alias("y1")))
        near = F.struct(F.lit(float(xs[s] - wide)).alias("x0"), F.lit(float(xs[s + 1] + wide)).alias("x1"), F.array(*rows).alias("rows"), F.array(*(F.lit(float(v)) for v in ys[1:-1])).cast("array<double>").alias("cuts"), F.lit(s).alias("s"))
        boxes.append(near)
    strips = at.withColumn("_b", F.explode(F.filter(F.array(*boxes), lambda b: F.col(x).between(b.x0, b.x1))))
    own = (F.col("_b.s") == number(F.col(x), lines)).alias("_own")
    mine = F.col("_b.s") * side + number(F.col(y), F.col("_b.cuts"))
    held = strips.select(id_column, x, y, own, mine.cast("long").alias("_home"), F.explode(F.col("_b.rows")).alias("_t"))
    home = F.col("_own") & (F.col("_t.tile") == F.col("_home"))
    return held.where(home | F.col(y).between(F.col("_t.y0"), F.col("_t.y1"))).select(F.col("_t.tile").alias("tile"), id_column, x, y, home.alias("home"))


def series_noise(dph: np.ndarray, day: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(noise, noise without the date itself) of unit arc series (arcs, images): phase less a Gaussian mean and its local line."""
    noise, without = np.zeros(dph.shape), np.zeros(dph.shape)
    for k in range(dph.shape[1]):
        t = day[k] - day
        w = np.exp(-(t**2) / (2 * width * width))
        w = w / w.sum()
        mean = (dph * w).sum(1)
        left = np.angle(dph * np.conj(mean)[:, None])
        design = np.stack([np.ones_like(t), t], 1)
        solve = np.linalg.pinv((design * w[:, None]).T @ design) @ (design * w[:, None]).T
        line = left @ solve.T
        again = np.angle(np.exp(1j * (left - line @ design.T))) @ solve.T
        noise[:, k] = np.angle(dph[:, k] * np.conj(mean * np.exp(1j * (line[:, 0] + again[:, 0]))))
        w[k] = 0
        without[:, k] = np.angle(dph[:, k] * np.conj((dph * w).sum(1)))
    return noise, without
