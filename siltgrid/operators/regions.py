"""The regions that contain each point: ear clipping, a bounding-volume hierarchy, exact triangle tests.

Outlines (WKT polygons and multipolygons, holes outside) are cut into triangles where they are read. The triangles go
into a bounding-volume hierarchy that every task holds; a batch of points goes down the hierarchy as a whole,
each node passing on the points within its box, and candidate triangles are tested exactly. A point on an edge
that two triangles of one region share is found in both and reported once.

Up to BLOCK triangles are one hierarchy that is shipped to all tasks. More are spread over cells of CELL degrees: triangles go to every
cell they touch, points to theirs, and each cell has a hierarchy of its own. Cells with many points are cut into parts, each
with the cell's triangles; nothing is broadcast then, and points are read once.

Defined cases: null, empty or malformed outlines contain nothing; a point on an outline counts as inside; longitudes 360
apart are the same, so outlines may run past 180; points without a place are in no region; regions that repeat an
id are one region.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.near import has_place
from siltgrid.session import stored

#: Triangles that are broadcast at most, 64 bytes each in every task; side of a cell in degrees beyond that, and points of a part of it.
BLOCK, CELL, PART = 200_000, 1.0, 200_000
LEAF = 8

_RING = re.compile(r"\(([^()]+)\)")
_TRIANGLE = T.StructType([T.StructField("area_id", T.LongType()), *(T.StructField(f"{a}{k}", T.DoubleType()) for k in range(3) for a in "xy")])


def parse_outline(text: str | None) -> list[list[np.ndarray]]:
    """Polygons of a WKT text, each a list of rings without the closing point; [] if there is none."""
    if not text or not (m := re.match(r"\s*(MULTIPOLYGON|POLYGON)\s*\((.*)\)\s*$", text, re.S | re.I)):
        return []
    bodies = [m[2]] if m[1].upper() == "POLYGON" else re.findall(r"\(\s*((?:\([^()]+\)\s*,?\s*)+)\)", m[2])
    out = []
    for body in bodies:
        rings = []
        for ring in _RING.findall(body):
            try:
                p = np.array([[float(x) for x in pair.split()[:2]] for pair in ring.split(",")])
            except ValueError:
                return []
            p = p[np.r_[True, (np.diff(p, axis=0) != 0).any(1)]] if len(p) else p
            if len(p) > 1 and (p[0] == p[-1]).all():
                p = p[:-1]
            if len(p) >= 3:
                rings.append(p)
        if rings:
            out.append(rings)
    return out


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def _cross(o, a, b):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _bridged(rings: list[np.ndarray]) -> np.ndarray:
    """Outer ring (counter-clockwise) joined to each hole (clockwise) by a bridge that crosses no edge."""
    outer = rings[0] if signed_area(rings[0]) > 0 else rings[0][::-1]
    holes = [h if signed_area(h) < 0 else h[::-1] for h in rings[1:]]
    for hole in sorted(holes, key=lambda h: -h[:, 0].max()):
        start = int(hole[:, 0].argmax())
        m = hole[start]
        a, b = outer, np.roll(outer, -1, 0)
        spans = (a[:, 1] <= m[1]) & (b[:, 1] > m[1]) | (b[:, 1] <= m[1]) & (a[:, 1] > m[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (m[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        x = np.where(spans & (x >= m[0]), x, np.inf)
        edge = int(x.argmin())
        if not np.isfinite(x[edge]):
            continue  # the hole does not lie inside: it takes nothing away
        n = len(outer)
        k = edge if outer[edge, 0] > outer[(edge + 1) % n, 0] else (edge + 1) % n
        # reflex corners inside the triangle (m, hit, corner) would hide the corner: the best of them is taken
        hit, corner = np.array([x[edge], m[1]]), outer[k]
        tri = (m, hit, corner) if _cross(m, hit, corner) >= 0 else (m, corner, hit)
        prev, nxt = np.roll(outer, 1, 0), np.roll(outer, -1, 0)
        reflex = _cross(prev, outer, nxt) < 0
        inside = (_cross(tri[0], tri[1], outer) >= 0) & (_cross(tri[1], tri[2], outer) >= 0) & (_cross(tri[2], tri[0], outer) >= 0)
        seen = np.flatnonzero(reflex & inside & ~(outer == corner).all(1))
        if len(seen):
            d = outer[seen] - m
            k = int(seen[np.lexsort((np.hypot(d[:, 0], d[:, 1]), np.abs(np.arctan2(d[:, 1], d[:, 0]))))[0]])
        outer = np.concatenate([outer[: k + 1], np.roll(hole, -start, 0), hole[start : start + 1], outer[k:]])
    return outer


def ear_clip(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles (n, 3, 2) of a polygon with holes."""
    p = _bridged(rings)
    left, out = list(range(len(p))), []
    while len(left) > 3:
        q = p[left]
        prev, nxt = np.roll(q, 1, 0), np.roll(q, -1, 0)
        turn = _cross(prev, q, nxt)
        reflex = q[turn <= 0]
        flat = np.flatnonzero(turn == 0)
        if len(flat):
            del left[int(flat[0])]  # no area is lost with a flat corner
            continue
        clipped = False
        for i in np.flatnonzero(turn > 0).tolist():
            a, b, c = prev[i], q[i], nxt[i]
            r = reflex[~((reflex == a).all(1) | (reflex == b).all(1) | (reflex == c).all(1))]
            if not ((_cross(a, b, r) >= 0) & (_cross(b, c, r) >= 0) & (_cross(c, a, r) >= 0)).any():
                out.append((a, b, c))
                del left[i]
                clipped = True
                break
        if not clipped:  # only in rings that cross themselves: go on with the widest corner
            i = int(turn.argmax())
            out.append((prev[i], q[i], nxt[i]))
            del left[i]
    out.append(tuple(p[left]))
    t = np.array(out)
    return t[np.abs(_cross(t[:, 0], t[:, 1], t[:, 2])) > 0]


def triangles(areas: DataFrame, id_column: str = "area_id", outline: str = "outline") -> DataFrame:
    """(area_id, x0, y0, ... y2), counter-clockwise, in longitudes of the outline moved so that they start within -180..180."""

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for area, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for rings in parse_outline(text):
                    t = ear_clip(rings)
                    if not len(t) or area is None:
                        continue
                    t[..., 0] -= 360 * np.floor((t[..., 0].min() + 180) / 360)
                    ids += [area] * len(t)
                    found.append(t)
            t = np.concatenate(found) if found else np.empty((0, 3, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(t[:, k, a]) for k in range(3) for a in range(2))], names=_TRIANGLE.names)

    return areas.select(F.col(id_column).cast("long"), outline).mapInArrow(run, _TRIANGLE)


class Hierarchy:
    """A bounding-volume hierarchy over triangles, split at the median of the longer axis."""

    def __init__(self, area: np.ndarray, t: np.ndarray):
        order = np.arange(len(t))
        lo, hi = t.min(1), t.max(1)
        centre = (lo + hi) / 2
        self.box, self.child, self.span = [], [], []

        def build(at: np.ndarray, offset: int) -> int:
            node = len(self.box)
            self.box.append((*lo[at].min(0), *hi[at].max(0)))
            self.child.append((-1, -1))
            self.span.append((offset, offset + len(at)))
            if len(at) > LEAF:
                axis = int(np.ptp(centre[at, 1]) > np.ptp(centre[at, 0]))
                at = at[np.argsort(centre[at, axis], kind="stable")]
                half = len(at) // 2
                self.child[node] = (build(at[:half], offset), build(at[half:], offset + half))
            else:
                order[offset : offset + len(at)] = at
            return node

        if len(t):
            build(np.arange(len(t)), 0)
        self.area, self.t = area[order], t[order]

    def containing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, area) of each point in a closed triangle, without repeats."""
        points, areas = [], []
        stack = [(0, np.arange(len(x)))] if self.box else []
        while stack:
            node, at = stack.pop()
            x0, y0, x1, y1 = self.box[node]
            px, py = x[at], y[at]
            at = at[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
            if not len(at):
                continue
            if self.child[node][0] >= 0:
                stack += [(c, at) for c in self.child[node]]
                continue
            i, j = self.span[node]
            p = np.stack([x[at], y[at]], 1)[:, None, :]
            a, b, c = (self.t[i:j, k][None] for k in range(3))
            inside = (_cross(a, b, p) >= 0) & (_cross(b, c, p) >= 0) & (_cross(c, a, p) >= 0)
            r, k = np.nonzero(inside)
            points.append(at[r])
            areas.append(self.area[i:j][k])
        if not points:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.unique(np.stack([np.concatenate(points), np.concatenate(areas)], 1), axis=0)
        return found[:, 0], found[:, 1]


_FOUND = T.StructType([T.StructField("area_id", T.LongType()), T.StructField("id", T.LongType())])


def _triangles_of(columns) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in columns], 1).reshape(-1, 3, 2)


def _by_cells(places: DataFrame, cut: DataFrame, part: int) -> DataFrame:
    """(area_id, id) from a hierarchy for each cell; places: id, x, y with longitudes as outlines may have them."""
    cell = lambda c: F.floor(c / CELL).cast("int")
    keys = ["cx", "cy"]
    corner = lambda a, f: cell(f(*(F.col(f"{a}{k}") for k in range(3))))
    tri = cut
    for a in "xy":
        tri = tri.withColumn(f"c{a}", F.explode(F.sequence(corner(a, F.least), corner(a, F.greatest))))
    tri = stored(tri, "triangle-cells")
    at = places.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y"))).join(tri.select(*keys).distinct(), keys, "left_semi")
    at = stored(at, "region-points")
    parts = at.groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    at = at.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(*keys, "part", "id", "x", "y")
    tri = tri.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "part", *_TRIANGLE.names)

    def one(points: pa.Table, triangles: pa.Table) -> pa.Table:
        h = Hierarchy(triangles.column("area_id").to_numpy(), _triangles_of(triangles.column(c).to_numpy() for c in _TRIANGLE.names[1:]))
        p, area = h.containing(points.column("x").to_numpy(), points.column("y").to_numpy())
        return pa.table({"area_id": pa.array(area, pa.int64()), "id": points.column("id").to_numpy()[p]})

    return at.groupBy(*keys, "part").cogroup(tri.groupBy(*keys, "part")).applyInArrow(one, _FOUND).distinct()


def containing_regions(points: DataFrame, areas: DataFrame, id_column: str, lon: str = "lon", lat: str = "lat", block: int = BLOCK, part: int = PART) -> DataFrame:
    """(area_id, id) of each region and each point inside it; `id_column` must be unique in points."""
    spark = points.sparkSession
    cut = stored(triangles(areas), "triangles")
    places = points.select(F.col(id_column).cast("long").alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")).where(has_place(F.col("lon"), F.col("lat")))
    # outlines that run past 180 hold points by their longitude a turn further on
    x = F.col("lon") - 360 * F.floor((F.col("lon") + 180) / 360)
    if cut.count() > block:
        return _by_cells(places.select("id", F.explode(F.array(x, x + 360)).alias("x"), F.col("lat").alias("y")), cut, part)
    rows = cut.toPandas()
    tree = spark.sparkContext.broadcast(Hierarchy(rows["area_id"].to_numpy(), _triangles_of(rows[c] for c in _TRIANGLE.names[1:])))

    def run(batches):
        h = tree.value
        for batch in batches:
            ids, x, y = (batch.column(k).to_numpy() for k in range(3))
            (p, a), (q, b) = h.containing(x, y), h.containing(x + 360, y)
            both = np.unique(np.stack([np.r_[p, q], np.r_[a, b]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(ids[both[:, 0]])], names=_FOUND.names)

    return places.select("id", x.alias("x"), "lat").mapInArrow(run, _FOUND)
