"""Queries of the image-stack operators over the whole test tables, each with the SQL it is held against."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrid.functions import cplx, dates, geo
from siltgrid.operators import amplitude, coherence, correction, export, merging, near, network, pairs, patches, phasegrid, ranking, topofit, weeding
from siltgrid.session import latest, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---------------------------------------------------------------- tables

EPOCH = "TIMESTAMP '0001-01-01'"
#: Current versions: usable phases, points, estimates.
PH = f"""ph AS (SELECT ps_id, image_ix, r.s AS stack_id, r.d AS day, CAST(r.v AS DOUBLE) AS ph FROM (
  SELECT ps_id, image_ix, arg_max(struct_pack(s := stack_id, d := acq_day, v := ph_uw), coalesce(loaded_at, {EPOCH})) AS r FROM phuw2 GROUP BY ps_id, image_ix)
  WHERE r.d >= 1 AND r.v IS NOT NULL AND isfinite(r.v) AND abs(r.v) <= 500)"""
PT = f"""pt AS (SELECT ps_id, r.* FROM (SELECT ps_id, arg_max(struct_pack(stack_id := stack_id, patch_id := patch_id, az := az, rg := rg, lon := lon, lat := lat,
  x := CAST(x AS DOUBLE), y := CAST(y AS DOUBLE), d_a := d_a, hgt := CAST(hgt AS DOUBLE)), coalesce(loaded_at, {EPOCH})) AS r FROM ps2 GROUP BY ps_id))"""
SE = f"""se AS (SELECT ps_id, r.* FROM (SELECT ps_id, arg_max(struct_pack(stack_id := stack_id, k := k_ps2, c := c_ps2, coh := coh_ps2, thresh := coh_thresh), coalesce(loaded_at, {EPOCH})) AS r FROM select1 GROUP BY ps_id))"""
DAY = "SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS amp FROM events GROUP BY ALL"
IMG = f"img AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS image_ix FROM (SELECT DISTINCT day FROM ({DAY})))"


def phases(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "phuw2"), ["ps_id", "image_ix"], ["stack_id", "acq_day", "ph_uw"])
    v = F.col("ph_uw").cast("double")
    return rows.where((F.col("acq_day") >= 1) & (F.abs(v) <= 500) & ~F.isnan(v)).select("ps_id", "image_ix", "stack_id", F.col("acq_day").alias("day"), v.alias("ph"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "ps2"), ["ps_id"], ["stack_id", "patch_id", "az", "rg", "lon", "lat", "x", "y", "d_a", "hgt"])
    return rows.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "hgt")})


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "select1"), ["ps_id"], ["stack_id", "k_ps2", "c_ps2", "coh_ps2", "coh_thresh"])
    return rows.select("ps_id", "stack_id", F.col("k_ps2").alias("k"), F.col("c_ps2").alias("c"), F.col("coh_ps2").alias("coh"), F.col("coh_thresh").alias("thresh"))


def amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    """events as an amplitude stack: a point per user, an image per day."""
    day = F.to_date("ts").alias("day")
    return table(spark, sf, "events").groupBy("user_id", day).agg(F.avg("value").alias("amp"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


# ---------------------------------------------------------------- amplitude and pairs


@query(f"SELECT day, round(coalesce(avg(amp) FILTER (amp > 0.001), 0), 6) + 0.0 AS calibration FROM ({DAY}) GROUP BY day")
def calibration_constant(spark, sf):
    return amplitude.calibration(amplitudes(spark, sf), "day").withColumn("calibration", r6("calibration"))


@query(f"""WITH a AS ({DAY}), c AS (SELECT day, coalesce(avg(amp) FILTER (amp > 0.001), 0) AS cal FROM a GROUP BY day),
s AS (SELECT user_id, CASE WHEN amp / cal > 5e-5 THEN amp / cal ELSE 0 END AS v FROM a JOIN c USING (day)),
t AS (SELECT user_id, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2, min(v) AS lo FROM s GROUP BY user_id)
SELECT user_id, round(sqrt(greatest(n * s2 / (s1 * s1) - 1, 0)), 6) + 0.0 AS dispersion, round(s1, 6) + 0.0 AS sum_amp FROM t
WHERE lo > 0 AND n * s2 / (s1 * s1) - 1 < 0.36""")
def amplitude_dispersion(spark, sf):
    a = amplitudes(spark, sf)
    constants = amplitude.calibration(a, "day")
    d = amplitude.dispersion(amplitude.calibrated(a, constants, "day"), ["user_id"], threshold=0.6)
    return d.select("user_id", r6("dispersion").alias("dispersion"), r6("sum_amp").alias("sum_amp"))


PAIRS = f"{IMG}, pr AS (SELECT row_number() OVER (ORDER BY a.image_ix, b.image_ix) - 1 AS ifg_ix, a.image_ix AS img1, b.image_ix AS img2 FROM img a JOIN img b ON b.image_ix BETWEEN a.image_ix + 1 AND a.image_ix + 3)"


def _axis(spark, sf):
    return pairs.image_axis(amplitudes(spark, sf), "day")


@query(f"""WITH {PAIRS}, a AS (SELECT * FROM ({DAY}) JOIN img USING (day)),
p AS (SELECT x.user_id, x.amp AS a1, y.amp AS a2 FROM a x JOIN pr ON x.image_ix = pr.img1 JOIN a y ON y.user_id = x.user_id AND y.image_ix = pr.img2)
SELECT user_id, count(*) AS n_pairs, round(sqrt(avg((a1 - a2) ** 2)) / (sum(a1 + a2) / (2 * count(*))), 6) + 0.0 AS dispersion FROM p GROUP BY user_id
HAVING sqrt(avg((a1 - a2) ** 2)) / (sum(a1 + a2) / (2 * count(*))) < 1.2""")
def amplitude_dispersion_sb(spark, sf):
    axis = _axis(spark, sf)
    samples = amplitudes(spark, sf).join(axis, "day")
    return amplitude.dispersion_of_pairs(samples, pairs.consecutive_pairs(axis), ["user_id"], threshold=1.2).withColumn("dispersion", r6("dispersion"))


@query(f"WITH {PAIRS} SELECT ifg_ix, img1, img2 FROM pr")
def sb_pairs(spark, sf):
    return pairs.consecutive_pairs(_axis(spark, sf))


@query(f"WITH {PAIRS} SELECT ifg_ix, img1, img2, round(100 * sin(img2) - 100 * sin(img1), 6) + 0.0 AS bperp FROM pr")
def sb_pair_baseline(spark, sf):
    axis = _axis(spark, sf)
    with_b = axis.withColumn("bperp", 100 * F.sin("image_ix"))
    return pairs.pair_baselines(pairs.consecutive_pairs(axis), with_b).withColumn("bperp", r6("bperp"))


@query(f"WITH {IMG} SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT day FROM img)")
def pair_validation(spark, sf):
    wanted = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return pairs.unknown_dates(wanted, _axis(spark, sf), "day")


@query(f"""WITH {PH}, iq AS (SELECT a.ps_id, a.image_ix AS img1, b.image_ix AS img2, a.ph AS p1, b.ph AS p2 FROM ph a JOIN ph b ON a.ps_id = b.ps_id AND b.image_ix = a.image_ix + 1)
SELECT ps_id, img1, img2, round(cos(p1 - p2), 6) + 0.0 AS re, round(sin(p1 - p2), 6) + 0.0 AS im FROM iq""")
def interferograms(spark, sf):
    """Product of the first image with the conjugate of the second, for successive images of each point."""
    ph = phases(spark, sf)
    one = ph.select("ps_id", F.col("image_ix").alias("img1"), *(c.alias(n) for n, c in zip(("re1", "im1"), cplx.polar(F.col("ph")))))
    two = ph.select("ps_id", (F.col("image_ix") - 1).alias("img1"), F.col("image_ix").alias("img2"), *(c.alias(n) for n, c in zip(("re2", "im2"), cplx.polar(F.col("ph")))))
    re, im = cplx.cmul((F.col("re1"), F.col("im1")), cplx.conj((F.col("re2"), F.col("im2"))))
    return one.join(two, ["ps_id", "img1"]).select("ps_id", "img1", "img2", r6(re).alias("re"), r6(im).alias("im"))


# ---------------------------------------------------------------- geometry, patches, order

BOUNDS = patches.patch_bounds(26000, 7200, 4, 3, 200)
_values = ", ".join(str(b) for b in BOUNDS)


@query("""WITH r AS (SELECT i, i * (26000 // 4) + 1 AS a, CASE WHEN i = 3 THEN 26000 ELSE (i + 1) * (26000 // 4) END AS b FROM range(4) t(i)),
z AS (SELECT j, j * (7200 // 3) + 1 AS a, CASE WHEN j = 2 THEN 7200 ELSE (j + 1) * (7200 // 3) END AS b FROM range(3) t(j))
SELECT CAST(i * 3 + j + 1 AS INTEGER) AS patch, CAST(greatest(1, r.a - 200) AS INTEGER) AS rg1, CAST(least(26000, r.b + 200) AS INTEGER) AS rg2, CAST(greatest(1, z.a - 200) AS INTEGER) AS az1, CAST(least(7200, z.b + 200) AS INTEGER) AS az2,
  CAST(r.a AS INTEGER) AS in_rg1, CAST(r.b AS INTEGER) AS in_rg2, CAST(z.a AS INTEGER) AS in_az1, CAST(z.b AS INTEGER) AS in_az2 FROM r, z""")
def patch_bounds(spark, sf):
    return spark.createDataFrame(BOUNDS, patches.COLUMNS)


@query(f"""WITH {PT}, b AS (SELECT * FROM (VALUES {_values}) t(patch, rg1, rg2, az1, az2, in_rg1, in_rg2, in_az1, in_az2))
SELECT ps_id, az, rg, patch, az BETWEEN in_az1 AND in_az2 AND rg BETWEEN in_rg1 AND in_rg2 AS is_inner FROM pt JOIN b ON az BETWEEN az1 AND az2 AND rg BETWEEN rg1 AND rg2""")
def patch_halo_assign(spark, sf):
    return patches.assign(points(spark, sf).select("ps_id", "az", "rg"), BOUNDS)


_e2 = geo.ECCENTRICITY**2


def _m_sql(lat: str) -> str:
    terms = [f"({f!r}) * ({lat})" if k == 0 else f"({f!r}) * sin({k} * ({lat}))" for f, k in geo._meridian_terms()]
    return f"{geo.AXIS!r} * ({' + '.join(terms)})"


PLACE = "isfinite(lon) AND isfinite(lat) AND abs(lat) <= 90 AND NOT (lon = 0 AND lat = 0)"
LOCAL = f"""g AS (SELECT ps_id, stack_id, lon, lat, radians(lat) AS la, radians(ll0_lat) AS la0,
  radians(CASE WHEN lon - ll0_lon > 180 THEN lon - ll0_lon - 360 WHEN lon - ll0_lon < -180 THEN lon - ll0_lon + 360 ELSE lon - ll0_lon END) AS dl, heading FROM pt JOIN stacks USING (stack_id) WHERE {PLACE}),
h AS (SELECT *, {geo.AXIS!r} / sqrt(1 - {_e2!r} * sin(la) ** 2) * cos(la) / sin(la) AS nc FROM g),
loc AS (SELECT ps_id, stack_id, heading, nc * sin(dl * sin(la)) AS x, {_m_sql('la')} - {_m_sql('la0')} + nc * (1 - cos(dl * sin(la))) AS y FROM h)"""


def _local(spark, sf) -> DataFrame:
    pt = points(spark, sf).where(near.has_place(F.col("lon"), F.col("lat"))).join(table(spark, sf, "stacks"), "stack_id")
    d = F.col("lon") - F.col("ll0_lon")
    lon = F.col("ll0_lon") + F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    x, y = geo.local_metres(lon, F.col("lat"), F.col("ll0_lon"), F.col("ll0_lat"))
    return pt.select("ps_id", "stack_id", "heading", x.alias("x"), y.alias("y"))


@query(f"WITH {PT}, {LOCAL} SELECT ps_id, round_even(x, 3) + 0.0 AS x, round_even(y, 3) + 0.0 AS y FROM loc")
def llh_to_local(spark, sf):
    return _local(spark, sf).select("ps_id", (geo.to_millimetres(F.col("x")) + 0.0).alias("x"), (geo.to_millimetres(F.col("y")) + 0.0).alias("y"))


@query(f"""WITH {PT}, {LOCAL}, a AS (SELECT *, CASE WHEN radians(180 - heading) > pi() THEN radians(180 - heading) - 2 * pi() ELSE radians(180 - heading) END AS t FROM loc),
r AS (SELECT *, cos(t) * x + sin(t) * y AS rx, -sin(t) * x + cos(t) * y AS ry FROM a),
b AS (SELECT stack_id, max(rx) - min(rx) < max(x) - min(x) AND max(ry) - min(ry) < max(y) - min(y) AS is_rotated FROM r GROUP BY stack_id)
SELECT ps_id, is_rotated, round(CASE WHEN is_rotated THEN rx ELSE x END, 3) + 0.0 AS x, round(CASE WHEN is_rotated THEN ry ELSE y END, 3) + 0.0 AS y FROM r JOIN b USING (stack_id)""")
def heading_rotation(spark, sf):
    p = _local(spark, sf).withColumn("angle", geo.heading_angle(F.col("heading")))
    return geo.rotated(p, ["stack_id"]).select("ps_id", "is_rotated", r6("x", 3).alias("x"), r6("y", 3).alias("y"))


@query(f"WITH {PT} SELECT ps_id, row_number() OVER (ORDER BY y NULLS FIRST, x NULLS FIRST, ps_id) - 1 AS sort_id FROM pt")
def sort_ids(spark, sf):
    """Numbers of all points in order of y, then x: ranks over range partitions, not one window."""
    return ranking.distributed_rank(points(spark, sf).select("ps_id", "x", "y"), [], [F.col("y"), F.col("x"), F.col("ps_id")], "sort_id").select("ps_id", "sort_id")


@query(f"WITH {PT} SELECT stack_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, (min(x) + max(x)) / 2 AS x_mid, (min(y) + max(y)) / 2 AS y_mid FROM pt GROUP BY stack_id")
def bounding_box(spark, sf):
    mid = lambda c: ((F.min(c) + F.max(c)) / 2)
    return points(spark, sf).groupBy("stack_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), mid("x").alias("x_mid"), mid("y").alias("y_mid"))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163 AS ordinal, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 719529 AS serial,
CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS yyyymmdd FROM orders""")
def date_serials(spark, sf):
    day = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return day.select("day", dates.ordinal(F.col("day")).alias("ordinal"), dates.serial(F.col("day")).alias("serial"), dates.yyyymmdd(F.col("day")).alias("yyyymmdd"))


# ---------------------------------------------------------------- grids and statistics

CELLS = """lim AS (SELECT stack_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM pt GROUP BY stack_id),
cl0 AS (SELECT pt.ps_id, stack_id, ceil((y - y0 + 1e-6) / 200) AS i, ceil((x - x0 + 1e-6) / 200) AS j, ceil((y1 - y0 + 1e-6) / 200) AS im, ceil((x1 - x0 + 1e-6) / 200) AS jm FROM pt JOIN lim USING (stack_id)),
cl AS (SELECT ps_id, stack_id, CAST(CASE WHEN i = im AND im > 1 THEN i - 1 ELSE i END - 1 AS INTEGER) AS gi, CAST(CASE WHEN j = jm AND jm > 1 THEN j - 1 ELSE j END - 1 AS INTEGER) AS gj FROM cl0)"""


@query(f"""WITH {PT}, {PH}, {CELLS} SELECT cl.stack_id, ph.image_ix, gi, gj, round(sum(cos(ph)), 5) + 0.0 AS re, round(sum(sin(ph)), 5) + 0.0 AS im, count(*) AS n
FROM ph JOIN cl USING (ps_id) GROUP BY cl.stack_id, ph.image_ix, gi, gj""")
def grid_accumulate(spark, sf):
    """Complex phase summed in cells of 200 m for each image."""
    cells = phasegrid.with_cells(points(spark, sf).select("ps_id", "stack_id", "x", "y"), ["stack_id"], 200.0).select("ps_id", "stack_id", "gi", "gj")
    rows = phases(spark, sf).drop("stack_id").join(cells, "ps_id")
    g = phasegrid.accumulate(rows, ["stack_id", "image_ix", "gi", "gj"], "ph")
    return g.select("stack_id", "image_ix", "gi", "gj", r6("re", 5).alias("re"), r6("im", 5).alias("im"), "n")


HIST = "hi AS (SELECT stack_id, CAST(least(floor(coh * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM se WHERE coh >= 0 AND coh <= 1 AND NOT isnan(coh) GROUP BY ALL)"


@query(f"WITH {SE}, {HIST} SELECT * FROM hi")
def coh_histogram(spark, sf):
    return coherence.histogram(estimates(spark, sf), ["stack_id"], "coh")


@query(f"""WITH {SE}, {HIST}, al AS (SELECT bin, sum(n) AS n_all FROM hi GROUP BY bin), j AS (SELECT stack_id, bin, n, n_all FROM hi JOIN al USING (bin)),
s AS (SELECT stack_id, bin, sum(n) OVER w AS above, sum(n_all) OVER w AS above_all FROM j WINDOW w AS (PARTITION BY stack_id ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))
SELECT stack_id, bin, CAST(above AS BIGINT) AS above, round(above / above_all, 6) + 0.0 AS ratio FROM s""")
def reverse_cumulative_ratio(spark, sf):
    """Share of the points at or above each coherence bin that a stack has among all stacks."""
    h = coherence.histogram(estimates(spark, sf), ["stack_id"], "coh")
    whole = h.groupBy("bin").agg(F.sum("n").alias("n_all"))
    s = coherence.survival(h.join(whole, "bin"), ["stack_id"])
    s = coherence.survival(s.withColumnRenamed("above", "a"), ["stack_id"], "n_all").withColumnRenamed("above", "b")
    return s.select("stack_id", "bin", F.col("a").alias("above"), r6(F.col("a") / F.col("b")).alias("ratio"))


@query("""WITH v AS (SELECT l_linenumber AS line, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
t AS (SELECT line, count(*) AS n, max(v) AS most FROM v GROUP BY line), k AS (SELECT line, v, row_number() OVER (PARTITION BY line ORDER BY v) AS rn FROM v)
SELECT line, v AS edge FROM k JOIN t USING (line) WHERE n >= 10000 AND rn % (CASE WHEN n >= 50000 THEN 10000 ELSE 2000 END) = 0 AND rn <= n - (CASE WHEN n >= 50000 THEN 10000 ELSE 2000 END)
UNION ALL SELECT line, 0.0 FROM t UNION ALL SELECT line, CASE WHEN n >= 10000 THEN most ELSE 1.0 END FROM t""")
def da_bins(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("v"))
    return coherence.dispersion_edges(rows, ["line"], "v")


@query(f"WITH {PT}, {SE} SELECT se.ps_id, coh, d_a FROM se JOIN pt USING (ps_id) WHERE coh <= 1 AND d_a IS NOT NULL AND NOT isnan(d_a) AND coh > 0.3 + 0.2 * d_a AND NOT isnan(coh)")
def coh_threshold_apply(spark, sf):
    """Points above a coherence threshold that grows with the amplitude dispersion."""
    j = estimates(spark, sf).join(points(spark, sf).select("ps_id", "d_a"), "ps_id")
    ok = ~F.isnan("coh") & ~F.isnan("d_a") & (F.col("coh") <= 1) & (F.col("coh") > 0.3 + 0.2 * F.col("d_a"))
    return j.where(ok).select("ps_id", "coh", "d_a")


@query(f"WITH {SE} SELECT ps_id, k, coh, thresh FROM se WHERE coh > thresh AND coh <= 1 AND abs(k - 0.005) < 0.01 AND NOT isnan(k) AND NOT isnan(coh)")
def keep_rule(spark, sf):
    """Re-estimated points that stay: above their threshold and close to the former look-angle error (here a constant)."""
    ok = (F.col("coh") > F.col("thresh")) & (F.col("coh") <= 1) & (F.abs(F.col("k") - 0.005) < 0.01) & ~F.isnan("k") & ~F.isnan("coh")
    return estimates(spark, sf).where(ok).select("ps_id", "k", "coh", "thresh")


@query(f"WITH {PH} SELECT ps_id, image_ix, round(ph, 6) + 0.0 AS ph FROM ph WHERE image_ix NOT IN (2, 5, 11)")
def drop_ifg(spark, sf):
    """Phases without the images of a drop list: an anti-join on a constant list."""
    dropped = spark.createDataFrame([(2,), (5,), (11,)], "image_ix int")
    return phases(spark, sf).join(dropped, "image_ix", "left_anti").select("ps_id", "image_ix", r6("ph").alias("ph"))


@query(f"WITH {PT} SELECT ps_id, hgt FROM pt WHERE hgt >= 300 AND NOT isnan(hgt)")
def elevation_weed(spark, sf):
    """Points without those below a height."""
    return points(spark, sf).where((F.col("hgt") >= 300) & ~F.isnan("hgt")).select("ps_id", "hgt")


@query(f"""WITH {PH}, {PT} SELECT stack_id, image_ix, round(sqrt(avg(a * a)) * 180 / pi(), 5) + 0.0 AS ifg_std, count(*) AS n
FROM (SELECT stack_id, image_ix, atan2(sin(ph), cos(ph)) AS a FROM ph) GROUP BY stack_id, image_ix""")
def ifg_noise_std(spark, sf):
    """Circular root mean square of each image's phase in degrees."""
    a = cplx.wrap(F.col("ph"))
    rows = phases(spark, sf).select("stack_id", "image_ix", a.alias("a"))
    return rows.groupBy("stack_id", "image_ix").agg(r6(F.sqrt(F.avg(F.col("a") * F.col("a"))) * 180 / math.pi, 5).alias("ifg_std"), F.count("*").alias("n"))


@query(f"""WITH {PH} SELECT ps_id, count(*) AS n, round(var_samp(ph), 6) + 0.0 AS variance, round(stddev_samp(ph), 6) + 0.0 AS deviation, round(median(ph), 6) + 0.0 AS middle FROM ph GROUP BY ps_id HAVING count(*) > 1""")
def sample_variance(spark, sf):
    g = phases(spark, sf).groupBy("ps_id").agg(F.count("*").alias("n"), F.var_samp("ph").alias("v"), F.stddev_samp("ph").alias("s"), F.median("ph").alias("m"))
    return g.where("n > 1").select("ps_id", "n", r6("v").alias("variance"), r6("s").alias("deviation"), r6("m").alias("middle"))


@query(f"""WITH {PT}, {PH}, {CELLS}, gr AS (SELECT cl.stack_id, ph.image_ix, gi, gj, avg(ph) AS v FROM ph JOIN cl USING (ps_id) GROUP BY ALL),
d AS (SELECT stack_id, image_ix, v - lag(v) OVER (PARTITION BY stack_id, image_ix, gi ORDER BY gj) AS d FROM gr
      UNION ALL SELECT stack_id, image_ix, v - lag(v) OVER (PARTITION BY stack_id, image_ix, gj ORDER BY gi) FROM gr)
SELECT stack_id, image_ix, round(avg(d * d), 5) + 0.0 AS msd, count(*) AS n FROM d WHERE d IS NOT NULL AND abs(d) > 1e-9 GROUP BY ALL""")
def mean_squared_gradient(spark, sf):
    """Mean squared non-zero difference between successive filled cells along rows and columns of each image's grid."""
    from pyspark.sql import Window

    cells = phasegrid.with_cells(points(spark, sf).select("ps_id", "stack_id", "x", "y"), ["stack_id"], 200.0).select("ps_id", "stack_id", "gi", "gj")
    g = phases(spark, sf).drop("stack_id").join(cells, "ps_id").groupBy("stack_id", "image_ix", "gi", "gj").agg(F.avg("ph").alias("v"))
    along = lambda a, b: F.col("v") - F.lag("v").over(Window.partitionBy("stack_id", "image_ix", a).orderBy(b))
    d = g.select("stack_id", "image_ix", along("gi", "gj").alias("a"), along("gj", "gi").alias("b"))
    d = d.select("stack_id", "image_ix", F.explode(F.array("a", "b")).alias("d")).where(F.abs("d") > 1e-9)
    return d.groupBy("stack_id", "image_ix").agg(r6(F.avg(F.col("d") * F.col("d")), 5).alias("msd"), F.count("*").alias("n"))


@query("SELECT round(avg(l_discount) FILTER (l_discount NOT IN (0.0, 0.05)), 6) + 0.0 AS mean, count(*) FILTER (l_discount NOT IN (0.0, 0.05)) AS n FROM lineitem WHERE l_orderkey % 3 = 0")
def strided_band_mean(spark, sf):
    """Finite mean of every third line of a band without its sentinel values; the stride is the operator's own parameter."""
    v = F.when(~F.col("l_discount").isin(0.0, 0.05) & ~F.isnan("l_discount"), F.col("l_discount"))
    return table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").agg(r6(F.avg(v)).alias("mean"), F.count(v).alias("n"))


# ---------------------------------------------------------------- trial search

BASELINE = [(k % 16 - 7.5) * 20 for k in range(64)]
_EMB = """e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) * CAST(6 AS DOUBLE) AS p FROM embeddings),
z AS (SELECT vec_id, i, p, (i % 16 - 7.5) * 20.0 AS b, cos(p) AS re, sin(p) AS im FROM e),
t AS (SELECT unnest(range(-8, 9)) AS t),
tr AS (SELECT vec_id, t, sqrt(sum(cos(p - b / 300.0 * pi() / 4 * t)) ** 2 + sum(sin(p - b / 300.0 * pi() / 4 * t)) ** 2) / 64 AS coh FROM z, t GROUP BY vec_id, t),
bt AS (SELECT vec_id, arg_max(t, round(coh, 9) - t * 1e-12) AS t FROM tr GROUP BY vec_id),
r0 AS (SELECT vec_id, t, sum(cos(p - pi() / 4 / 300.0 * t * b)) AS ore, sum(sin(p - pi() / 4 / 300.0 * t * b)) AS oim FROM z JOIN bt USING (vec_id) GROUP BY vec_id, t),
k AS (SELECT vec_id, r0.t, pi() / 4 / 300.0 * r0.t + sum(b * atan2(sin(p - pi() / 4 / 300.0 * r0.t * b - atan2(oim, ore)), cos(p - pi() / 4 / 300.0 * r0.t * b - atan2(oim, ore)))) / sum(b * b) AS k FROM z JOIN r0 USING (vec_id) GROUP BY vec_id, r0.t),
f AS (SELECT vec_id, t, k, sum(cos(p - k * b)) AS re, sum(sin(p - k * b)) AS im FROM z JOIN k USING (vec_id) GROUP BY vec_id, t, k)"""


def _fitted(spark, sf):
    p = vectors(spark, sf).select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 6.0).alias("ph"))
    return topofit.fit_points(p, "vec_id", "ph", BASELINE, wraps=1.0)


@query(f"WITH {_EMB} SELECT vec_id, CAST(t AS INTEGER) AS trial FROM bt")
def topofit_trials(spark, sf):
    return _fitted(spark, sf).select("vec_id", F.col("trial").cast("int").alias("trial"))


@query(f"WITH {_EMB} SELECT vec_id, round(k, 6) + 0.0 AS k, round(sqrt(re * re + im * im) / 64, 6) + 0.0 AS coh, round(cos(atan2(im, re)), 5) + 0.0 AS cos_c FROM f")
def topofit_refine(spark, sf):
    return _fitted(spark, sf).select("vec_id", r6("k").alias("k"), r6("coh").alias("coh"), r6(F.cos("c"), 5).alias("cos_c"))


@query(f"WITH {_EMB} SELECT vec_id, round(sqrt(avg(atan2(sin(p - k * b - atan2(f.im, f.re)), cos(p - k * b - atan2(f.im, f.re))) ** 2)), 5) + 0.0 AS rms FROM z JOIN f USING (vec_id) GROUP BY vec_id")
def topofit_residual(spark, sf):
    """Root mean square of each point's residual phase."""
    sq = F.aggregate("residual", F.lit(0.0), lambda t, x: t + x * x)
    return _fitted(spark, sf).select("vec_id", r6(F.sqrt(sq / F.size("residual")), 5).alias("rms"))


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * CAST(6 AS DOUBLE) AS p FROM embeddings), z AS (SELECT vec_id, cos(p) AS re, sin(p) AS im FROM e)
SELECT vec_id, round(sqrt(sum(re) ** 2 + sum(im) ** 2) / count(*), 6) + 0.0 AS coh FROM z GROUP BY vec_id""")
def point_coherence(spark, sf):
    """|sum z| / sum |z| of each point, folded over its array in the JVM."""
    p = F.transform("embedding", lambda v: v.cast("double") * 6.0)
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda t, x: t + f(x))
    return vectors(spark, sf).select("vec_id", r6(coherence.coherence(total(F.cos), total(F.sin), F.size("embedding"))).alias("coh"))


@query(f"""WITH {_EMB}, q AS (SELECT vec_id, abs(p) AS a, cos(p - k * b - atan2(im, re)) AS c FROM (SELECT z.vec_id, p, b, k, f.re, f.im FROM z JOIN f USING (vec_id)) AS z)
SELECT vec_id, round(avg(a * c) / sqrt(0.5 * (avg(a * a) - avg(a * c) ** 2)), 5) + 0.0 AS snr FROM q GROUP BY vec_id""")
def snr_weight(spark, sf):
    """Signal over noise of each point, with the size of its samples as amplitude."""
    a = vectors(spark, sf).select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double") * 6.0)).alias("a"))
    j = _fitted(spark, sf).select("vec_id", "residual").join(a, "vec_id")
    n = F.size("a")
    g = F.aggregate(F.zip_with("a", "residual", lambda x, r: x * F.cos(r)), F.lit(0.0), lambda t, x: t + x) / n
    m = F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x) / n
    return j.select("vec_id", r6(g / F.sqrt(0.5 * (m - g * g)), 5).alias("snr"))


# ---------------------------------------------------------------- neighbours

ARCS = """px AS (SELECT stack_id, az, rg, min(ps_id) AS id FROM (SELECT stack_id, az // 8 AS az, rg // 8 AS rg, ps_id FROM pt WHERE az IS NOT NULL AND rg IS NOT NULL) GROUP BY ALL),
ar AS (SELECT a.id, b.id AS other FROM px a JOIN px b ON a.stack_id = b.stack_id AND abs(a.az - b.az) <= 1 AND abs(a.rg - b.rg) <= 1 AND a.id <> b.id)"""


def _pixels(spark, sf):
    p = points(spark, sf).select("stack_id", F.floor(F.col("az") / 8).cast("int").alias("az"), F.floor(F.col("rg") / 8).cast("int").alias("rg"), "ps_id").where("az is not null and rg is not null")
    return p.groupBy("stack_id", "az", "rg").agg(F.min("ps_id").alias("id"))


def _arcs(spark, sf):
    return weeding.neighbour_arcs(_pixels(spark, sf), ["stack_id"], "id")


@query(f"WITH {PT}, {ARCS} SELECT id, min(other) AS owner FROM ar GROUP BY id")
def neighbour_owner(spark, sf):
    """Least of each pixel's eight neighbours (pixels of eight lines by eight columns)."""
    return weeding.owners(_arcs(spark, sf))


WEED = f"""{ARCS}, ow AS (SELECT id, min(other) AS owner FROM ar GROUP BY id), ed AS (SELECT id AS a, owner AS b FROM ow UNION SELECT owner, id FROM ow),
rc AS (SELECT a AS n, a AS m FROM ed UNION SELECT rc.n, ed.b FROM rc JOIN ed ON ed.a = rc.m), lab AS (SELECT n AS node, min(m) AS component FROM rc GROUP BY n)"""


@query(f"WITH RECURSIVE {PT}, {WEED} SELECT node, component FROM lab")
def adjacent_groups(spark, sf):
    return weeding.adjacent_groups(_arcs(spark, sf))


@query(f"""WITH RECURSIVE {PT}, {SE}, {WEED}, s AS (SELECT px.id, coalesce(component, px.id) AS g, CASE WHEN isnan(coh) OR coh IS NULL THEN -1e308 ELSE coh END AS c FROM px LEFT JOIN lab ON lab.node = px.id LEFT JOIN se ON se.ps_id = px.id)
SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY c DESC, id) = 1""")
def adjacent_weed(spark, sf):
    """Pixels left when each group of adjacent ones keeps its most coherent."""
    p = _pixels(spark, sf).join(estimates(spark, sf).select(F.col("ps_id").alias("id"), "coh"), "id", "left")
    return weeding.weed_adjacent(p, ["stack_id"], "id", "coh").select("id")


@query("""SELECT l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def dedup_max_coh(spark, sf):
    """For each key the row with the highest score; ties go to the first in key order. One aggregation, no window."""
    order = F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))
    best = F.max_by(F.struct("l_extendedprice", "l_orderkey", "l_linenumber"), order)
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(best.alias("b")).select("l_partkey", "l_suppkey", "b.*")


@query(f"WITH {PT}, {PH}, {ARCS} SELECT ar.id, ar.other, a.image_ix, round(b.ph - a.ph, 6) + 0.0 AS d FROM ar JOIN ph a ON a.ps_id = ar.id JOIN ph b ON b.ps_id = ar.other AND b.image_ix = a.image_ix WHERE ar.id < ar.other")
def arc_diff(spark, sf):
    """Phase difference along each arc and image: two equi-joins on the arcs."""
    ph, arcs = phases(spark, sf), _arcs(spark, sf).where("id < other")
    a = ph.select(F.col("ps_id").alias("id"), "image_ix", F.col("ph").alias("a"))
    b = ph.select(F.col("ps_id").alias("other"), "image_ix", F.col("ph").alias("b"))
    return arcs.join(a, "id").join(b, ["other", "image_ix"]).select("id", "other", "image_ix", r6(F.col("b") - F.col("a")).alias("d"))


@query(f"WITH {PT}, {SE}, {ARCS} SELECT ar.id, min(k) AS least, max(k) AS most FROM ar JOIN se ON se.ps_id = ar.other WHERE k IS NOT NULL AND NOT isnan(k) GROUP BY ar.id")
def arc_min_scatter(spark, sf):
    """Least and greatest value over each pixel's neighbours."""
    v = estimates(spark, sf).where("k is not null and not isnan(k)").select(F.col("ps_id").alias("id"), "k")
    return weeding.scatter(_arcs(spark, sf), v, "k")


@query(f"""WITH {PT}, {SE}, {ARCS}, v AS (SELECT px.id, k FROM px JOIN se ON se.ps_id = px.id WHERE k IS NOT NULL AND NOT isnan(k)),
m AS (SELECT ar.id, min(k) AS lo, max(k) AS hi FROM ar JOIN v ON v.id = ar.other GROUP BY ar.id)
SELECT v.id, v.k, CASE WHEN lo IS NULL THEN k ELSE least(greatest(k, lo), hi) END AS k_smooth FROM v LEFT JOIN m USING (id)""")
def neighbour_clip(spark, sf):
    v = _pixels(spark, sf).select("id").join(estimates(spark, sf).select(F.col("ps_id").alias("id"), "k"), "id").where("k is not null and not isnan(k)")
    return weeding.clip_to_neighbours(v, _arcs(spark, sf), "k")


# ---------------------------------------------------------------- phase correction

#: Baseline of an image of a point, for want of orbits: a fixed function of its number.
B_SQL, B_COL = "100 * sin(image_ix * 1.3)", lambda: 100 * F.sin(F.col("image_ix") * 1.3)


@query(f"""WITH {PH}, {SE} SELECT ph.ps_id, image_ix, round(cos(ph - (k * {B_SQL} + c)), 6) + 0.0 AS re, round(sin(ph - (k * {B_SQL} + c)), 6) + 0.0 AS im FROM ph JOIN se USING (ps_id)
WHERE k IS NOT NULL AND c IS NOT NULL AND NOT isnan(k) AND NOT isnan(c)""")
def phase_correct_ps(spark, sf):
    """Phase less look-angle error and master noise: ph * exp(-i (K B + C))."""
    return _corrected(spark, sf, F.col("k") * B_COL() + F.col("c"))


@query(f"""WITH {PH}, {SE} SELECT ph.ps_id, image_ix, round(cos(ph - k * {B_SQL}), 6) + 0.0 AS re, round(sin(ph - k * {B_SQL}), 6) + 0.0 AS im FROM ph JOIN se USING (ps_id)
WHERE k IS NOT NULL AND c IS NOT NULL AND NOT isnan(k) AND NOT isnan(c)""")
def phase_correct_sb(spark, sf):
    """Phase less look-angle error only, as for pairs."""
    return _corrected(spark, sf, F.col("k") * B_COL())


def _corrected(spark, sf, error: Column) -> DataFrame:
    e = estimates(spark, sf).where("k is not null and c is not null and not isnan(k) and not isnan(c)").select("ps_id", "k", "c")
    re, im = cplx.cmul(cplx.polar(F.col("ph")), cplx.conj(cplx.polar(error)))
    return phases(spark, sf).join(e, "ps_id").select("ps_id", "image_ix", r6(re).alias("re"), r6(im).alias("im"))


@query(f"""WITH {PH} SELECT ps_id, image_ix, round(cos(ph), 6) + 0.0 AS re, round(sin(ph), 6) + 0.0 AS im FROM ph JOIN stacks USING (stack_id) WHERE image_ix <> master_ix
UNION ALL SELECT DISTINCT ps_id, master_ix, 1.0, 0.0 FROM ph JOIN stacks USING (stack_id)""")
def rereference(spark, sf):
    """Unit phases with the reference image put back as 1."""
    ph = phases(spark, sf).join(table(spark, sf, "stacks").select("stack_id", "master_ix"), "stack_id")
    re, im = cplx.polar(F.col("ph"))
    rest = ph.where("image_ix <> master_ix").select("ps_id", "image_ix", r6(re).alias("re"), r6(im).alias("im"))
    ref = ph.select("ps_id", F.col("master_ix").alias("image_ix")).distinct().select("ps_id", "image_ix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return rest.unionByName(ref)


@query(f"WITH {PH} SELECT ps_id, image_ix, round(atan2(sin(ph), cos(ph)), 6) + 0.0 AS wrapped, round(-ph * wavelength * 1000 / (4 * pi()), 6) + 0.0 AS mm FROM ph JOIN stacks USING (stack_id)")
def phase_to_mm(spark, sf):
    """Wrapped phase, and millimetres of each phase."""
    ph = phases(spark, sf).join(table(spark, sf, "stacks").select("stack_id", "wavelength"), "stack_id")
    return ph.select("ps_id", "image_ix", r6(cplx.wrap(F.col("ph"))).alias("wrapped"), r6(export.phase_to_mm(F.col("ph"), F.col("wavelength"))).alias("mm"))


# ---------------------------------------------------------------- merging

MRG = f"""{PT}, {SE}, bd AS (SELECT * FROM (VALUES {_values}) t(patch, rg1, rg2, az1, az2, in_rg1, in_rg2, in_az1, in_az2)),
pp AS (SELECT ps_id, pt.stack_id, az, rg, lon, lat, x, y, patch, az BETWEEN in_az1 AND in_az2 AND rg BETWEEN in_rg1 AND in_rg2 AS is_inner,
  CASE WHEN coh >= 0 AND coh <= 1 AND NOT isnan(coh) THEN coh END AS coh FROM pt JOIN bd ON az BETWEEN az1 AND az2 AND rg BETWEEN rg1 AND rg2 LEFT JOIN se USING (ps_id) WHERE {PLACE})"""


def _patched(spark, sf):
    pt = points(spark, sf).where(near.has_place(F.col("lon"), F.col("lat"))).select("ps_id", "stack_id", "az", "rg", "lon", "lat", "x", "y")
    coh = F.when(F.col("coh").between(0, 1) & ~F.isnan("coh"), F.col("coh"))
    e = estimates(spark, sf).select("ps_id", coh.alias("coh"))
    return patches.assign(pt, BOUNDS).join(e, "ps_id", "left")


@query(f"""WITH {MRG}, w AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY stack_id, az, rg ORDER BY CASE WHEN is_inner THEN 0 ELSE 1 END, patch, coalesce(coh, -1e308) DESC, ps_id) = 1)
SELECT ps_id, az, rg, patch, is_inner FROM w QUALIFY row_number() OVER (PARTITION BY stack_id, lon, lat ORDER BY coalesce(coh, -1e308) DESC, ps_id) = 1""")
def merge_no_resample(spark, sf):
    return merging.merge_points(_patched(spark, sf), ["stack_id"], "coh", "ps_id").select("ps_id", "az", "rg", "patch", "is_inner")


@query(f"""WITH {MRG}, q AS (SELECT *, least(greatest(coh, 0), {merging.attainable_coherence()!r}) AS cc FROM pp WHERE is_inner AND coh IS NOT NULL),
c AS (SELECT stack_id, patch, min(y) AS y0, min(x) AS x0 FROM q GROUP BY ALL),
s AS (SELECT q.stack_id, q.patch, ceil((y - y0 + 1e-9) / 500) AS ci, ceil((x - x0 + 1e-9) / 500) AS cj, lon, lat, CASE WHEN cc > 0 THEN 1 / (1 / (cc * cc) - 1) ELSE 0 END AS snr FROM q JOIN c ON q.stack_id = c.stack_id AND q.patch = c.patch)
SELECT stack_id, patch, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, count(*) AS n, round(avg(lon), 7) + 0.0 AS lon, round(avg(lat), 7) + 0.0 AS lat,
round(CASE WHEN sum(snr * snr) > 0 THEN sqrt(1 / (1 + 1 / sqrt(sum(snr * snr)))) ELSE 0 END, 6) + 0.0 AS coh FROM s GROUP BY ALL""")
def merge_resample(spark, sf):
    rows = _patched(spark, sf).where("is_inner and coh is not null")
    m = merging.resample(rows, ["stack_id", "patch"], 500.0, "coh", ["lon", "lat"])
    return m.select("stack_id", "patch", "ci", "cj", "n", r6("lon", 7).alias("lon"), r6("lat", 7).alias("lat"), r6("coh").alias("coh"))


# ---------------------------------------------------------------- inversion

N_IMAGES = 6
NETWORK = [(i, j) for i in range(N_IMAGES) for j in range(i + 1, min(N_IMAGES, i + 3))]
INVERSE = network.inverse(NETWORK, N_IMAGES)
_x_sql = ", ".join("round(" + " + ".join(f"({w!r}) * p[{k + 1}]" for k, w in enumerate(row)) + f", 6) + 0.0 AS x{i}" for i, row in enumerate(INVERSE.tolist()))


def _pair_phases(spark, sf):
    e = lambda k: F.col("embedding")[k].cast("double")
    single = lambda k: F.col("embedding")[k]
    p = [(single(j) - single(i)).cast("double") + 0.1 * e((i + j) % 64 + 6) for i, j in NETWORK]
    return vectors(spark, sf).select("vec_id", F.array(*p).alias("p"))


_pairs_sql = ", ".join(f"CAST(embedding[{j + 1}] - embedding[{i + 1}] AS DOUBLE) + 0.1::DOUBLE * CAST(embedding[{(i + j) % 64 + 7}] AS DOUBLE)" for i, j in NETWORK)


@query(f"SELECT vec_id, {_x_sql} FROM (SELECT vec_id, [{_pairs_sql}] AS p FROM embeddings)")
def sb_invert(spark, sf):
    """Image phases from pair phases by the pseudo-inverse of the network, the reference at 0."""
    x = _pair_phases(spark, sf).withColumn("x", network.invert("p", INVERSE))
    return x.select("vec_id", *(r6(F.col("x")[k]).alias(f"x{k}") for k in range(N_IMAGES)))


_res = network.design(NETWORK, N_IMAGES) @ INVERSE - np.eye(len(NETWORK))
_r_sql = " + ".join("(" + " + ".join(f"({w!r}) * p[{k + 1}]" for k, w in enumerate(row)) + ") ** 2" for row in _res.tolist())


@query(f"SELECT vec_id, round(sqrt(({_r_sql}) / {len(NETWORK)}), 6) + 0.0 AS rms FROM (SELECT vec_id, [{_pairs_sql}] AS p FROM embeddings)")
def sb_residual(spark, sf):
    """Root mean square of what the inverted images leave of the pairs."""
    x = _pair_phases(spark, sf).withColumn("r", network.invert("p", _res))
    sq = F.aggregate("r", F.lit(0.0), lambda t, v: t + v * v)
    return x.select("vec_id", r6(F.sqrt(sq / len(NETWORK))).alias("rms"))


@query("SELECT vec_id, 0.0 AS worst FROM embeddings")
def sb_normal_equations(spark, sf):
    """What the inversion leaves must be orthogonal to the network: its largest sum around an image, and the reference's own phase."""
    g = network.design(NETWORK, N_IMAGES)
    left = (g.T @ (g @ INVERSE - np.eye(len(NETWORK))))[1:]
    x = _pair_phases(spark, sf).withColumn("n", network.invert("p", left)).withColumn("x", network.invert("p", INVERSE))
    worst = F.greatest(F.array_max(F.transform("n", F.abs)), F.abs(F.col("x")[0]))
    return x.select("vec_id", r6(worst).alias("worst"))


# ---------------------------------------------------------------- correlated error


@query(f"""WITH {PH}, s AS (SELECT ps_id, image_ix, ph - lag(ph) OVER w AS d_ph, day - lag(day) OVER w AS d_day FROM ph WINDOW w AS (PARTITION BY ps_id ORDER BY image_ix))
SELECT ps_id, image_ix, round(d_ph, 6) + 0.0 AS d_ph, d_day FROM s WHERE d_ph IS NOT NULL""")
def seq_diff(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("ps_id").orderBy("image_ix")
    d = phases(spark, sf).select("ps_id", "image_ix", (F.col("ph") - F.lag("ph").over(w)).alias("d"), (F.col("day") - F.lag("day").over(w)).alias("d_day"))
    return d.where("d is not null").select("ps_id", "image_ix", r6("d").alias("d_ph"), "d_day")


SCLA = f"""{PH}, d AS (SELECT ps_id, ph - lag(ph) OVER w AS p, {B_SQL} - lag({B_SQL}) OVER w AS b, CAST(day - lag(day) OVER w AS DOUBLE) AS t FROM ph WINDOW w AS (PARTITION BY ps_id ORDER BY image_ix)),
m AS (SELECT ps_id, CAST(count(*) AS DOUBLE) AS n, sum(b) AS sb, sum(t) AS st, sum(b * b) AS sbb, sum(b * t) AS sbt, sum(t * t) AS stt, sum(p) AS sp, sum(p * b) AS spb, sum(p * t) AS spt FROM d WHERE p IS NOT NULL GROUP BY ps_id),
sc AS (SELECT ps_id, CAST(n AS BIGINT) AS n, n * (sbb * stt - sbt * sbt) - sb * (sb * stt - sbt * st) + st * (sb * sbt - sbb * st) AS det,
  n * (spb * stt - sbt * spt) - sp * (sb * stt - sbt * st) + st * (sb * spt - spb * st) AS num FROM m WHERE n >= 4)"""


def _k(spark, sf):
    return correction.look_angle_error(phases(spark, sf).withColumn("b", B_COL()), "ps_id", "image_ix", "ph", "b", "day")


@query(f"WITH {SCLA} SELECT ps_id, round(num / det, 6) + 0.0 AS k, n FROM sc WHERE abs(det) > 1e3")
def scla_k(spark, sf):
    """Look-angle error of each point from its successive phase differences."""
    return _k(spark, sf).where("k is not null").select("ps_id", r6("k").alias("k"), "n")


@query(f"WITH {SCLA} SELECT ph.ps_id, image_ix, round(num / det * {B_SQL}, 5) + 0.0 AS ph_scla FROM ph JOIN sc USING (ps_id) WHERE abs(det) > 1e3")
def scla_phase(spark, sf):
    """Phase of the look-angle error in each image."""
    return phases(spark, sf).join(_k(spark, sf).where("k is not null"), "ps_id").select("ps_id", "image_ix", r6(F.col("k") * B_COL(), 5).alias("ph_scla"))


RAMP = f"""{PT}, {PH}, s AS (SELECT pt.stack_id, image_ix, ph.ps_id, ph, x / 1000 AS x, y / 1000 AS y FROM ph JOIN pt USING (ps_id) WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
a AS (SELECT stack_id, image_ix, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(ph) AS mp, covar_pop(x, y) AS cxy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, ph) AS cxp, covar_pop(y, ph) AS cyp FROM s GROUP BY ALL),
b AS (SELECT *, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN (cxp * vy - cyp * cxy) / (vx * vy - cxy * cxy) ELSE 0 END AS rx, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN (cyp * vx - cxp * cxy) / (vx * vy - cxy * cxy) ELSE 0 END AS ry FROM a WHERE n > 5)"""


def _placed_phases(spark, sf):
    p = points(spark, sf).where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("ps_id", F.col("stack_id").alias("stack_id"), (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))
    return phases(spark, sf).drop("stack_id").join(p, "ps_id")


@query(f"WITH {RAMP} SELECT stack_id, image_ix, round(mp - rx * mx - ry * my, 5) + 0.0 AS r0, round(rx, 6) + 0.0 AS rx, round(ry, 6) + 0.0 AS ry FROM b")
def deramp_plane(spark, sf):
    """Plane of each image's phase."""
    return correction.ramps(_placed_phases(spark, sf), ["stack_id", "image_ix"], "ph").select("stack_id", "image_ix", r6("r0", 5).alias("r0"), r6("rx").alias("rx"), r6("ry").alias("ry"))


@query(f"WITH {RAMP} SELECT s.ps_id, s.image_ix, round(ph - coalesce(mp + rx * (x - mx) + ry * (y - my), 0), 5) + 0.0 AS ph FROM s LEFT JOIN b ON s.stack_id = b.stack_id AND s.image_ix = b.image_ix")
def deramped_phase(spark, sf):
    return correction.deramped(_placed_phases(spark, sf), ["stack_id", "image_ix"], "ph").select("ps_id", "image_ix", r6("ph", 5).alias("ph"))


_TERMS2 = ["1.0", "x", "y", "x * y", "x * x", "y * y"]
_products = ", ".join(f"sum(({a}) * ({b})) AS s{i}{j}" for i, a in enumerate(_TERMS2) for j, b in enumerate(_TERMS2))
_sides = ", ".join(f"sum(({a}) * ph) AS t{i}" for i, a in enumerate(_TERMS2))


@query(f"""WITH {PH}, {PT}, pl AS (SELECT stack_id, image_ix, count(*) AS n FROM (SELECT ph.* FROM ph JOIN pt USING (ps_id) WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y)) GROUP BY ALL)
SELECT stack_id, image_ix, true AS is_solved FROM pl WHERE n > 8""")
def deramp_polynomial(spark, sf):
    """Ramps of second degree of each image: do the coefficients solve the normal equations of all its points, summed anew?"""
    rows = _placed_phases(spark, sf)
    found = correction.polynomial_ramps(rows.withColumn("x", F.col("x") * 1000).withColumn("y", F.col("y") * 1000), ["stack_id", "image_ix"], "ph", 2.0)
    sums = rows.groupBy("stack_id", "image_ix").agg(*(F.expr(p) for p in _products.split(", ")), *(F.expr(p) for p in _sides.split(", ")))
    c = found.where("coefficients is not null").join(sums, ["stack_id", "image_ix"]).withColumn("c", F.col("coefficients"))
    # relative to the size of the terms: an error against the sum alone follows the order of the rows (2e-7 here), this one does not
    total = lambda i, f: sum((f(F.col(f"s{i}{j}") * F.col("c")[j]) for j in range(6)), F.lit(0.0))
    error = lambda i: F.abs(total(i, lambda v: v) - F.col(f"t{i}")) / (1 + total(i, F.abs) + F.abs(F.col(f"t{i}")))
    return c.select("stack_id", "image_ix", (F.greatest(*(error(i) for i in range(6))) < 1e-13).alias("is_solved"))


@query(f"""WITH {PH}, s AS (SELECT ps_id, image_ix, day, ph, image_ix = master_ix AS is_ref FROM ph JOIN stacks USING (stack_id))
SELECT a.ps_id, a.image_ix, round(sum(b.ph * exp(-((a.day - b.day) ** 2) / (2 * 100.0 * 100.0))) / sum(exp(-((a.day - b.day) ** 2) / (2 * 100.0 * 100.0))), 6) + 0.0 AS low
FROM s a JOIN s b ON a.ps_id = b.ps_id WHERE NOT b.is_ref GROUP BY a.ps_id, a.image_ix""")
def temporal_lowpass(spark, sf):
    """Gaussian mean over time, the reference image without weight."""
    s = phases(spark, sf).join(table(spark, sf, "stacks").select("stack_id", "master_ix"), "stack_id")
    s = s.select("ps_id", "image_ix", "day", "ph", (F.col("image_ix") == F.col("master_ix")).alias("is_ref"))
    low = correction.temporal_low_pass(s, "ps_id", "day", "ph", 100.0, "is_ref")
    return low.where("low is not null").select("ps_id", "image_ix", r6("low").alias("low"))


ECEF = f"""(SELECT ps_id, stack_id, {near.EARTH} * cos(radians(lat)) * cos(radians(lon)) AS ex, {near.EARTH} * cos(radians(lat)) * sin(radians(lon)) AS ey, {near.EARTH} * sin(radians(lat)) AS ez FROM pt WHERE {PLACE})"""


@query(f"""WITH {PT}, {SE}, v AS (SELECT e.*, k FROM {ECEF} e JOIN se USING (ps_id) WHERE k IS NOT NULL AND NOT isnan(k)),
p AS (SELECT a.ps_id, b.k, (a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2 + (a.ez - b.ez) ** 2 AS d2 FROM v a JOIN v b ON a.stack_id = b.stack_id)
SELECT ps_id AS id, round(sum(k * exp(-d2 / 5000.0)) / sum(exp(-d2 / 5000.0)), 6) + 0.0 AS low FROM p WHERE d2 <= 40000 GROUP BY ps_id""")
def spatial_lowpass(spark, sf):
    """Gaussian mean over the points within four scales of 50 m, cell by cell with their halo."""
    k = estimates(spark, sf).where("k is not null and not isnan(k)").select("ps_id", "k")
    p = near.with_positions(points(spark, sf).select("ps_id", "stack_id", "lon", "lat").join(k, "ps_id"))
    low = correction.spatial_low_pass(p.withColumn("k", F.array("k")), "ps_id", "k", 50.0, ["stack_id"])
    return low.select("id", r6(F.col("low")[0]).alias("low"))


# ---------------------------------------------------------------- export


@query(f"""WITH {PT}, {PH}, s AS (SELECT pt.stack_id, image_ix, ph, coalesce(lat > ll0_lat AND {PLACE}, false) AS inside FROM ph JOIN pt USING (ps_id) JOIN stacks s ON s.stack_id = pt.stack_id)
SELECT stack_id, image_ix, round(coalesce(avg(ph) FILTER (inside), avg(ph)), 6) + 0.0 AS ref FROM s GROUP BY ALL""")
def ref_area_mean(spark, sf):
    """Mean phase of each image over its reference area, here the northern half of the scene."""
    p = points(spark, sf).join(table(spark, sf, "stacks").select("stack_id", "ll0_lat"), "stack_id").select("ps_id", "stack_id", "ll0_lat", "lon", "lat")
    inside = F.coalesce((F.col("lat") > F.col("ll0_lat")) & near.has_place(F.col("lon"), F.col("lat")), F.lit(False))
    rows = phases(spark, sf).drop("stack_id").join(p, "ps_id")
    return export.reference_means(rows, ["stack_id", "image_ix"], "ph", inside).withColumn("ref", r6("ref"))


def _with_wavelength(spark, sf):
    return phases(spark, sf).join(table(spark, sf, "stacks").select("stack_id", "wavelength"), "stack_id")


@query(f"WITH {PH} SELECT ps_id, round(-regr_slope(ph, CAST(day AS DOUBLE)) * 365.25 / (4 * pi()) * any_value(wavelength) * 1000, 5) + 0.0 AS velocity, count(*) AS n FROM ph JOIN stacks USING (stack_id) GROUP BY ps_id HAVING count(*) > 2")
def velocity_ols(spark, sf):
    v = export.velocity(_with_wavelength(spark, sf).withColumn("day", F.col("day") - 737000), ["ps_id"], "ph", "day", "wavelength")
    return v.where("n > 2").select("ps_id", r6("velocity", 5).alias("velocity"), "n")


#: Whitened by the closed form of a first-order process: the first value, then each less half of the one before.
SERIES, RHO = 16, 0.5


@query(f"""WITH s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS p, 12.0 * i AS t FROM embeddings, range({SERIES}) r(i)),
w AS (SELECT vec_id, i, CASE WHEN i = 0 THEN sqrt(0.75) * p ELSE p - 0.5 * lag(p) OVER q END AS p, CASE WHEN i = 0 THEN sqrt(0.75) * t ELSE t - 0.5 * lag(t) OVER q END AS t, CASE WHEN i = 0 THEN sqrt(0.75) ELSE 0.5 END AS o FROM s WINDOW q AS (PARTITION BY vec_id ORDER BY i)),
m AS (SELECT vec_id, sum(o * o) AS a, sum(o * t) AS b, sum(t * t) AS c, sum(o * p) AS d, sum(t * p) AS e FROM w GROUP BY vec_id)
SELECT vec_id, round(-(a * e - b * d) / (a * c - b * b) * 365.25 / (4 * pi()) * 56, 5) + 0.0 AS velocity FROM m""")
def velocity_gls(spark, sf):
    """Velocities by generalised least squares with a full covariance of the images (here that of a first-order process)."""
    day = np.arange(SERIES) * 12.0
    row = network.lscov(np.stack([np.ones(SERIES), day], 1), RHO ** np.abs(np.subtract.outer(np.arange(SERIES), np.arange(SERIES))))[1]
    p = F.transform(F.slice("embedding", 1, SERIES), lambda v: v.cast("double"))
    return vectors(spark, sf).select("vec_id", r6(-cplx.dot(p, row.tolist()) * 365.25 / (4 * math.pi) * 56, 5).alias("velocity"))


GLS = f"""{PH}, w AS (SELECT stack_id, image_ix, 1 / greatest(var_pop(atan2(sin(ph), cos(ph))), 0.01) AS w FROM ph GROUP BY ALL),
s AS (SELECT ps_id, w, CAST(day - 737000 AS DOUBLE) AS t, ph AS p, wavelength FROM ph JOIN w USING (stack_id, image_ix) JOIN stacks USING (stack_id)),
m AS (SELECT ps_id, count(*) AS n, sum(w) AS sw, sum(w * t) AS st, sum(w * p) AS sp, sum(w * t * t) AS stt, sum(w * t * p) AS stp, any_value(wavelength) AS l FROM s GROUP BY ps_id)"""


@query(f"WITH {GLS} SELECT ps_id, round(-(sw * stp - st * sp) / (sw * stt - st * st) * 365.25 / (4 * pi()) * l * 1000, 5) + 0.0 AS velocity, n FROM m WHERE n > 2")
def velocity_weighted(spark, sf):
    """Velocities weighted by the inverse variance of each image."""
    rows = _with_wavelength(spark, sf)
    w = rows.groupBy("stack_id", "image_ix").agg((1 / F.greatest(F.var_pop(cplx.wrap(F.col("ph"))), F.lit(0.01))).alias("w"))
    v = export.velocity(rows.join(w, ["stack_id", "image_ix"]).withColumn("day", F.col("day") - 737000), ["ps_id"], "ph", "day", "wavelength", "w")
    return v.where("n > 2").select("ps_id", r6("velocity", 5).alias("velocity"), "n")


@query(f"""WITH {PH}, g AS (SELECT p.ps_id, i.image_ix, ph.ph AS v FROM (SELECT DISTINCT ps_id, stack_id FROM ph) p JOIN (SELECT stack_id, unnest(range(n_image)) AS image_ix FROM stacks) i USING (stack_id) LEFT JOIN ph ON ph.ps_id = p.ps_id AND ph.image_ix = i.image_ix),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER q AS pv, last_value(CASE WHEN v IS NOT NULL THEN image_ix END IGNORE NULLS) OVER q AS pt,
  first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN image_ix END IGNORE NULLS) OVER f AS nt FROM g
  WINDOW q AS (PARTITION BY ps_id ORDER BY image_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY ps_id ORDER BY image_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT ps_id, image_ix, coalesce(v, CASE WHEN nt > pt THEN pv + (nv - pv) * (image_ix - pt) / (nt - pt) END, pv, nv, 0) AS x FROM b)
SELECT ps_id, CAST(image_ix AS INTEGER) AS image_ix, round(x - first_value(x) OVER (PARTITION BY ps_id ORDER BY image_ix), 6) + 0.0 AS filled FROM c""")
def ts_gap_fill(spark, sf):
    """Each point's series over all images of its stack, gaps interpolated, re-zeroed at the first."""
    ph = phases(spark, sf)
    images = table(spark, sf, "stacks").select("stack_id", F.explode(F.sequence(F.lit(0), F.col("n_image") - 1)).alias("image_ix"))
    grid = ph.select("ps_id", "stack_id").distinct().join(images, "stack_id").join(ph.select("ps_id", "image_ix", F.col("ph").alias("v")), ["ps_id", "image_ix"], "left")
    return export.gap_filled(grid, "ps_id", "image_ix", "v").select("ps_id", "image_ix", r6("filled").alias("filled"))


_WIDE = {k: f"d{k:02d}" for k in range(41)}


@query(f"WITH {PH} SELECT ps_id, stack_id, " + ", ".join(f"max(CASE WHEN image_ix = {k} THEN round(-ph * wavelength * 1000 / (4 * pi()), 5) + 0.0 END) AS {n}" for k, n in _WIDE.items()) + " FROM ph JOIN stacks USING (stack_id) GROUP BY ps_id, stack_id")
def export_wide(spark, sf):
    """One row per point with a displacement column per image."""
    mm = _with_wavelength(spark, sf).withColumn("mm", r6(export.phase_to_mm(F.col("ph"), F.col("wavelength")), 5))
    return export.wide(mm, ["ps_id", "stack_id"], "image_ix", "mm", _WIDE)


# ---------------------------------------------------------------- sets


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def patch_union(spark, sf):
    """All rows of two patches."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT az, rg FROM ps2 WHERE stack_id % 2 = 0 INTERSECT SELECT az, rg FROM ps2 WHERE stack_id % 2 = 1")
def pixel_intersect(spark, sf):
    """Pixels that ascending and descending stacks both hold."""
    p = table(spark, sf, "ps2")
    return p.where("stack_id % 2 = 0").select("az", "rg").intersect(p.where("stack_id % 2 = 1").select("az", "rg"))


@query("SELECT DISTINCT ps_id FROM ps2 WHERE ps_id NOT IN (SELECT ps_id FROM select1 WHERE keep_ix AND ps_id IS NOT NULL)")
def ids_except(spark, sf):
    """Points that no version of the selection keeps: an anti-join."""
    return table(spark, sf, "ps2").select("ps_id").distinct().join(table(spark, sf, "select1").where("keep_ix").select("ps_id"), "ps_id", "left_anti")


@query("SELECT DISTINCT stack_id, acq_day FROM phuw2 WHERE acq_day >= 1")
def distinct_dates(spark, sf):
    return table(spark, sf, "phuw2").where("acq_day >= 1").select("stack_id", "acq_day").distinct()


@query("""SELECT 'l_quantity' AS field, round(avg(l_quantity), 5) + 0.0 AS mean, round(stddev_pop(l_quantity), 5) + 0.0 AS deviation, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 5) + 0.0, round(stddev_pop(l_extendedprice), 5) + 0.0, min(l_extendedprice), max(l_extendedprice), count(*) FROM lineitem""")
def array_summary(spark, sf):
    """Summary of each numeric column, all in one pass."""
    from siltgrid.operators.validation import summaries

    s = summaries(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return s.select("field", r6("mean", 5).alias("mean"), r6("deviation", 5).alias("deviation"), "least", "most", "n")


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey AS k, round(o_totalprice, 1) AS v FROM orders WHERE o_orderstatus <> 'P')
SELECT count(a.k) AS n_left, count(b.k) AS n_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, round(avg(abs(a.v - b.v)), 6) + 0.0 AS mean_abs, round(max(abs(a.v - b.v)), 6) + 0.0 AS max_abs,
round(sqrt(avg((a.v - b.v) ** 2)), 6) + 0.0 AS rms FROM a FULL JOIN b ON a.k = b.k""")
def compare_tables(spark, sf):
    """Differences of a field between two tables that share a key."""
    from siltgrid.operators.validation import difference

    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 1).alias("v"))
    d = difference(a, b, ["k"], "v")
    return d.select("n_left", "n_right", "n_both", *(r6(c).alias(c) for c in ("mean_abs", "max_abs", "rms")))


# ---------------------------------------------------------------- angles, delays, coarse grids


@query("SELECT DISTINCT l_discount AS degrees, round(CASE WHEN l_discount <> 0 THEN radians(l_discount) ELSE l_discount END, 9) + 0.0 AS angle FROM lineitem")
def angle_units(spark, sf):
    """Degrees to radians with 0 kept."""
    d = table(spark, sf, "lineitem").select(F.col("l_discount").alias("degrees")).distinct()
    return d.select("degrees", r6(geo.angle_in_radians(F.col("degrees")), 9).alias("angle"))


@query(f"""WITH {PH}, dl AS (SELECT stack_id, unnest(range(0, n_image, 2)) AS image_ix FROM stacks)
SELECT ps_id, ph.image_ix, round(ph - CASE WHEN dl.image_ix IS NULL THEN 0 ELSE 0.1 * dl.image_ix END, 6) + 0.0 AS ph FROM ph LEFT JOIN dl ON dl.stack_id = ph.stack_id AND dl.image_ix = ph.image_ix""")
def delay_subtract(spark, sf):
    """Phases less a delay that is known for every other image."""
    every = F.explode(F.sequence(F.lit(0), F.col("n_image") - 1, F.lit(2))).alias("image_ix")
    delays = table(spark, sf, "stacks").select("stack_id", every).withColumn("delay", 0.1 * F.col("image_ix"))
    return correction.less_delay(phases(spark, sf), delays, ["stack_id", "image_ix"], "ph").select("ps_id", "image_ix", r6("ph").alias("ph"))


@query(f"""WITH {PT}, g AS (SELECT a.i AS gi, b.j AS gj, 10.0::DOUBLE * a.i + b.j * b.j AS bperp FROM (SELECT unnest(range(9)) AS i) a, (SELECT unnest(range(9)) AS j) b),
q AS (SELECT ps_id, az / 1000.0::DOUBLE AS r, rg / 4000.0::DOUBLE AS c FROM pt WHERE az IS NOT NULL AND rg IS NOT NULL),
k AS (SELECT ps_id, floor(r) + a.i AS gi, floor(c) + b.j AS gj, abs(1 - a.i - (r - floor(r))) * abs(1 - b.j - (c - floor(c))) AS w FROM q, (SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(2)) AS j) b)
SELECT ps_id AS id, round(sum(w * bperp) / sum(w), 6) + 0.0 AS bperp FROM k JOIN g ON k.gi = g.gi AND k.gj = g.gj WHERE w > 0 GROUP BY ps_id""")
def baseline_from_grid(spark, sf):
    """Baseline of each point between the nodes of a coarse grid."""
    nodes = spark.range(81).select((F.col("id") / 9).cast("int").alias("gi"), (F.col("id") % 9).cast("int").alias("gj"))
    grid = nodes.withColumn("bperp", 10.0 * F.col("gi") + F.col("gj") * F.col("gj"))
    pt = points(spark, sf).where("az is not null and rg is not null").select("ps_id", "az", "rg")
    return correction.from_coarse_grid(pt, grid, "ps_id", "az", "rg", 1000.0, 4000.0, "bperp").withColumn("bperp", r6("bperp"))


# ---------------------------------------------------------------- kernels that SQL does not express


def _coarse(spark, sf) -> DataFrame:
    """Complex sums of each image in cells of two kilometres."""
    p = points(spark, sf).where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("ps_id", "stack_id", "x", "y")
    cells = phasegrid.with_cells(p, ["stack_id"], 2000.0).select("ps_id", "stack_id", "gi", "gj")
    return phasegrid.accumulate(phases(spark, sf).drop("stack_id").join(cells, "ps_id"), ["stack_id", "image_ix", "gi", "gj"], "ph")


def _filtered(spark, sf, f) -> DataFrame:
    import pyarrow as pa

    def one(t):
        i, j = (t.column(c).to_numpy() for c in ("gi", "gj"))
        grid = np.zeros((i.max() + 1, j.max() + 1), complex)
        grid[i, j] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        return pa.table({**{c: t.column(c) for c in ("stack_id", "image_ix", "gi", "gj")}, "phase": np.angle(f(grid)[i, j])})

    rows = _coarse(spark, sf).select("stack_id", "image_ix", F.col("gi").cast("int"), F.col("gj").cast("int"), "re", "im")
    return spread(rows, "stack_id", "image_ix").groupBy("stack_id", "image_ix").applyInArrow(one, "stack_id int, image_ix int, gi int, gj int, phase double")


@query()
def clap_filter(spark, sf):
    """Each image's grid through the adaptive low-pass filter."""
    from siltgrid.functions.kernels import clap

    return _filtered(spark, sf, lambda g: clap(g, 2000.0, 24, 8, 16000.0))


@query()
def goldstein_filter(spark, sf):
    """Each image's grid through the power-spectrum filter."""
    from siltgrid.functions.kernels import goldstein

    return _filtered(spark, sf, goldstein)


@query()
def unwrap_grid(spark, sf):
    """Each image's grid unwrapped in space."""
    from siltgrid.operators.unwrapping import unwrap_images

    return unwrap_images(_coarse(spark, sf).select("stack_id", "image_ix", F.col("gi").cast("int"), F.col("gj").cast("int"), "re", "im"), ["stack_id", "image_ix"])


@query()
def null_histogram(spark, sf):
    """Coherence that random phases reach, in 100 bins."""
    from siltgrid.functions.kernels import random_coherence

    counts = random_coherence(np.array(BASELINE[:16]), 1.0)
    return spark.createDataFrame(list(enumerate(counts.tolist())), "bin int, n long")


def _triangulated(spark, sf) -> DataFrame:
    from siltgrid.operators.mesh import delaunay_arcs

    p = points(spark, sf).where("x is not null and y is not null and not isnan(x) and not isnan(y) and patch_id is not null")
    return delaunay_arcs(p.select((F.col("stack_id").cast("long") * 100000 + F.col("patch_id")).alias("patch"), "ps_id", "x", "y"), "patch", "ps_id")


@query()
def delaunay_arcs(spark, sf):
    """Edges of the triangulation of each patch of each stack."""
    return _triangulated(spark, sf)


@query()
def laplacian_integrate(spark, sf):
    """Look-angle error of points integrated back from its differences along the triangulation's edges."""
    from siltgrid.operators.mesh import integrate_arcs

    v = estimates(spark, sf).where("k is not null and not isnan(k)").select("ps_id", "k")
    a = v.select(F.col("ps_id").alias("a"), F.col("k").alias("ka"))
    b = v.select(F.col("ps_id").alias("b"), F.col("k").alias("kb"))
    arcs = _triangulated(spark, sf).join(a, "a").join(b, "b").select("patch", "a", "b", F.array(F.col("kb") - F.col("ka")).alias("d"))
    return integrate_arcs(arcs, "patch", "d")


@query()
def parttime_bootstrap(spark, sf):
    """Points whose coherence varies little when images are drawn anew."""
    from siltgrid.plans.pipeline import reject_part_time

    return reject_part_time(_fitted(spark, sf).select("vec_id", "coh", "residual"), "residual", 0.12).select("vec_id", "coh", "coh_std")


@query()
def stack_chain(spark, sf):
    """The whole chain from candidates to displacement, over the vectors as a stack of 16 images."""
    from siltgrid.params import Params
    from siltgrid.plans import pipeline

    e = lambda k: F.col("embedding")[k].cast("double")
    p = vectors(spark, sf).select(
        F.col("vec_id").alias("pid"), F.lit(1).alias("patch"), (e(60) * 4000).alias("x"), (e(61) * 4000).alias("y"), (10 + e(60) / 20).alias("lon"), (45 + e(61) / 20).alias("lat"),
        (0.1 + F.abs(e(62))).alias("d_a"), F.lit(100.0).alias("hgt"), F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double") * 2).alias("ph"),
    )
    images = pipeline.Images([737000.0 + 12 * k for k in range(16)], BASELINE[:16], 7)
    params = Params().set("clap_low_pass_wavelength", 800.0)
    return pipeline.run(p, images, params)["export"]


@query("SELECT vec_id AS pid, true AS is_recovered FROM embeddings")
def network_chain(spark, sf):
    """The chain over a pair network whose phases are written down: steady motion that grows with x, a height error of each point, no noise.

    Is each point's velocity, relative to the mean of all, that which was put in, to a tenth of a millimetre a year?
    """
    from siltgrid.params import Params
    from siltgrid.plans import pipeline

    e = lambda k: F.col("embedding")[k].cast("double")
    n, ref = 10, 3
    day = [737000.0 + 24 * k for k in range(n)]
    base = [BASELINE[7 * k % 16] for k in range(n)]  # not in step with time, or height and motion could not be told apart
    bperp = [b - base[ref] for b in base]
    network_pairs = [(i, i + d) for i in range(n) for d in (1, 2) if i + d < n]
    rows = vectors(spark, sf).select(
        F.col("vec_id").alias("pid"), F.lit(1).alias("patch"), (e(60) * 2000).alias("x"), (e(61) * 2000).alias("y"), (10 + e(60) / 40).alias("lon"), (45 + e(61) / 55).alias("lat"), F.lit(0.2).cast("double").alias("d_a"), F.lit(100.0).alias("hgt"),
        (e(60) * 4).alias("velocity"), (e(62) * 0.002).alias("k"),
    )
    turn = -4 * math.pi / 56 / 365.25
    ph = F.array(*(cplx.wrap(F.col("velocity") * turn * (day[j] - day[i]) + F.col("k") * (bperp[j] - bperp[i])) for i, j in network_pairs))
    stack = rows.withColumn("ph", ph)
    images = pipeline.Images(day, bperp, ref, pairs=network_pairs)
    params = Params(small_baseline=True).set("merge_resample_size", 0.0).set("select_method", "PERCENT")
    out = pipeline.run(stack.drop("velocity", "k"), images, params, corrections="v-d")["export"].join(rows.select("pid", "velocity"), "pid")
    from siltgrid.session import stored

    out = stored(out.select("pid", (F.col("vel") - F.col("velocity")).alias("off")), "network-chain")
    return out.join(F.broadcast(out.agg(F.avg("off").alias("mean"))), F.lit(True)).select("pid", (F.abs(F.col("off") - F.col("mean")) < 0.1).alias("is_recovered"))
