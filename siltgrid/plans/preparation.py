"""Queries of the general data-preparation operators over the whole test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrid.operators import copies, gridding, imputation, near, regions, spikes, timestamps
from siltgrid.session import latest, table


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each point."""
    return latest(table(spark, sf_dir, "ps2").where("ps_id is not null"), ["ps_id"], ["stack_id", "lon", "lat"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points at most 15 m apart, and the areas that contain each point."""
    points = _places(spark, sf_dir)
    near_by = near.near_pairs(near.with_positions(points), "ps_id", 15.0)
    inside = regions.containing_regions(points, table(spark, sf_dir, "areas"), "ps_id")
    return near_by.select(F.lit("near").alias("rel"), "id_a", "id_b").unionByName(inside.select(F.lit("in").alias("rel"), F.col("area_id").alias("id_a"), F.col("id").alias("id_b")))


def _item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both copies of every item, point by point."""
    items = table(spark, sf_dir, "item_map")
    sides = []
    for name, key in (("mat_items", "mat_key"), ("h5_items", "h5_key")):
        names = items.select("item", copies.loose_key(F.col(key)).alias("_key")).dropDuplicates()
        rows = table(spark, sf_dir, name).select(copies.loose_key(F.col(key)).alias("_key"), "ps_id", "val")
        sides.append(rows.join(names, "_key").select("item", "ps_id", "val"))
    return copies.compare_copies(*sides, keys=["item", "ps_id"], fields=["val"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows missing on either side, and rows whose values differ."""
    kind = F.when(F.col("kind") == "only_left", "only_mat").when(F.col("kind") == "only_right", "only_h5").otherwise("differs")
    return _item_pairs(spark, sf_dir).where("kind <> 'same'").select("item", "ps_id", kind.alias("kind")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: rows on both sides, missing rows, differing rows and the largest difference."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    pairs = _item_pairs(spark, sf_dir).groupBy("item").agg(
        (count("same") + count("differs")).alias("n_both"),
        count("only_left").alias("n_only_mat"),
        count("only_right").alias("n_only_h5"),
        count("differs").alias("n_differs"),
        F.max(F.abs(F.col("l_val") - F.col("r_val"))).alias("max_abs_diff"),
    )
    return table(spark, sf_dir, "item_map").join(pairs, "item", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a usable reading, from the regular grid."""
    grid = gridding.regular_grid(table(spark, sf_dir, "ps2"), table(spark, sf_dir, "phuw2"), table(spark, sf_dir, "stacks"), only_empty=True)
    return grid.select("ps_id", "slot_ix")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular grid: a value, its support and its mark for each point and slot."""
    grid = gridding.regular_grid(table(spark, sf_dir, "ps2"), table(spark, sf_dir, "phuw2"), table(spark, sf_dir, "stacks"))
    return grid.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("value", "support")})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings of both fields."""
    return p4_flags(spark, sf_dir).select("ps_id", "image_ix", "field_name")


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings with value and reason."""
    series = spikes.implausible_series(table(spark, sf_dir, "phuw2"), table(spark, sf_dir, "stacks"))
    return series.unionByName(spikes.implausible_arrays(table(spark, sf_dir, "scn2")))


def p4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings flagged by a rule that needs no course: out of bounds, and stuck."""
    return p4_flags(spark, sf_dir).where("reason <> 'spike'").select("ps_id", "image_ix", "field_name", "reason")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value that was missing and has been filled."""
    return p5_filled(spark, sf_dir).select("ps_id", "image_ix", "field_name")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values with the posterior of each."""
    return imputation.fill_missing(table(spark, sf_dir, "phuw2"))


#: Conventions that the table's description states of its writers.
WRITERS = {"slashed": ("dmy", {"isce_us": "mdy"}), "serial": ("year0", {"python": "year1"})}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of all texts that name a real time."""
    return p7_normalised(spark, sf_dir).where("utc_us is not null").select("rec_id", "field_name", "utc_us")


def p7_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every record with layout, reading, instant, posterior and status."""
    return timestamps.normalise(table(spark, sf_dir, "acq_log"), table(spark, sf_dir, "stacks"), {"acq_day": "acq_day_raw", "master_day": "master_day_raw"}, conventions=WRITERS)


#: The current version of each reading, for the SQL below.
CURRENT = """cur AS (
  SELECT ps_id, image_ix, arg_max(struct_pack(d := acq_day, v := ph_uw), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS r
  FROM phuw2 WHERE ps_id IS NOT NULL AND image_ix IS NOT NULL GROUP BY ps_id, image_ix)"""

P2_PAIRS = r"""
WITH m AS (SELECT DISTINCT item, ps_id, CASE WHEN isnan(val) THEN NULL ELSE val END AS v FROM mat_items JOIN item_map i
             ON lower(regexp_replace(regexp_replace(mat_items.mat_key, '\s', '', 'g'), '^/+', '')) = lower(regexp_replace(regexp_replace(i.mat_key, '\s', '', 'g'), '^/+', ''))),
h AS (SELECT DISTINCT item, ps_id, CASE WHEN isnan(val) THEN NULL ELSE val END AS v FROM h5_items JOIN item_map i
             ON lower(regexp_replace(regexp_replace(h5_items.h5_key, '\s', '', 'g'), '^/+', '')) = lower(regexp_replace(regexp_replace(i.h5_key, '\s', '', 'g'), '^/+', ''))),
pairs AS (
  SELECT coalesce(m.item, h.item) AS item, coalesce(m.ps_id, h.ps_id) AS ps_id, m.v AS mv, h.v AS hv,
    CASE WHEN h.item IS NULL THEN 'only_mat' WHEN m.item IS NULL THEN 'only_h5'
         WHEN (m.v IS NULL) <> (h.v IS NULL) THEN 'differs'
         WHEN abs(m.v - h.v) > 1e-4 * greatest(1.0, abs(m.v), abs(h.v)) THEN 'differs' ELSE 'same' END AS kind
  FROM m FULL JOIN h ON m.item = h.item AND m.ps_id = h.ps_id)
"""
P2_FOUND = P2_PAIRS + "SELECT DISTINCT item, ps_id, kind FROM pairs WHERE kind <> 'same'"
P2_REPORT = P2_PAIRS + """SELECT i.item, i.mat_key, i.h5_key, count(*) FILTER (kind IN ('same', 'differs')) AS n_both, count(*) FILTER (kind = 'only_mat') AS n_only_mat,
  count(*) FILTER (kind = 'only_h5') AS n_only_h5, count(*) FILTER (kind = 'differs') AS n_differs, coalesce(max(abs(mv - hv)), NULL) AS max_abs_diff
  FROM item_map i LEFT JOIN pairs USING (item) GROUP BY ALL"""

P3_FOUND = f"""
WITH {CURRENT},
pts AS (SELECT ps_id, arg_max(stack_id, coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS stack_id FROM ps2 WHERE ps_id IS NOT NULL GROUP BY ps_id),
grid AS (SELECT ps_id, s.*, unnest(range(n_slots)) AS slot_ix FROM pts JOIN stacks s USING (stack_id)),
used AS (
  SELECT DISTINCT c.ps_id, least(greatest(floor((c.r.d - s.first_day) / CAST(s.repeat_days AS DOUBLE) + 0.5), 0), s.n_slots - 1) AS slot_ix
  FROM cur c JOIN pts USING (ps_id) JOIN stacks s USING (stack_id)
  WHERE c.r.d >= 1 AND c.r.v IS NOT NULL AND isfinite(c.r.v) AND c.r.v NOT IN (-9999, -32768))
SELECT ps_id, CAST(g.slot_ix AS INTEGER) AS slot_ix FROM grid g ANTI JOIN used u USING (ps_id, slot_ix)
"""

#: The local regression written out: Epanechnikov weights over 2.5 periods, sums of each slot, a line or a mean.
P3_GRID = f"""
WITH {CURRENT},
pts AS (SELECT ps_id, arg_max(stack_id, coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS stack_id FROM ps2 WHERE ps_id IS NOT NULL GROUP BY ps_id),
grid AS (SELECT ps_id, s.stack_id, first_day, repeat_days, n_slots, unnest(range(n_slots)) AS slot_ix FROM pts JOIN stacks s USING (stack_id)),
used AS (
  SELECT c.ps_id, c.r.d AS d, CAST(c.r.v AS DOUBLE) AS v, n_slots, (c.r.d - s.first_day) / CAST(s.repeat_days AS DOUBLE) AS u,
    least(greatest(floor((c.r.d - s.first_day) / CAST(s.repeat_days AS DOUBLE) + 0.5), 0), s.n_slots - 1) AS own
  FROM cur c JOIN pts USING (ps_id) JOIN stacks s USING (stack_id)
  WHERE c.r.d >= 1 AND c.image_ix >= 0 AND c.r.v IS NOT NULL AND isfinite(c.r.v) AND c.r.v NOT IN (-9999, -32768)),
spread AS (SELECT *, own + k AS slot_ix, u - (own + k) AS x, 1 - ((u - (own + k)) / 2.5) ** 2 AS w FROM used, range(-3, 4) t(k)),
sums AS (SELECT ps_id, slot_ix, sum(w) FILTER (w > 0) AS s0, sum(w * x) FILTER (w > 0) AS s1, sum(w * x * x) FILTER (w > 0) AS s2, sum(w * v) FILTER (w > 0) AS t0, sum(w * x * v) FILTER (w > 0) AS t1,
    sum(w * w) FILTER (w > 0) AS q, count(*) FILTER (k = 0) AS n, avg(v) FILTER (k = 0) AS mean FROM spread GROUP BY ALL),
fit AS (SELECT *, coalesce(s0 * s0 / q, 0) AS support, s0 * s2 - s1 * s1 AS det FROM sums)
SELECT g.ps_id, g.stack_id, CAST(g.slot_ix AS INTEGER) AS slot_ix, CAST(first_day + g.slot_ix * repeat_days AS INTEGER) AS day,
  round(CASE WHEN coalesce(n, 0) = 0 AND coalesce(support, 0) < 1.5 THEN NULL WHEN s0 IS NULL THEN mean
    WHEN support >= 1.6 AND det > 0.05 * s0 * s0 AND abs(s1) < s0 THEN (s2 * t0 - s1 * t1) / det ELSE t0 / s0 END, 5) + 0.0 AS value,
  CAST(coalesce(n, 0) AS INTEGER) AS n_readings, round(coalesce(support, 0), 5) + 0.0 AS support,
  CASE WHEN coalesce(n, 0) > 0 THEN 'observed' WHEN coalesce(support, 0) >= 1.5 THEN 'filled' ELSE 'missing' END AS status
FROM grid g LEFT JOIN fit f ON f.ps_id = g.ps_id AND f.slot_ix = g.slot_ix
"""

P4_RULES = f"""
WITH {CURRENT},
sc AS (SELECT ps_id, arg_max(struct_pack(a := ph_scn_slave), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS r FROM scn2 WHERE ps_id IS NOT NULL GROUP BY ps_id),
v AS (SELECT ps_id, image_ix, 'ph_uw' AS field_name, r.v AS v FROM cur UNION ALL SELECT ps_id, unnest(range(len(r.a))), 'ph_scn_slave', unnest(r.a) FROM sc),
ok AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w AS fresh FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v NOT IN (-9999, -32768) WINDOW w AS (PARTITION BY ps_id, field_name ORDER BY image_ix)),
runs AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY ps_id, field_name ORDER BY image_ix) AS run FROM ok),
sized AS (SELECT *, count(*) OVER (PARTITION BY ps_id, field_name, run) AS n FROM runs)
SELECT ps_id, CAST(image_ix AS INTEGER) AS image_ix, field_name, CASE WHEN abs(v) <= 500 THEN 'stuck' ELSE 'bound' END AS reason FROM sized WHERE n >= 4 OR NOT abs(v) <= 500
"""

P5_FOUND = f"""
WITH {CURRENT}
SELECT ps_id, image_ix, 'ph_uw' AS field_name FROM cur WHERE r.v IS NULL OR isnan(r.v) OR r.v IN (-9999, -32768)
UNION ALL
SELECT ps_id, image_ix, 'acq_day' AS field_name FROM cur WHERE r.d IS NULL OR r.d < 1
"""


#: Every pair by brute force, and each point against each edge of each outline by the even-odd rule.
P1_FOUND = rf"""
WITH pts AS (SELECT ps_id, r.lon AS lon, r.lat AS lat FROM (
    SELECT ps_id, arg_max(struct_pack(lon := lon, lat := lat), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS r FROM ps2 WHERE ps_id IS NOT NULL GROUP BY ps_id)
  WHERE isfinite(r.lon) AND isfinite(r.lat) AND abs(r.lat) <= 90 AND NOT (r.lon = 0 AND r.lat = 0)),
e AS (SELECT ps_id, {near.EARTH} * cos(radians(lat)) * cos(radians(lon)) AS x, {near.EARTH} * cos(radians(lat)) * sin(radians(lon)) AS y, {near.EARTH} * sin(radians(lat)) AS z FROM pts),
ring AS (SELECT area_id, row_number() OVER () AS ring, string_split(trim(r, '()'), ',') AS v FROM (SELECT area_id, unnest(regexp_extract_all(outline, '\([^()]+\)')) AS r FROM areas)),
vertex AS (SELECT area_id, ring, i, CAST(string_split(trim(v[i]), ' ')[1] AS DOUBLE) AS x, CAST(string_split(trim(v[i]), ' ')[2] AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ring)),
edge AS (SELECT a.area_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vertex a JOIN vertex b ON a.ring = b.ring AND b.i = a.i + 1),
box AS (SELECT area_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vertex GROUP BY area_id),
near_box AS (SELECT area_id, ps_id, lon + k AS x, lat AS y FROM (SELECT *, unnest([-720, -360, 0, 360, 720]) AS k FROM pts) JOIN box ON lon + k BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)
SELECT 'near' AS rel, a.ps_id AS id_a, b.ps_id AS id_b FROM e a JOIN e b ON a.ps_id < b.ps_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 225
UNION ALL
SELECT DISTINCT 'in', area_id, ps_id FROM (SELECT n.area_id, n.ps_id, n.x, count(*) AS crossings FROM near_box n JOIN edge USING (area_id)
  WHERE (y1 > n.y) <> (y2 > n.y) AND n.x < (x2 - x1) * (n.y - y1) / (y2 - y1) + x1 GROUP BY ALL) WHERE crossings % 2 = 1
"""

_PARTS = ["y", "mo", "d", "h", "mi", "s", "f", "half", "zone", "doy"]


def _layout_sql(name: str) -> str:
    """SELECT of the texts of one layout as their parts; '' where a part is not there."""
    pattern, to = timestamps.LAYOUTS[name]
    groups = [g[1:] for g in to.split("|")]
    take = ", ".join(f"regexp_extract(t, '{pattern}', {g}) AS {p}" if g else f"'' AS {p}" for p, g in zip(_PARTS, groups))
    return f"SELECT *, '{name}' AS layout, {take} FROM texts WHERE regexp_matches(t, '{pattern}')"


_FIXED = ", ".join(f"('{z}', {m})" for z, m in timestamps.ABBREVIATIONS.items())
#: The stated convention of each writer taken as it is, without any mixture.
P7_FOUND = rf"""
WITH texts AS (SELECT rec_id, field_name, writer, tz_name, site_tz, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM (
    SELECT rec_id, stack_id, writer, tz_name, unnest([struct_pack(field_name := 'acq_day', raw := acq_day_raw), struct_pack(field_name := 'master_day', raw := master_day_raw)], recursive := true) FROM acq_log)
  LEFT JOIN (SELECT DISTINCT stack_id, site_tz FROM stacks) USING (stack_id)),
parts AS ({" UNION ALL ".join(_layout_sql(n) for n in timestamps.LAYOUTS)}),
calendar AS (SELECT *, TRY_CAST(y AS INTEGER) AS yy,
    CASE WHEN layout = 'slashed' AND writer IS DISTINCT FROM 'isce_us' THEN TRY_CAST(d AS INTEGER) WHEN layout IN ('named', 'mail', 'spoken') THEN CAST(list_position({timestamps.MONTHS!r}, lower(substr(mo, 1, 3))) AS INTEGER) ELSE TRY_CAST(mo AS INTEGER) END AS mm,
    CASE WHEN layout = 'slashed' AND writer IS DISTINCT FROM 'isce_us' THEN TRY_CAST(mo AS INTEGER) ELSE TRY_CAST(d AS INTEGER) END AS dd,
    coalesce(TRY_CAST(h AS INTEGER), 0) AS hh, coalesce(TRY_CAST(mi AS INTEGER), 0) AS mins, coalesce(TRY_CAST(s AS INTEGER), 0) AS secs, coalesce(TRY_CAST(rpad(substr(f, 1, 6), 6, '0') AS BIGINT), 0) AS micros
  FROM parts WHERE layout <> 'number'),
days AS (SELECT *, CASE WHEN layout = 'ordinal' THEN CASE WHEN TRY_CAST(doy AS INTEGER) BETWEEN 1 AND dayofyear(make_date(yy, 12, 31)) THEN make_date(yy, 1, 1) + TRY_CAST(doy AS INTEGER) - 1 END
    ELSE TRY_CAST(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE) END AS day,
    CASE lower(half) WHEN 'am' THEN hh % 12 WHEN 'pm' THEN hh % 12 + 12 ELSE hh END AS hour FROM calendar),
zoned AS (SELECT *, CASE WHEN zone <> '' THEN zone WHEN tz_name IN (SELECT name FROM pg_timezone_names()) THEN tz_name ELSE site_tz END AS z,
    CAST(day AS TIMESTAMP) + to_hours(hour) + to_minutes(mins) + to_seconds(secs) + to_microseconds(micros) AS local FROM days
  WHERE day IS NOT NULL AND hh <= 23 AND mins <= 59 AND secs <= 59 AND (half = '' OR hh BETWEEN 1 AND 12)),
offsets AS (SELECT zoned.*, CASE WHEN fixed.minutes IS NOT NULL THEN fixed.minutes
    WHEN regexp_matches(z, '^[+-]\d\d(:?\d\d)?$') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + coalesce(TRY_CAST(regexp_extract(z, '^[+-]\d\d:?(\d\d)$', 1) AS INTEGER), 0)) END AS shift
  FROM zoned LEFT JOIN (VALUES {_FIXED}) fixed(name, minutes) ON z = fixed.name),
instants AS (SELECT rec_id, field_name, epoch_us(local) - CAST(shift AS BIGINT) * 60000000 AS utc_us FROM offsets WHERE shift IS NOT NULL
  UNION ALL SELECT rec_id, field_name, CASE WHEN timezone(z, u - INTERVAL 1 HOUR) = local THEN epoch_us(u) - 3600000000 ELSE epoch_us(u) END FROM (
    SELECT *, timezone(z, local) AS u FROM offsets WHERE shift IS NULL AND z IN (SELECT name FROM pg_timezone_names()))
  UNION ALL SELECT rec_id, field_name, CASE WHEN length(y) <= 7 THEN (CAST(y AS BIGINT) - CASE WHEN writer = 'python' THEN 719163 ELSE 719529 END) * 86400000000
      + CAST(round(CASE WHEN f <> '' THEN CAST('0.' || f AS DECIMAL(19, 18)) ELSE 0 END * 86400000000) AS BIGINT)
    ELSE CAST(y AS BIGINT) * (CASE WHEN length(y) <= 11 THEN 1000000 WHEN length(y) <= 14 THEN 1000 ELSE 1 END)
      + CAST(round(CASE WHEN f <> '' THEN CAST('0.' || f AS DECIMAL(19, 18)) ELSE 0 END * (CASE WHEN length(y) <= 11 THEN 1000000 WHEN length(y) <= 14 THEN 1000 ELSE 1 END)) AS BIGINT) END
  FROM parts WHERE layout = 'number')
SELECT rec_id, field_name, utc_us FROM instants
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_report, p3_found, p3_grid, p4_found, p4_flags, p4_rules, p5_found, p5_filled, p7_found, p7_normalised)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p7_found": P7_FOUND, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND, "p3_grid": P3_GRID, "p4_rules": P4_RULES, "p5_found": P5_FOUND}
