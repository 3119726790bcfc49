"""Implausible readings: bounds, stuck values and spikes, per source against its own normal course.

A Hampel filter per source and field: the course is a rolling median (for phases that move, of what a robust slow-motion-and-season
fit leaves; for noise about zero, a wide one), the scale is the rolling median absolute deviation from it over the nearest
2 * WIDE + 1 readings, refined on those within it. One or two successive readings beyond `limit` scales are a spike if
a later reading is back on the course (ordinary readings stay within three, spikes are more than eight off, and the
course itself is known to about one); longer departures are jumps that stay. Runs of `stuck` or more successive
readings of the very same value are stuck, whatever the scale; infinite readings and those beyond `bound` are out of bounds.

Sources are taken together with others of like length, so memory follows the readings and not sources times the longest one.

Defined cases: null, NaN and no-data readings are passed over (readings on both sides of one are successive); stuck and
out-of-bounds readings take no part in the course; sources with fewer than five other readings have no spikes;
a departure that lasts to the last reading is none; a constant source has scale 0 and no spikes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.series import by_source, current, groups_of, numbers, whole_groups
from siltgrid.session import latest

#: No-data codes of a phase; the physical bound in radians.
NO_DATA = (-9999.0, -32768.0)
BOUND = 500.0
#: Readings on either side from which the scale is taken, and the course of noise about zero.
WIDE = 20
#: Cells of a dense block of sources, and of a window over one: they bound memory only.
CELLS, WINDOW_CELLS = 400_000, 4_000_000
REASONS = np.array(["", "bound", "stuck", "spike"])
YEAR = 365.25

SCHEMA = T.StructType(
    [
        T.StructField("ps_id", T.LongType()),
        T.StructField("image_ix", T.IntegerType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _dense(group: np.ndarray, place: np.ndarray, n: int, *columns: np.ndarray) -> list[np.ndarray]:
    width = int(place.max()) + 1 if len(place) else 0
    out = []
    for c in columns:
        m = np.full((n, width), np.nan)
        m[group, place] = c
        out.append(m)
    return out


def like_lengths(sizes: np.ndarray):
    """Groups whose sizes are within a factor of two, in parts of about CELLS cells when dense; empty groups are left out."""
    there = np.flatnonzero(sizes)
    level = np.frexp(sizes[there].astype(float) - 0.5)[1]
    for k in np.unique(level):
        of = there[level == k]
        step = max(1, CELLS // int(sizes[of].max()))
        for start in range(0, len(of), step):
            yield of[start : start + step]


def _median(m: np.ndarray) -> np.ndarray:
    """Median along the last axis without NaN; NaN where there is nothing."""
    n = np.sum(~np.isnan(m), axis=-1)
    s = np.sort(m, axis=-1)  # NaN last
    k = np.maximum(n - 1, 0)
    pick = lambda i: np.take_along_axis(s, i.clip(0, m.shape[-1] - 1)[..., None], -1)[..., 0]
    lo, hi = pick(k // 2), pick(n // 2)
    return np.where(n > 0, np.where(n % 2 == 1, lo, (lo + hi) / 2), np.nan)


def _season(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a robust fit of offset, drift and yearly season leaves of each row of x (NaN is no reading)."""
    ok = ~np.isnan(x)
    n = ok.sum(1)
    with np.errstate(invalid="ignore"):
        span = np.nanmax(np.where(ok, t, -np.inf), 1) - np.nanmin(np.where(ok, t, np.inf), 1)
    mid = np.where(n > 0, np.where(ok, t, 0).sum(1) / np.maximum(n, 1), 0)
    u = np.where(ok, t - mid[:, None], 0)
    season = (n >= 12) & (span > 0.8 * YEAR)
    basis = np.stack([np.ones_like(u), u / YEAR, np.sin(2 * np.pi * u / YEAR) * season[:, None], np.cos(2 * np.pi * u / YEAR) * season[:, None]], -1)
    y = np.where(ok, x, 0)
    w = ok.astype(float)
    fit = np.zeros_like(y)
    for _ in range(6):
        bw = basis * w[..., None]
        a = np.einsum("gmi,gmj->gij", bw, basis) + 1e-6 * np.eye(4) * np.maximum(1, n)[:, None, None]
        b = np.einsum("gmi,gm->gi", bw, y)
        fit = np.einsum("gmi,gi->gm", basis, np.linalg.solve(a, b[..., None])[..., 0])
        r = np.where(ok, x - fit, np.nan)
        s = 1.4826 * _median(np.abs(r))
        z = np.abs(r) / np.maximum(4 * s, 1e-12)[:, None]
        w = np.where(ok & (z < 1), (1 - np.nan_to_num(z, nan=1.0).clip(0, 1) ** 2) ** 2, 0)
        few = w.sum(1) < 5
        w[few] = ok[few]
    return np.where(ok, x - fit, np.nan)


def _unstep(x: np.ndarray) -> np.ndarray:
    """x without its jumps that stay, the largest first: the medians of five readings before and after a place differ far more
    than they do elsewhere in the row. Two spikes among five move no median."""
    x = x.copy()
    width = x.shape[1]
    if width < 10:
        return x
    at = np.arange(width)[:, None] + np.arange(-5, 5)
    inside = (at >= 0) & (at < width)
    todo = np.arange(len(x))
    for _ in range(width // 5):  # no row holds more jumps that five readings part
        y = x[todo]
        window = np.where(inside, y[:, at.clip(0, width - 1)], np.nan)
        before, after = window[..., :5], window[..., 5:]
        enough = ((~np.isnan(before)).sum(-1) >= 3) & ((~np.isnan(after)).sum(-1) >= 3)
        d = np.where(enough, _median(after) - _median(before), np.nan)
        z = np.abs(d - _median(d)[:, None])
        spread = 1.4826 * _median(z) + 1e-9
        z = np.nan_to_num(z / spread[:, None], nan=0.0)
        most = z.max(1)
        jump = np.abs(np.diff(y, axis=1, prepend=np.nan))
        k = np.nan_to_num(np.where(z >= 0.8 * most[:, None], jump, np.nan), nan=-1.0).argmax(1)
        row = np.flatnonzero(most > 8)
        if not len(row):
            break
        shift = d[row, k[row]] - _median(d)[row]
        todo = todo[row]
        x[todo] -= np.where(np.arange(width)[None, :] >= k[row, None], shift[:, None], 0)
    return x


def _rolled(r: np.ndarray, count: np.ndarray, half: int, f, own: bool = True) -> np.ndarray:
    """f of the window of the 2 * half + 1 nearest readings of each one; windows are shifted inwards at the ends.

    own: does a reading take part in its own window? f takes (rows, places, window) with NaN for none and gives (rows, places).
    """
    rows, width = r.shape
    k = 2 * half + 1
    if own and width <= k:  # every window is the whole row
        return np.broadcast_to(f(r[:, None, :]), r.shape)
    out = np.empty(r.shape)
    step = max(1, WINDOW_CELLS // (rows * k))
    for lo in range(0, width, step):
        place = np.arange(lo, min(width, lo + step))[None, :]
        first = np.clip(place - half, 0, np.maximum(count - k, 0)[:, None])
        at = first[..., None] + np.arange(k)
        window = np.take_along_axis(r, at.reshape(rows, -1).clip(0, width - 1), 1).reshape(at.shape)
        out[:, lo : lo + step] = f(np.where((at >= count[:, None, None]) | (False if own else at == place[..., None]), np.nan, window))
    return out


def _scale(window: np.ndarray, inflation: float) -> np.ndarray:
    """Scale of a window: median absolute deviation, then the deviation of what lies within 4.5 of it."""
    size = np.abs(window)
    scale = 1.4826 * _median(size) / inflation
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(4):
            inner = np.where(size <= 4.5 * inflation * scale[..., None], window, np.nan)
            n = (~np.isnan(inner)).sum(-1)
            scale = np.where(n >= 4, np.sqrt(np.nansum(inner**2, -1) / np.maximum(n, 1)) / inflation, scale)
    return scale


def spikes(t: np.ndarray, x: np.ndarray, course: str, half: int, limit: float) -> np.ndarray:
    """Which readings of left-packed rows x (NaN beyond each row's end) are spikes. course: 'smooth' or 'zero'."""
    count = (~np.isnan(x)).sum(1)
    there = ~np.isnan(x)
    if course == "zero":
        noise = np.where(x == 0, np.nan, x)  # the reference image's own zero says nothing
        off, inflation = x - np.nan_to_num(_rolled(noise, count, WIDE, _median)), 1.0
    else:
        r = _season(t, _unstep(x))
        off, inflation = r - _rolled(r, count, half, _median, own=False), 1.12
    scored = np.where(x == 0, np.nan, off)
    scale = _rolled(scored, count, WIDE, lambda w: _scale(w, inflation))
    with np.errstate(invalid="ignore", divide="ignore"):
        far = there & (np.abs(off) > limit * scale) & (scale > 0) & (count >= 5)[:, None]
    # runs of departures: length of the run that each one is in, and whether a reading follows it
    width = x.shape[1]
    place = np.broadcast_to(np.arange(width), x.shape)
    last_near = np.maximum.accumulate(np.where(far, -1, place), 1)
    next_near = np.minimum.accumulate(np.where(far | ~there, width, place)[:, ::-1], 1)[:, ::-1]
    # at the edge of a jump a reading lies with one of the readings around the run, a spike lies far from both
    left = np.where(last_near >= 0, np.take_along_axis(x, last_near.clip(0), 1), np.nan)
    right = np.where(next_near < width, np.take_along_axis(x, next_near.clip(0, width - 1), 1), np.nan)
    with np.errstate(invalid="ignore"):
        apart = np.fmin(np.abs(x - left), np.abs(x - right)) > 0.65 * limit * scale
    return far & apart & (next_near < width) & (next_near - last_near - 1 <= 2)


def judge(group: np.ndarray, t: np.ndarray, value: np.ndarray, n: int, course: str, stuck: int = 4, bound: float = BOUND, half: int = 3, limit: float = 7.0) -> np.ndarray:
    """Code in REASONS of each reading; rows are sorted by group and time and hold readings only (no NaN, no codes)."""
    code = np.zeros(len(value), np.int8)
    code[~(np.abs(value) <= bound)] = 1
    change = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])] if len(value) else np.empty(0, bool)
    run = np.cumsum(change) - 1
    code[(np.bincount(run)[run] >= stuck) & (code == 0) if len(value) else []] = 2
    rest = np.flatnonzero(code == 0)
    if len(rest):
        sizes = np.bincount(group[rest], minlength=n)
        start = np.cumsum(np.r_[0, sizes[:-1]])
        for of in like_lengths(sizes):
            row = np.repeat(np.arange(len(of)), sizes[of])
            place = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, sizes[of][:-1]]), sizes[of])
            at = rest[start[of][row] + place]
            tm, xm = _dense(row, place, len(of), t[at], value[at])
            code[at[spikes(tm, xm, course, half, limit)[row, place]]] = 3
    return code


def _batch(ids, image, field, code, value) -> pa.RecordBatch:
    hit = np.flatnonzero(code)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.array(image[hit].astype(np.int32)), pa.array([field] * len(hit), pa.string()), pa.array(REASONS[code[hit]].tolist(), pa.string()), pa.array(value[hit])],
        names=SCHEMA.names,
    )


def implausible_series(readings: DataFrame, stacks: DataFrame, field: str = "ph_uw") -> DataFrame:
    """Implausible readings of a long table (ps_id, image_ix, acq_day, stack_id, value, loaded_at); the course is slow motion and season."""
    repeat = {r[0]: r[1] for r in stacks.select("stack_id", "repeat_days").dropna().collect()}
    rows = current(readings, "ps_id", "image_ix", [field, "acq_day", "stack_id"]).where(F.col(field).isNotNull() & ~F.isnan(field) & ~F.col(field).isin(*NO_DATA))

    def run(batches):
        for chunk in whole_groups(batches):
            ids = numbers(chunk["ps_id"], np.int64, 0)
            start, group, _ = groups_of(ids)
            image, value = numbers(chunk["image_ix"], np.int64, 0), numbers(chunk[field], np.float64, np.nan)
            day, stack = numbers(chunk["acq_day"], np.float64, 0), numbers(chunk["stack_id"], np.int64, -1)
            step = np.array([repeat.get(s, 12) for s in stack[start].tolist()], float)[group]
            # days that are missing follow from the image number and the reading's own neighbours
            known = day >= 1
            base = np.where(known, day - image * step, np.nan)
            total, some = np.bincount(group[known], base[known], len(start)), np.bincount(group[known], minlength=len(start))
            t = np.where(known, day, (total / np.maximum(some, 1))[group] + image * step)
            yield _batch(ids, image, field, judge(group, t, value, len(start), "smooth"), value)

    return by_source(rows.select("ps_id", "image_ix", F.col(field).cast("float"), F.col("acq_day").cast("int"), F.col("stack_id").cast("int")), "ps_id", "image_ix").mapInArrow(run, SCHEMA)


def implausible_arrays(points: DataFrame, field: str = "ph_scn_slave") -> DataFrame:
    """Implausible elements of an array column (one row per source, element k is image k); the course is zero."""
    rows = latest(points.where(F.col("ps_id").isNotNull()), ["ps_id"], [field]).where(F.col(field).isNotNull())

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            value = numbers(flat, np.float64, np.nan)
            group = np.repeat(np.arange(batch.num_rows), size)
            image = np.arange(len(value)) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size)
            take = ~np.isnan(value) & ~np.isin(value, NO_DATA)
            group, value, image = group[take], value[take], image[take]
            ids = numbers(batch.column(0), np.int64, 0)[group]
            yield _batch(ids, image, field, judge(group, image.astype(float), value, batch.num_rows, "zero"), value)

    return rows.select("ps_id", F.col(field).cast("array<float>")).mapInArrow(run, SCHEMA)
