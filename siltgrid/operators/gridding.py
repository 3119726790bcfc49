"""Irregular readings onto a regular grid by compact-kernel local polynomial regression.

Each source has its own grid: slot k is the period whose middle is first + k * period. A reading is indexed by
its slot; a grid time is evaluated from the readings of the slots within the kernel's half-width, weighted by
the Epanechnikov kernel, by a local line (a local mean where the readings do not carry a line). Every slot of
every source comes out with its effective support (sum w)^2 / sum w^2 and a mark:
'observed' (it holds a reading), 'filled' (none, but enough support), 'missing' (too little support, value null).

Defined cases: readings that are null, NaN, infinite or a no-data code, or without a day, are no readings; a reading
on the border of two slots belongs to the later one; days beyond the grid belong to its first or last slot, whose value is
their mean where the kernel reaches no reading; sources without readings give a row per slot, all missing;
readings of unknown sources and sources of unknown stacks give nothing; of versions of one reading the latest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.series import by_source, current, groups_of, numbers, whole_groups
from siltgrid.session import latest

#: No-data codes of a phase.
NO_DATA = (-9999.0, -32768.0)
STATUS = np.array(["missing", "filled", "observed"])

SCHEMA = T.StructType(
    [
        T.StructField("ps_id", T.LongType()),
        T.StructField("stack_id", T.IntegerType()),
        T.StructField("slot_ix", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n_readings", T.IntegerType()),
        T.StructField("support", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)


def usable(values: np.ndarray) -> np.ndarray:
    return np.isfinite(values) & ~np.isin(values, NO_DATA)


def evaluate(group, centre_of, day, value, n_groups, first, period, n_slots, half_width, least_support):
    """Kernel regression for many sources at once.

    group, day, value: the usable readings. first, period, n_slots: of each source. Returns arrays over
    (source, slot) up to the longest grid: value, readings, support, status code.
    """
    width = int(n_slots.max()) if n_groups else 0
    size = n_groups * width
    reach = int(np.floor(half_width + 0.5))
    own, mean = np.zeros(size, np.int64), np.zeros(size)
    sums = [np.zeros(size) for _ in range(6)]
    if len(group):
        slot = np.clip(centre_of, 0, n_slots[group] - 1)
        own = np.bincount(group * width + slot, minlength=size)
        mean = np.bincount(group * width + slot, value, size) / np.maximum(own, 1)
        for shift in range(-reach, reach + 1):
            at = slot + shift
            u = (day - first[group]) / period[group] - at
            w = 1 - (u / half_width) ** 2
            ok = (w > 0) & (at >= 0) & (at < n_slots[group])
            where, w, u, y = group[ok] * width + at[ok], w[ok], u[ok], value[ok]
            for k, x in enumerate((w, w * u, w * u * u, w * y, w * u * y, w * w)):
                sums[k] += np.bincount(where, x, size)
    s0, s1, s2, t0, t1, q = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        support = np.where(q > 0, s0 * s0 / q, 0.0)
        spread = s0 * s2 - s1 * s1
        line = (s2 * t0 - s1 * t1) / spread
        # two readings carry a line, unless both lie so far to one side that it would be drawn out of them
        lined = (support >= 1.6) & (spread > 0.05 * s0 * s0) & (np.abs(s1) < 1.0 * s0)
        fit = np.where(lined, line, t0 / s0)
    status = np.where(own > 0, 2, np.where(support >= least_support, 1, 0))
    fit = np.where((status > 0) & (s0 > 0), fit, np.where(own > 0, mean, np.nan))
    return fit, own, support, status


def regular_grid(
    sources: DataFrame,
    readings: DataFrame,
    stacks: DataFrame,
    half_width: float = 2.5,
    least_support: float = 1.5,
    only_empty: bool = False,
) -> DataFrame:
    """One row per source and slot of its stack's grid.

    sources: ps_id, stack_id, loaded_at. readings: ps_id, image_ix, acq_day, ph_uw, loaded_at. stacks: the grids, a
    dimension table that is held in every task (a row per stack, with three numbers each).
    half_width: of the kernel in periods. least_support: effective readings that a filled value needs.
    only_empty: leave out the slots that hold a reading.
    """
    grids = {r[0]: r[1:] for r in stacks.select("stack_id", "first_day", "repeat_days", "n_slots").dropna().collect()}
    head = latest(sources.where(F.col("ps_id").isNotNull()), ["ps_id"], ["stack_id"]).select(
        "ps_id", F.lit(-1).alias("image_ix"), F.col("stack_id").cast("int"), F.lit(None).cast("int").alias("acq_day"), F.lit(None).cast("float").alias("ph_uw")
    )
    tail = current(readings, "ps_id", "image_ix", ["acq_day", "ph_uw"]).where(
        (F.col("acq_day") >= 1) & F.col("ph_uw").isNotNull() & (F.col("image_ix") >= 0)
    )
    rows = head.unionByName(tail.select("ps_id", F.col("image_ix").cast("int"), F.lit(None).cast("int").alias("stack_id"), "acq_day", F.col("ph_uw").cast("float")))

    def run(batches):
        for chunk in whole_groups(batches):
            ids = numbers(chunk["ps_id"], np.int64, 0)
            start, group, _ = groups_of(ids)
            image, stack = numbers(chunk["image_ix"], np.int64, 0), numbers(chunk["stack_id"], np.int64, -1)
            known = np.array([image[s] == -1 and int(stack[s]) in grids for s in start])
            first, period, n_slots = (np.array([grids[int(stack[s])][k] if ok else (0, 1, 0)[k] for s, ok in zip(start, known)]) for k in range(3))
            day, value = numbers(chunk["acq_day"], np.float64, 0), numbers(chunk["ph_uw"], np.float64, np.nan)
            take = (image >= 0) & known[group] & usable(value) & (n_slots[group] > 0)
            g, d = group[take], day[take]
            slot = np.floor((d - first[g]) / period[g] + 0.5).astype(np.int64)
            fit, own, support, status = evaluate(g, slot, d, value[take], len(start), first, period, n_slots, half_width, least_support)
            width = int(n_slots.max()) if len(n_slots) else 0
            source, at = np.repeat(np.arange(len(start)), width), np.tile(np.arange(width), len(start))
            keep = at < n_slots[source]
            if only_empty:
                keep &= own == 0
            source, at = source[keep], at[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[start][source]),
                    pa.array(stack[start][source].astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array((first[source] + at * period[source]).astype(np.int32)),
                    pa.array(fit[keep], from_pandas=True),
                    pa.array(own[keep].astype(np.int32)),
                    pa.array(support[keep]),
                    pa.array(STATUS[status[keep]]),
                ],
                names=SCHEMA.names,
            )

    return by_source(rows, "ps_id", "image_ix").mapInArrow(run, SCHEMA)
