"""Missing values filled from a Chow-Liu dependency tree over discretised and categorical fields.

Five fields describe a reading: its image (stack and image number), its day, its level, and the levels of the source's
readings before and after it. Levels are values standardised by the source's own median and median absolute
deviation and cut into LEVELS bins. One pass over all rows counts every pair of fields (no sample); the maximum
spanning tree of their mutual information is the dependency tree. For each reading with a missing value, message
passing on the tree gives the posterior of the missing field; it is decoded to the mode (day) or to the median of
the mode's bin, put back on the source's own scale (level).

Defined cases: a value is missing if it is null, NaN, a no-data code or no day, whatever the other field holds; infinite
values are not missing but teach nothing; of versions of one reading the latest counts; a source without a usable
value is filled on the scale of all sources (median 0, deviation 1); exact ties of a posterior go to the smaller
code; where no row at all has a field, its fills stay null and are still marked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.series import by_source, current, groups_of, numbers, whole_groups
from siltgrid.operators.spikes import NO_DATA, _dense, _median, like_lengths
from siltgrid.session import stored

FIELDS = ("image", "day", "level", "before", "after")
IMAGE, DAY, LEVEL, BEFORE, AFTER = range(5)
PAIRS = [(a, b) for a in range(5) for b in range(a + 1, 5)]
#: Bins of a standardised level: edges from -6 to 6, and a tail on either side.
EDGES = np.round(np.arange(-6, 6.01, 0.25), 2)
LEVELS = len(EDGES) + 1
#: Cells of a table of messages; it bounds memory only.
CELLS = 4_000_000
#: Cells of a standardised level from which a bin's median is read.
FINE = 0.01

_WORK = T.StructType(
    [
        T.StructField("pair", T.IntegerType()),
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ps_id", T.LongType()),
        T.StructField("image_ix", T.IntegerType()),
        T.StructField("codes", T.ArrayType(T.LongType())),
        T.StructField("median", T.DoubleType()),
        T.StructField("deviation", T.DoubleType()),
    ]
)
SCHEMA = T.StructType(
    [
        T.StructField("ps_id", T.LongType()),
        T.StructField("image_ix", T.IntegerType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("filled_value", T.DoubleType()),
        T.StructField("posterior", T.DoubleType()),
    ]
)


def missing_value(y: np.ndarray) -> np.ndarray:
    return np.isnan(y) | np.isin(y, NO_DATA)


def image_code(stack: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Stack and image as one code; -1 where the stack is unknown."""
    return np.where(stack >= 0, stack * 65536 + image, -1)


def _encode(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of left-packed rows: level, level before and level after, standardised values, median and deviation of each row."""
    n, width = m.shape
    median = np.nan_to_num(_median(m), nan=0.0)
    deviation = 1.4826 * _median(np.abs(m - median[:, None]))
    deviation = np.where(np.isnan(deviation), 1.0, np.maximum(deviation, 1e-3))
    z = (m - median[:, None]) / deviation[:, None]
    level = np.where(np.isnan(z), -1, np.digitize(np.nan_to_num(z), EDGES))
    at = np.broadcast_to(np.arange(width), level.shape)
    before = np.maximum.accumulate(np.where(level >= 0, at, -1), 1)
    before = np.c_[np.full(n, -1), before[:, :-1]]
    after = np.minimum.accumulate(np.where(level >= 0, at, width)[:, ::-1], 1)[:, ::-1]
    after = np.c_[after[:, 1:], np.full(n, width)]
    lb = np.where(before >= 0, np.take_along_axis(level, before.clip(0), 1), -1)
    la = np.where(after < width, np.take_along_axis(level, after.clip(0, width - 1), 1), -1)
    return level, lb, la, z, median, deviation


def encode(start: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level, level before and level after of each reading (-1: none), its standardised value, and each source's median and deviation.

    Sources start at `start`; those of like length are taken together, so memory follows the readings.
    """
    y = np.where(np.isfinite(value) & ~np.isin(value, NO_DATA) & (np.abs(value) <= 500), value, np.nan)
    sizes = np.diff(np.r_[start, len(value)])
    codes = [np.full(len(y), -1, np.int64) for _ in range(3)]
    z, median, deviation = np.full(len(y), np.nan), np.zeros(len(start)), np.ones(len(start))
    for of in like_lengths(sizes):
        row = np.repeat(np.arange(len(of)), sizes[of])
        place = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, sizes[of][:-1]]), sizes[of])
        at = start[of][row] + place
        (m,) = _dense(row, place, len(of), y[at])
        *found, zm, median[of], deviation[of] = _encode(m)
        for into, f in zip([*codes, z], [*found, zm]):
            into[at] = f[row, place]
    return *codes, z, median, deviation


class Counts:
    """Sparse counts of code pairs, merged now and then so that memory follows the number of distinct pairs."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.held = 0

    def add(self, pair: int, a: np.ndarray, b: np.ndarray) -> None:
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        if not len(ua):
            return
        cell = ia.astype(np.int64) * len(ub) + ib
        if len(ua) * len(ub) <= 4_000_000:
            n = np.bincount(cell, minlength=len(ua) * len(ub))
            at = np.flatnonzero(n)
            n = n[at]
        else:
            at, n = np.unique(cell, return_counts=True)
        self.parts.setdefault(pair, []).append((ua[at // len(ub)], ub[at % len(ub)], n))
        self.held += len(at)
        if self.held > 2_000_000:
            self.merge()

    def merge(self) -> None:
        for pair, parts in self.parts.items():
            a, b, n = (np.concatenate(x) for x in zip(*parts))
            t = pd.DataFrame({"a": a, "b": b, "n": n}).groupby(["a", "b"], sort=False)["n"].sum().reset_index()
            self.parts[pair] = [(t.a.to_numpy(), t.b.to_numpy(), t.n.to_numpy())]
        self.held = sum(len(p[0][0]) for p in self.parts.values())


def _count_batch(pair, a, b, n) -> pa.RecordBatch:
    size = len(a)
    none = lambda kind: pa.nulls(size, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, pair, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(n.astype(np.int64)),
         none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int64())), none(pa.float64()), none(pa.float64())],
        names=_WORK.names,
    )


def _study(batches):
    """One pass: counts of all field pairs, and the rows that miss a value, with their codes."""
    counts = Counts()
    for chunk in whole_groups(batches):
        ids = numbers(chunk["ps_id"], np.int64, 0)
        start, group, _ = groups_of(ids)
        image, stack = numbers(chunk["image_ix"], np.int64, 0), numbers(chunk["stack_id"], np.int64, -1)
        day, value = numbers(chunk["acq_day"], np.int64, 0), numbers(chunk["ph_uw"], np.float64, np.nan)
        level, before, after, z, median, deviation = encode(start, value)
        codes = [image_code(stack, image), np.where(day >= 1, day, -1), level, before, after]
        for k, (i, j) in enumerate(PAIRS):
            ok = (codes[i] >= 0) & (codes[j] >= 0)
            counts.add(k, codes[i][ok], codes[j][ok])
        ok = level >= 0
        counts.add(-1, level[ok], np.round(z[ok].clip(-50, 50) / FINE).astype(np.int64))
        # a level whose reading is out of bounds is no missing value: only the true gaps go on
        lost = np.flatnonzero(missing_value(value) | (day < 1))
        if len(lost):
            table = np.stack([c[lost] for c in codes], 1)
            table[:, LEVEL] = np.where(missing_value(value[lost]), -1, np.where(level[lost] < 0, -2, level[lost]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(lost) + 1, 5, dtype=np.int32)), pa.array(table.ravel().astype(np.int64)))
            zero = pa.array(np.full(len(lost), -2, np.int32))
            none = pa.nulls(len(lost), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [zero, none, none, none, pa.array(ids[lost]), pa.array(image[lost].astype(np.int32)), lists, pa.array(median[group[lost]]), pa.array(deviation[group[lost]])],
                names=_WORK.names,
            )
    counts.merge()
    for pair, ((a, b, n),) in counts.parts.items():
        yield _count_batch(pair, a, b, n)


def mutual_information(counts: DataFrame) -> dict[int, float]:
    """Nats shared by the fields of each pair."""
    ab = counts.where("pair >= 0")
    a, b = ab.groupBy("pair", "a").agg(F.sum("n").alias("na")), ab.groupBy("pair", "b").agg(F.sum("n").alias("nb"))
    total = ab.groupBy("pair").agg(F.sum("n").alias("all"))
    joined = ab.join(a, ["pair", "a"]).join(b, ["pair", "b"]).join(total, "pair")
    part = F.col("n") / F.col("all") * F.log(F.col("n").cast("double") * F.col("all") / (F.col("na").cast("double") * F.col("nb")))
    return {r[0]: r[1] for r in joined.groupBy("pair").agg(F.sum(part)).collect()}


def spanning_tree(weight: dict[int, float]) -> list[int]:
    """Pairs of the maximum spanning tree (or forest, where pairs were never seen together)."""
    root = list(range(len(FIELDS)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    tree = []
    for pair in sorted(weight, key=lambda p: (-weight[p], p)):
        i, j = (find(x) for x in PAIRS[pair])
        if i != j:
            root[j] = i
            tree.append(pair)
    return tree


class Table:
    """Smoothed joint counts of a field `to` (rows) and a field `source` (columns), held sparse: every cell has `eps` more than is kept."""

    def __init__(self, to: np.ndarray, source: np.ndarray, n: np.ndarray, shape: tuple[int, int], smoothing: float):
        self.shape, self.eps = shape, smoothing / (shape[0] * shape[1])
        self.total = np.bincount(to, n, shape[0]) + self.eps * shape[1]
        order = np.lexsort((to, source))
        self.to, self.share = to[order], (n / self.total[to])[order]
        self.start = np.searchsorted(source[order], np.arange(shape[1] + 1))
        by = np.lexsort((source, to))
        self.row, self.first = np.unique(to[by], return_index=True)
        self.column, self.weight = source[by], (n / self.total[to])[by]

    def dense(self) -> np.ndarray:
        m = np.full(self.shape, self.eps)
        column = np.repeat(np.arange(self.shape[1]), np.diff(self.start))
        m[self.to, column] += self.share * self.total[self.to]
        return m

    def of(self, at: np.ndarray) -> np.ndarray:
        """P(source is at | to) for each at, over all of `to`."""
        out = np.tile(self.eps / self.total, (len(at), 1))
        size = self.start[at + 1] - self.start[at]
        row = np.repeat(np.arange(len(at)), size)
        k = np.repeat(self.start[at], size) + np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size)
        out[row, self.to[k]] += self.share[k]
        return out

    def sum_over(self, belief: np.ndarray) -> np.ndarray:
        """Sum over the source of belief times P(source | to)."""
        out = belief.sum(1, keepdims=True) * (self.eps / self.total)
        step = max(1, CELLS // max(1, len(self.column)))
        for lo in range(0, len(belief), step):
            part = belief[lo : lo + step][:, self.column] * self.weight
            if part.shape[1]:
                out[lo : lo + step, self.row] += np.add.reduceat(part, self.first, axis=1)
        return out


class Tree:
    """Conditional tables along the edges of the dependency tree, and message passing on them.

    Tables hold the pairs that were seen, so they grow with the images and days and not with the product of the two.
    """

    def __init__(self, edges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], smoothing: float = 0.05):
        self.domain: dict[int, np.ndarray] = {}
        for pair, (a, b, _) in edges.items():
            for field, codes in zip(PAIRS[pair], (a, b)):
                self.domain[field] = np.union1d(self.domain.get(field, np.empty(0, np.int64)), codes)
        self.tables: dict[tuple[int, int], Table] = {}
        self.neighbours: dict[int, list[int]] = {}
        for pair, (a, b, n) in edges.items():
            i, j = PAIRS[pair]
            x, y = np.searchsorted(self.domain[i], a), np.searchsorted(self.domain[j], b)
            shape = (len(self.domain[i]), len(self.domain[j]))
            self.tables[i, j], self.tables[j, i] = Table(x, y, n, shape, smoothing), Table(y, x, n, shape[::-1], smoothing)
            self.neighbours.setdefault(i, []).append(j)
            self.neighbours.setdefault(j, []).append(i)

    @property
    def joint(self) -> dict[tuple[int, int], np.ndarray]:
        """The tables written out, for small domains."""
        return {pair: t.dense() for pair, t in self.tables.items()}

    def _place(self, field: int, codes: np.ndarray) -> np.ndarray:
        """Places of codes in a field's domain; -1 where unseen or missing."""
        d = self.domain[field]
        at = np.searchsorted(d, codes).clip(0, len(d) - 1)
        return np.where(d[at] == codes, at, -1)

    def _message(self, source: int, to: int, codes: np.ndarray) -> np.ndarray:
        """What the subtree of `source` says of `to`: rows by the domain of `to`."""
        table = self.tables[to, source]
        at = self._place(source, codes[:, source])
        out = np.ones((len(codes), len(self.domain[to])))
        seen, hidden = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        if len(seen):
            out[seen] = table.of(at[seen])
        others = [k for k in self.neighbours[source] if k != to]
        if len(hidden) and others:
            belief = np.prod([self._message(k, source, codes[hidden]) for k in others], axis=0)
            out[hidden] = table.sum_over(belief)
        return out / out.max(1, keepdims=True)

    def posterior(self, field: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mode and its posterior for each row; codes holds -1 where a field is missing."""
        p = np.tile(self.tables[field, self.neighbours[field][0]].total, (len(codes), 1))
        for k in self.neighbours[field]:
            p *= self._message(k, field, codes)
            p /= p.max(1, keepdims=True)
        p /= p.sum(1, keepdims=True)
        mode = p.argmax(1)
        return self.domain[field][mode], p[np.arange(len(p)), mode]

    def rows_at_once(self) -> int:
        """Rows whose messages fit into CELLS cells."""
        return max(1, CELLS // max((len(d) for d in self.domain.values()), default=1))


def bin_medians(level: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of each level bin from its fine cells; NaN for empty bins."""
    out = np.full(LEVELS, np.nan)
    for k in np.unique(level):
        at = level == k
        order = np.argsort(cell[at])
        c, m = cell[at][order], np.cumsum(n[at][order])
        out[k] = c[np.searchsorted(m, m[-1] / 2)] * FINE
    return out


def fill_missing(readings: DataFrame) -> DataFrame:
    """Each missing value of phuw2-like readings (ps_id, image_ix, stack_id, acq_day, ph_uw, loaded_at), filled and marked.

    What reaches the driver, and every executor once as a broadcast, are the counts of the tree's four edges: at most (images
    of all stacks) x LEVELS cells and the image-day pairs that occur, a size set by the dimension tables and not by the readings.
    """
    rows = current(readings, "ps_id", "image_ix", ["stack_id", "acq_day", "ph_uw"])
    rows = rows.select("ps_id", F.col("image_ix").cast("int"), F.col("stack_id").cast("int"), F.col("acq_day").cast("long"), F.col("ph_uw").cast("double"))
    work = stored(by_source(rows, "ps_id", "image_ix").mapInArrow(_study, _WORK), "imputation")
    counts = stored(work.where("pair > -2").groupBy("pair", "a", "b").agg(F.sum("n").alias("n")), "imputation-counts")
    tree = spanning_tree(mutual_information(counts))
    got = counts.where(F.col("pair").isin([-1, *tree])).toPandas()
    part = lambda p: tuple(got[got.pair == p][c].to_numpy() for c in ("a", "b", "n"))
    shared = readings.sparkSession.sparkContext.broadcast((Tree({p: part(p) for p in tree}), bin_medians(*part(-1))))

    def fill(batches):
        model, medians = shared.value
        size = min(2000, model.rows_at_once())
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, len(FIELDS))
            ids, image = batch.column("ps_id"), batch.column("image_ix")
            median, deviation = (batch.column(c).to_numpy() for c in ("median", "deviation"))
            for field, name in ((LEVEL, "ph_uw"), (DAY, "acq_day")):
                at = np.flatnonzero(codes[:, field] == -1)
                for part in (at[k : k + size] for k in range(0, len(at), size)):
                    if field in model.neighbours:
                        mode, p = model.posterior(field, codes[part])
                        value = medians[mode] * deviation[part] + median[part] if field == LEVEL else mode.astype(float)
                    else:
                        value, p = np.full(len(part), np.nan), np.zeros(len(part))
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), image.take(take), pa.array([name] * len(part)), pa.array(value, from_pandas=True), pa.array(p)], names=SCHEMA.names
                    )

    return work.where("pair = -2").select("ps_id", "image_ix", "codes", "median", "deviation").mapInArrow(fill, SCHEMA)
