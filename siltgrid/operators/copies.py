"""Differences between two copies of one dataset: rows that one side lacks and fields that differ.

Rows of both copies meet under their key. Identical rows cancel by multiplicity (or all repeats of a row count once).
What is left of a key is paired by minimum-cost assignment on the number of differing fields; rows without a
partner are missing on the other side. Keys with one leftover row per side, the usual case, are compared
without leaving the JVM; only keys with several go to the assignment.

A key of at most WHOLE leftover rows on each side is one assignment. A larger key falls apart exactly: rows that agree in no
field, directly or through others, cost the same whatever they are paired with, so each component of rows linked by
fields they may agree in is assigned by itself, and what it leaves is paired in order over the whole key. Components
larger than WHOLE are first swept along their first field as one sorted stream, in bounded memory: rows equal within
tolerance in all fields cancel, as many as can with one field. With one field that is least cost. With several fields
the rest of such a component is paired by the most fields it is equal in, and that pairing is then solved anew in blocks of WHOLE along
each field until nothing is gained: never worse, but not always of least cost (the README gives the measured loss).

Defined cases: null equals NaN; a null key is a key like any other; equal infinities are equal and any other pair with an
infinity differs; numbers differ beyond tolerance * max(1, |a|, |b|); exact ties of the assignment go to the first
rows in field order; an empty copy leaves every row of the other missing.
"""

from __future__ import annotations

from collections import deque
from itertools import combinations
from math import isinf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.operators.components import components
from siltgrid.operators.ranking import distributed_rank
from siltgrid.session import stored

#: Leftover rows of a key, or of a component of a larger key, that one assignment takes on a side.
WHOLE = 1024


def loose_key(key: Column) -> Column:
    """A key without case, blanks and leading slashes."""
    return F.regexp_replace(F.lower(F.regexp_replace(key, r"\s", "")), "^/+", "")


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost; rows must not outnumber columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            free = np.flatnonzero(~used[1:]) + 1
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _differs(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        na, nb = np.isnan(a), np.isnan(b)
        finite = np.isfinite(a) & np.isfinite(b)
        apart = np.abs(a - b) > tolerance * np.maximum(1, np.maximum(np.abs(a), np.abs(b)))
    return np.where(na | nb, na != nb, np.where(finite, apart, a != b))


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """The same test on columns; NaN has been made null."""
    size = F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).when(finite, F.abs(a - b) > tolerance * size).otherwise(a != b)


def _equal(a: float | None, b: float | None, tolerance: float) -> bool:
    if a is None or b is None:
        return a is b
    return a == b if isinf(a) or isinf(b) else abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))


def swept(rows: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """keys, l_<field>, r_<field>, l__row, r__row, _kind ('same', 'l', 'r'): rows (keys, fields, _row, _side) matched with one equal within tolerance, or alone.

    Each key is a stream sorted by the first field. A row takes the earliest waiting row of the other side; what a
    tolerance has passed can't match any more. With one field that is the largest number of matches.
    """
    kinds = [(f"{s}_{c}", t) for s in "lr" for c, t in [*((c, T.DoubleType()) for c in fields), ("_row", T.LongType())]]
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(v, t) for v, t in kinds), T.StructField("_kind", T.StringType())])
    nothing = (None,) * (len(fields) + 1)

    def run(batches):
        waiting: dict[str, deque] = {"l": deque(), "r": deque()}
        last, out, types = None, [], None

        def alone(key, side, v):
            out.append((*key, *(v if side == "l" else nothing), *(v if side == "r" else nothing), side))

        def expire(side, first):
            while waiting[side] and not _equal(waiting[side][0][0], first, tolerance):
                alone(last, side, waiting[side].popleft())

        def end():
            for side in "lr":
                while waiting[side]:
                    alone(last, side, waiting[side].popleft())

        def batch_of():
            columns = list(zip(*out))
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)
            out.clear()
            return found

        for batch in batches:
            types = [*(batch.schema.field(k).type for k in range(len(keys))), *[*[pa.float64()] * len(fields), pa.int64()] * 2, pa.string()]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, v, side = row[: len(keys)], row[len(keys) : -1], row[-1]
                if key != last:
                    end()
                    last = key
                other = "r" if side == "l" else "l"
                expire("l", v[0])
                expire("r", v[0])
                for at, w in enumerate(waiting[other]):
                    if all(_equal(x, y, tolerance) for x, y in zip(v[1:-1], w[1:-1])):
                        del waiting[other][at]
                        out.append((*key, *(v if side == "l" else w), *(w if side == "l" else v), "same"))
                        break
                else:
                    waiting[side].append(v)
                if len(out) >= 20_000:
                    yield batch_of()
        end()
        if out:
            yield batch_of()

    return rows.select(*keys, *fields, "_row", "_side").repartition(*keys).sortWithinPartitions(*keys, *fields, "_row").mapInArrow(run, schema)


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-4, repeats: str = "once") -> DataFrame:
    """Paired rows of two copies: keys, kind ('same', 'differs', 'only_left', 'only_right'), l_<field>, r_<field>, d_<field>, n.

    repeats: 'once' if exact repeats of a row within a copy mean nothing, 'count' if their number matters.
    Only columns named in keys and fields take part, so extra columns of either side can't clash.
    """
    side = lambda df, mark: df.select(*keys, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in fields), F.lit(mark).alias("_l"), F.lit(1 - mark).alias("_r"))
    both = side(left, 1).unionByName(side(right, 0))
    count = F.max if repeats == "once" else F.sum
    rows = both.groupBy(*keys, *fields).agg(count("_l").cast("long").alias("_l"), count("_r").cast("long").alias("_r"))
    gone = F.least("_l", "_r")
    rows = rows.select(*keys, *fields, gone.alias("_same"), (F.col("_l") - gone).alias("_l"), (F.col("_r") - gone).alias("_r"))
    only = lambda mark, c: F.max(F.when(F.col(mark) > 0, F.col(c)))
    per_key = rows.groupBy(*keys).agg(
        F.sum("_l").alias("nl"), F.sum("_r").alias("nr"), F.sum("_same").alias("same"),
        *(only("_l", c).alias(f"l_{c}") for c in fields), *(only("_r", c).alias(f"r_{c}") for c in fields),
    )
    per_key = stored(per_key, "copies")
    pairs = [F.when(differs(F.col(f"l_{c}"), F.col(f"r_{c}"), tolerance), 1).otherwise(0).alias(f"d_{c}") for c in fields]
    values = [f"{s}_{c}" for s in "lr" for c in fields]
    wanted = [*keys, "kind", *values, *(f"d_{c}" for c in fields), "n"]
    simple = per_key.where("nl <= 1 and nr <= 1 and nl + nr > 0").select(*keys, *values, *pairs, "nl", "nr", F.lit(1).cast("long").alias("n"))
    any_differs = sum((F.col(f"d_{c}") for c in fields), F.lit(0)) > 0
    kind = F.when(F.col("nr") == 0, "only_left").when(F.col("nl") == 0, "only_right").when(any_differs, "differs").otherwise("same")
    out = simple.withColumn("kind", kind).select(*wanted)
    same = per_key.where("same > 0").select(*keys, F.lit("same").alias("kind"), *(F.lit(None).cast("double").alias(c) for c in values), *(F.lit(0).alias(f"d_{c}") for c in fields), F.col("same").alias("n"))
    out = out.unionByName(same)
    many = per_key.where("nl > 1 or nr > 1")
    if many.isEmpty():
        return out
    match = None
    for c in keys:
        on = F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}"))
        match = on if match is None else match & on
    left_over = rows.where("_l > 0 or _r > 0").alias("x").join(many.alias("m"), match, "left_semi")
    # a row's multiplicity is spelt out: each copy is one row to pair
    left_over = left_over.withColumn("_side", F.when(F.col("_l") > 0, "l").otherwise("r")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_l", "_r"))))
    of = left_over.select(*keys, *fields, "_side", "_copy")
    large = many.where((F.col("nl") > WHOLE) | (F.col("nr") > WHOLE)).select(*keys)
    if large.isEmpty():
        return out.unionByName(assigned(of, keys, fields, tolerance).select(*wanted))
    semi = lambda how: of.alias("x").join(large.alias("m"), match, how)
    out = out.unionByName(assigned(semi("left_anti"), keys, fields, tolerance).select(*wanted))
    return out.unionByName(of_large(semi("left_semi"), keys, fields, tolerance).select(*wanted))


def _paired(pairs: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """pairs (keys, l_<field>, r_<field>, _one: 'l', 'r' or null if both are there) with kind, d_<field> and n."""
    d = {c: F.when(F.col("_one").isNotNull() | differs(F.col(f"l_{c}"), F.col(f"r_{c}"), tolerance), 1).otherwise(0).alias(f"d_{c}") for c in fields}
    rows = pairs.select(*keys, *(f"{s}_{c}" for s in "lr" for c in fields), "_one", *d.values())
    any_differs = sum((F.col(f"d_{c}") for c in fields), F.lit(0)) > 0
    kind = F.when(F.col("_one") == "l", "only_left").when(F.col("_one") == "r", "only_right").when(any_differs, "differs").otherwise("same")
    return rows.withColumn("kind", kind).withColumn("n", F.lit(1).cast("long"))


def _in_order(rest: DataFrame, by: list[str], fields: list[str], how: str = "full") -> DataFrame:
    """Rows of both sides paired by their ranks within `by`: by, l_<field>, r_<field>, l__row, r__row, _one."""
    ranked = distributed_rank(rest.select(*by, *fields, "_side", "_row"), [*by, "_side"], [*fields, "_row"])
    side = lambda s: ranked.where(F.col("_side") == s).select(*by, "rank", *(F.col(c).alias(f"{s}_{c}") for c in [*fields, "_row"])).alias(s)
    on = F.col("l.rank") == F.col("r.rank")
    for c in by:
        on &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = side("l").join(side("r"), on, how)
    one = F.when(F.col("r__row").isNull(), "l").when(F.col("l__row").isNull(), "r")
    # a key may be null on the side that is there, so the side is asked and not the value
    key = [F.when(F.col("l__row").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in by]
    return both.select(*key, *(f"{s}_{c}" for s in "lr" for c in [*fields, "_row"]), one.alias("_one"))


def _links(rows: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """(_row, least): rows that may agree in a field, each linked to the least row of its cell of that field's scale.

    A cell is wider than the tolerance and a row is in its own and the next one, so rows that agree share one.
    """
    def cell(c: str) -> Column:
        v = F.col(c)
        scale = F.when(F.abs(v) <= 1, v).otherwise(F.signum(v) * (1 + F.log(F.greatest(F.abs(v), F.lit(1.0)))))
        finite = F.floor(scale / (2 * tolerance)) if tolerance > 0 else F.xxhash64(v)
        own = F.when(v.isNull(), F.lit(-(2**62))).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * 2**61).otherwise(finite.cast("long"))
        return F.array(own, own + 1) if tolerance > 0 else F.array(own)

    said = F.explode(F.array(*(F.struct(F.lit(k).alias("_f"), cell(c).alias("_cells")) for k, c in enumerate(fields)))).alias("_s")
    held = rows.select(*keys, "_row", said).select(*keys, "_row", F.col("_s._f").alias("_f"), F.explode("_s._cells").alias("_cell"))
    least = held.groupBy(*keys, "_f", "_cell").agg(F.min("_row").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    on = (F.col("h._f") == F.col("c._f")) & (F.col("h._cell") == F.col("c._cell"))
    for c in keys:
        on &= F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}"))
    return held.alias("h").join(least.alias("c"), on).where("_row <> _least").select("_row", "_least").distinct()


def _improved(rows: DataFrame, greedy: list[DataFrame], keys: list[str], fields: list[str], tolerance: float, patience: int = 2) -> DataFrame:
    """Pairs that agree in some field, from greedy ones solved anew in blocks until `patience` rounds over all orders gain nothing.

    A block is an exact assignment of WHOLE units (a pair stays together, a lone row is one) that stand close along one field; it holds
    its present pairs, so no round is worse than the one before. Each round orders by another field and shifts the blocks.
    """
    mates = greedy[0]
    for g in greedy[1:]:
        mates = mates.unionByName(g)
    values = [f"{s}_{c}" for s in "lr" for c in fields]
    best, idle, turn, now = -1, 0, 0, None
    while idle < patience * len(fields):
        unit = mates.select(F.explode(F.array("l__row", "r__row")).alias("_row"), F.col("l__row").alias("_unit"))
        held = stored(rows.join(unit, "_row", "left").withColumn("_unit", F.coalesce("_unit", "_row")), "units")
        f = fields[turn % len(fields)]
        # a pair may stand by either row's value, so that rows left over on both sides come to meet it
        at = (F.min if turn // len(fields) % 2 == 0 else F.max)(f).alias("_at")
        ranked = distributed_rank(held.groupBy("_part", "_unit").agg(at), ["_part"], ["_at", "_unit"])
        shift = (turn // len(fields)) * WHOLE // 3
        block = F.floor((F.col("rank") + shift) / WHOLE).alias("_block")
        blocks = held.join(ranked.select(F.col("_part"), "_unit", block), ["_part", "_unit"])
        solved = assigned(blocks, [*keys, "_part", "_block"], fields, tolerance, "_row")
        differing = sum((F.col(f"d_{c}") for c in fields), F.lit(0))
        agreed = solved.where(F.col("_l_row").isNotNull() & F.col("_r_row").isNotNull()).withColumn("_gain", len(fields) - differing).where("_gain > 0")
        found = stored(agreed.select(*keys, *values, F.col("_l_row").alias("l__row"), F.col("_r_row").alias("r__row"), "_gain"), "resolved")
        gain = found.agg(F.sum("_gain")).first()[0] or 0
        now, mates = found, found.select("l__row", "r__row")
        idle = idle + 1 if gain <= best else 0
        best, turn = max(best, gain), turn + 1
    return now.select(*keys, *(f"{s}_{c}" for s in "lr" for c in [*fields, "_row"]), F.lit(None).cast("string").alias("_one"))


def of_large(rows: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """Pairs of the keys with more than WHOLE leftover rows: component by component, then the rest in order."""
    rows = stored(rows.select(*keys, *fields, "_side").withColumn("_row", F.monotonically_increasing_id()), "large-keys")
    labels = components(_links(rows, keys, fields, tolerance), "_row", "_least").select(F.col("node").alias("_row"), F.col("component").alias("_part"))
    labelled = stored(rows.join(labels, "_row", "left"), "large-parts")
    count = lambda s: F.sum(F.when(F.col("_side") == s, 1).otherwise(0))
    sizes = labelled.where("_part is not null").groupBy("_part").agg(count("l").alias("_nl"), count("r").alias("_nr")).where("_nl > 0 and _nr > 0")
    inner = labelled.join(sizes, "_part")
    small = (F.col("_nl") <= WHOLE) & (F.col("_nr") <= WHOLE)
    done = stored(assigned(inner.where(small), [*keys, "_part"], fields, tolerance, "_row"), "large-assigned")
    agreed = done.where(F.col("_l_row").isNotNull() & F.col("_r_row").isNotNull() & (sum((F.col(f"d_{c}") for c in fields), F.lit(0)) < len(fields)))
    found = [agreed.select(*keys, *(f"{s}_{c}" for s in "lr" for c in fields), F.col("_l_row").alias("l__row"), F.col("_r_row").alias("r__row"), F.lit(None).cast("string").alias("_one"))]
    wide = inner.where(~small).select(*keys, "_part", *fields, "_side", "_row")
    if not wide.isEmpty():
        met = stored(swept(wide, [*keys, "_part"], fields, tolerance), "swept")
        shape = met.where("_kind = 'same'").select(*keys, *(f"{s}_{c}" for s in "lr" for c in [*fields, "_row"]), F.lit(None).cast("string").alias("_one"))
        found.append(shape)
        left = met.where("_kind <> 'same'").select(*keys, "_part", *(F.coalesce(f"l_{c}", f"r_{c}").alias(c) for c in [*fields, "_row"]), F.col("_kind").alias("_side"))
        rows_left, greedy = left, []
        for size in range(len(fields) - 1, 0, -1):
            for same in combinations(fields, size):
                pairs = stored(_in_order(left, [*keys, "_part", *same], [c for c in fields if c not in same], "inner"), "greedy")
                greedy.append(pairs.select("l__row", "r__row"))
                gone = pairs.select(F.explode(F.array("l__row", "r__row")).alias("_row"))
                left = stored(left.join(gone, "_row", "left_anti"), "greedy-left")
        if greedy:
            found.append(_improved(rows_left, greedy, keys, fields, tolerance))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    whole = stored(whole, "large-pairs")
    rest = rows.join(whole.select(F.explode(F.array("l__row", "r__row")).alias("_row")), "_row", "left_anti")
    whole = whole.unionByName(_in_order(rest, keys, fields).select(*whole.columns))
    return _paired(whole, keys, fields, tolerance)


def assigned(rows: DataFrame, keys: list[str], fields: list[str], tolerance: float, mark: str | None = None) -> DataFrame:
    """Least-cost pairs of each key as one assignment; mark: a column of the rows that comes out as _l_<mark>, _r_<mark>."""
    values = [f"{s}_{c}" for s in "lr" for c in fields]
    marks = ["_l_row", "_r_row"] if mark else []
    schema = T.StructType(
        [*(rows.schema[k] for k in keys), T.StructField("kind", T.StringType()), *(T.StructField(v, T.DoubleType()) for v in values), *(T.StructField(f"d_{c}", T.IntegerType()) for c in fields),
         T.StructField("n", T.LongType()), *(T.StructField(m, T.LongType()) for m in marks)]
    )

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*fields, *([mark] if mark else [])], na_position="first", kind="stable")
        sides = {s: group[group["_side"] == s] for s in "lr"}
        a, b = (sides[s][fields].to_numpy(float) for s in "lr")
        ids = {s: sides[s][mark].tolist() if mark else None for s in "lr"}
        tail = lambda i, j: [ids["l"][i] if i is not None else None, ids["r"][j] if j is not None else None] if mark else []
        key = [group[k].iloc[0] for k in keys]
        out = []
        mates: dict[int, int] = {}
        if len(a) and len(b):
            d = np.stack([_differs(a[:, None, k], b[None, :, k], tolerance) for k in range(len(fields))], 2)
            cost = d.sum(2).astype(float)
            mates = dict(enumerate(assign(cost).tolist())) if len(a) <= len(b) else {i: j for j, i in enumerate(assign(cost.T).tolist())}
            for i, j in mates.items():
                out.append([*key, "differs" if d[i, j].any() else "same", *a[i], *b[j], *d[i, j].astype(int), 1, *tail(i, j)])
        none = [np.nan] * len(fields)
        out += [[*key, "only_left", *a[i], *none, *[1] * len(fields), 1, *tail(i, None)] for i in range(len(a)) if i not in mates]
        taken = set(mates.values())
        out += [[*key, "only_right", *none, *b[j], *[1] * len(fields), 1, *tail(None, j)] for j in range(len(b)) if j not in taken]
        found = pd.DataFrame(out, columns=schema.names)
        return found.astype({m: "Int64" for m in marks})

    return rows.select(*keys, *fields, "_side", *([mark] if mark else [])).groupBy(*keys).applyInPandas(pair, schema)
