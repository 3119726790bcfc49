"""General data-preparation operators against brute force, and their edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import copies, gridding, imputation, near, regions, spikes, timestamps
from siltgrid.plans.preparation import WRITERS

T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
POINT = "ps_id long, stack_id int, lon double, lat double, loaded_at timestamp"
READING = "stack_id int, ps_id long, image_ix int, acq_day int, ph_uw float, loaded_at timestamp"
STACK = "stack_id int, first_day int, repeat_days int, n_slots int, master_day int, site_tz string"
STACKS = [(1, 1000, 10, 5, 1020, "Europe/Rome"), (2, 2000, 6, 4, 2006, None)]
nan = float("nan")


# ---------------------------------------------------------------- 1


def brute_near(rows, radius):
    def pos(lon, lat):
        a, b = np.radians(lon), np.radians(lat)
        return near.EARTH * np.array([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])

    ok = [(i, pos(x, y)) for i, x, y in rows if x is not None and y is not None and np.isfinite(x) and np.isfinite(y) and abs(y) <= 90 and (x, y) != (0, 0)]
    return {(min(i, j), max(i, j)) for k, (i, p) in enumerate(ok) for j, q in ok[k + 1 :] if i != j and np.linalg.norm(p - q) <= radius}


def test_near_pairs_match_brute_force(spark):
    rng = np.random.RandomState(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(179.9999 + rng.uniform(-2e-4, 2e-4, 150), 60 + rng.uniform(-2e-4, 2e-4, 150)))]
    rows = [(i, x - 360 if i % 3 == 0 else x, y) for i, x, y in rows] + [(900, None, 1.0), (901, nan, 1.0), (902, 0.0, 0.0), (903, 10.0, 91.0), (904, 5.0, 90.0), (905, 90.0, 90.0)]
    df = near.with_positions(spark.createDataFrame(rows, "ps_id long, lon double, lat double"))
    got = [(r[0], r[1]) for r in near.near_pairs(df, "ps_id", 15.0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows, 15.0)
    assert (904, 905) in set(got)  # the pole is one place


def test_near_of_empty(spark):
    df = near.with_positions(spark.createDataFrame([], "ps_id long, lon double, lat double"))
    assert near.near_pairs(df, "ps_id", 15.0).count() == 0


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, 0)):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


OUTLINES = [
    (1, "POLYGON ((0 0, 10 0, 10 10, 5 4, 0 10, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1), (6 1, 6 3, 8 3, 8 1, 6 1))"),
    (2, "MULTIPOLYGON (((20 0, 24 0, 24 4, 20 4, 20 0)), ((30 0, 34 0, 32 5, 30 0), (31 1, 33 1, 32 3, 31 1)))"),
    (3, "POLYGON ((178 -1, 182 -1, 182 1, 178 1, 178 -1))"),
    (4, None),
    (5, "POLYGON EMPTY"),
    (6, "nonsense"),
]


@pytest.mark.parametrize("block", [1000, 5])
def test_regions_match_even_odd(spark, block):
    rng = np.random.RandomState(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-1, 36, 400), rng.uniform(-1, 11, 400)))]
    rows += [(1000, -179.5, 0.2), (1001, 180.5, 0.2), (1002, 539.0, 0.2), (1003, None, None), (1004, nan, 0.0)]
    df = spark.createDataFrame(rows, "ps_id long, lon double, lat double").withColumn("outline", F.lit("clash"))
    areas = spark.createDataFrame(OUTLINES, "area_id long, outline string").withColumn("ps_id", F.lit(0))
    got = [(r[0], r[1]) for r in regions.containing_regions(df, areas, "ps_id", block=block, part=7).collect()]
    want = set()
    for a, text in OUTLINES[:2]:
        for rings in regions.parse_outline(text):
            want |= {(a, i) for i, x, y in rows[:400] if inside(rings, x, y)}
    want |= {(3, 1000), (3, 1001), (3, 1002)}
    assert len(got) == len(set(got)) and set(got) == want


def test_ear_clipping_keeps_area():
    rng = np.random.RandomState(3)
    for _ in range(60):
        angle = np.sort(rng.uniform(0, 2 * np.pi, rng.randint(5, 40)))
        if np.diff(np.r_[angle, angle[0] + 2 * np.pi]).max() > 2.5:
            continue
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(1, 3, len(angle))[:, None]
        hole = np.stack([np.cos(angle[::-1]), np.sin(angle[::-1])], 1) * 0.2
        t = regions.ear_clip([ring, hole])
        area = np.abs(regions._cross(t[:, 0], t[:, 1], t[:, 2])).sum() / 2
        assert area == pytest.approx(abs(regions.signed_area(ring)) - abs(regions.signed_area(hole)), rel=1e-9)


# ---------------------------------------------------------------- 2


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.RandomState(4)
    for _ in range(40):
        n = rng.randint(1, 6)
        m = n + rng.randint(0, 2)
        c = rng.randint(0, 4, (n, m)).astype(float)
        got = copies.assign(c)
        assert len(set(got.tolist())) == n
        assert c[np.arange(n), got].sum() == min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_compare_copies(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, nan), ("a", 3, 5.0), (None, 4, 1.0), ("b", 1, 1.0), ("b", 1, 9.0), ("c", 1, float("inf"))], "k string, i int, v double").withColumn("x", F.lit(1))
    right = spark.createDataFrame([("a", 1, 1.00000001), ("a", 2, None), ("a", 4, 5.0), (None, 4, 2.0), ("b", 1, 9.00001), ("b", 1, 2.0), ("c", 1, float("inf"))], "k string, i int, v double").withColumn("x", F.lit("clash"))
    got = {(r.k, r.i, r.kind, r.l_v, r.r_v) for r in copies.compare_copies(left, right, ["k", "i"], ["v"]).collect()}
    kinds = {(k, i, kind) for k, i, kind, *_ in got}
    assert kinds == {("a", 1, "same"), ("a", 2, "same"), ("a", 3, "only_left"), ("a", 4, "only_right"), (None, 4, "differs"), ("b", 1, "same"), ("b", 1, "differs"), ("c", 1, "same")}
    assert ("b", 1, "same", 9.0, 9.00001) in got  # least cost pairs what agrees
    counted = copies.compare_copies(left, right, ["k", "i"], ["v"], repeats="count")
    assert counted.where("k = 'a' and i = 1 and kind = 'only_left'").count() == 1


def test_compare_hot_key_and_empty(spark):
    hot = spark.range(700).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    moved = hot.select("k", (F.col("v") + 1e-6).alias("v"))
    r = copies.compare_copies(hot, moved, ["k"], ["v"]).groupBy("kind").count().collect()
    assert {x[0]: x[1] for x in r} == {"same": 700}
    none = hot.where("false")
    assert copies.compare_copies(none, none, ["k"], ["v"]).count() == 0
    assert copies.compare_copies(hot, none, ["k"], ["v"]).where("kind = 'only_left'").count() == 700


# ---------------------------------------------------------------- 3


def test_grid_marks_and_values(spark):
    points = spark.createDataFrame([(1, 2, 0.0, 0.0, T0), (1, 1, 0.0, 0.0, T1), (2, 1, 0.0, 0.0, T0), (3, 9, 0.0, 0.0, T0), (None, 1, 0.0, 0.0, T0)], POINT)
    line = [(1, 1, k, 1000 + 10 * k + d, 2.0 + 0.3 * (10 * k + d), T0) for k, d in ((0, 0), (1, 2), (3, -1), (4, 1))]
    bad = [(1, 1, 7, 1020, -9999.0, T0), (1, 1, 8, 1020, nan, T0), (1, 1, 9, None, 3.0, T0), (1, 1, 10, -5, 3.0, T0), (1, 1, 11, 1020, 1.0, T0), (1, 1, 11, 1020, None, T1), (1, 5, 0, 1000, 1.0, T0), (1, None, 0, 1000, 1.0, T0)]
    out = gridding.regular_grid(points, spark.createDataFrame(line + bad, READING), spark.createDataFrame(STACKS, STACK)).collect()
    by = {(r.ps_id, r.slot_ix): r for r in out}
    assert set(by) == {(1, k) for k in range(5)} | {(2, k) for k in range(5)}
    assert [by[1, k].status for k in range(5)] == ["observed", "observed", "filled", "observed", "observed"]
    for k in range(5):  # a local line gives a line back
        assert by[1, k].value == pytest.approx(2.0 + 3.0 * k, abs=1e-5)
    assert all(by[2, k].status == "missing" and by[2, k].value is None and by[2, k].n_readings == 0 for k in range(5))


def test_grid_of_empty(spark):
    none = gridding.regular_grid(spark.createDataFrame([], POINT), spark.createDataFrame([], READING), spark.createDataFrame(STACKS, STACK))
    assert none.count() == 0


# ---------------------------------------------------------------- 4


def test_spikes_runs_and_jumps(spark):
    rng = np.random.RandomState(6)
    n = 36
    base = 0.02 * np.arange(n) + 0.5 * np.sin(np.arange(n) * 24 / 365.25 * 2 * np.pi) + np.clip(rng.normal(0, 0.05, n), -0.14, 0.14)
    one, two, jump, stuck, wild = (base.copy() for _ in range(5))
    one[7] += 1.2
    two[20:22] -= 1.0
    jump[15:] += 6.28
    stuck[10:14] = stuck[10]
    wild[3], wild[30] = np.inf, -900
    series = dict(enumerate([one, two, jump, stuck, wild, np.zeros(n) + 1.0 * 0]))
    rows = [(1, p, k, 700000 + 24 * k, float(np.float32(v)), T0) for p, s in series.items() for k, v in enumerate(s)]
    rows += [(1, 0, 50, 700000 + 24 * 50, -9999.0, T0), (1, 0, 51, None, None, T0), (1, 9, 0, 700000, 1.0, T0)]
    stacks = spark.createDataFrame([(1, 24)], "stack_id int, repeat_days int")
    got = {(r.ps_id, r.image_ix, r.reason) for r in spikes.implausible_series(spark.createDataFrame(rows, READING), stacks).collect()}
    want = {(0, 7, "spike"), (1, 20, "spike"), (1, 21, "spike"), (4, 3, "bound"), (4, 30, "bound")}
    want |= {(3, k, "stuck") for k in range(10, 14)} | {(5, k, "stuck") for k in range(n)}
    assert got == want


def test_spikes_in_arrays(spark):
    rng = np.random.RandomState(7)
    a = np.clip(rng.normal(0, 0.1, 30), -0.28, 0.28).astype(float).tolist()
    a[4], a[12], a[20] = 2.0, None, nan
    rows = [(1, a, T1), (1, [9.0] * 30, T0), (2, None, T0), (3, [], T0), (4, [1.0], T0), (None, [1.0] * 5, T0)]
    df = spark.createDataFrame(rows, "ps_id long, ph_scn_slave array<float>, loaded_at timestamp")
    assert {(r.ps_id, r.image_ix, r.reason) for r in spikes.implausible_arrays(df).collect()} == {(1, 4, "spike")}


def test_one_long_source_among_short_ones():
    """Memory follows the readings, and what is found does not depend on the company."""
    import tracemalloc

    rng = np.random.RandomState(11)
    sizes = np.r_[np.full(30_000, 5), 200_000, np.full(30_000, 5)]
    group = np.repeat(np.arange(len(sizes)), sizes)
    value = np.clip(rng.normal(0, 1, len(group)), -2.8, 2.8)
    at = np.cumsum(np.r_[0, sizes])[30_000]
    hit = at + np.arange(50, 200_000, 9_973)
    value[hit] += 30
    noisy = slice(at + 100_000, at + 200_000)
    value[noisy] *= 3  # its own normal behaviour changes half way
    value[hit[hit >= at + 100_000]] += 60
    tracemalloc.start()
    code = spikes.judge(group, np.arange(len(group)) - at * 1.0, value, len(sizes), "zero")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    long = np.flatnonzero(code[at : at + 200_000]) + at
    assert peak < 1e9 and set(hit) <= set(long) and len(long) <= len(hit) + 20
    alone = spikes.judge(np.zeros(200_000, int), np.arange(200_000) * 1.0, value[at : at + 200_000], 1, "zero")
    assert (alone == code[at : at + 200_000]).all()


def test_spikes_of_empty(spark):
    stacks = spark.createDataFrame([(1, 24)], "stack_id int, repeat_days int")
    assert spikes.implausible_series(spark.createDataFrame([], READING), stacks).count() == 0


# ---------------------------------------------------------------- 5


def test_fills_are_marked_and_close(spark):
    rng = np.random.RandomState(8)
    rows, truth = [], {}
    for p in range(150):
        speed, noise = rng.normal(0, 0.1), 0.03
        for k in range(20):
            v = speed * (k - 10) + rng.normal(0, noise)
            hide = rng.rand() < 0.1
            truth[p, k] = v
            rows.append((1, p, k, None if rng.rand() < 0.1 else 1000 + 12 * k, None if hide else float(v), T0))
    rows += [(None, 500, 0, None, nan, T0), (1, 501, 3, 1036, -32768.0, T0), (1, None, 3, 1036, None, T0)]
    out = imputation.fill_missing(spark.createDataFrame(rows, READING)).collect()
    want = {(r[1], r[2], "ph_uw") for r in rows if r[1] is not None and (r[4] is None or r[4] != r[4] or r[4] == -32768.0)} | {(r[1], r[2], "acq_day") for r in rows if r[1] is not None and r[3] is None}
    assert {(r.ps_id, r.image_ix, r.field_name) for r in out} == want and len(out) == len(want)
    days = [r for r in out if r.field_name == "acq_day" and r.ps_id < 500]
    assert all(r.filled_value == 1000 + 12 * r.image_ix for r in days)
    levels = [r for r in out if r.field_name == "ph_uw" and r.ps_id < 500]
    error = np.median([abs(r.filled_value - truth[r.ps_id, r.image_ix]) for r in levels])
    plain = np.median([abs(np.mean([v for (p, k), v in truth.items() if k == r.image_ix]) - truth[r.ps_id, r.image_ix]) for r in levels])
    assert error < 0.6 * plain


def test_fill_of_empty(spark):
    assert imputation.fill_missing(spark.createDataFrame([], READING)).count() == 0


def test_tree_posterior_is_exact():
    """Message passing against summing over all assignments of a small tree."""
    rng = np.random.RandomState(9)
    edges = {}
    for pair in (imputation.PAIRS.index((0, 2)), imputation.PAIRS.index((2, 3)), imputation.PAIRS.index((2, 4)), imputation.PAIRS.index((0, 1))):
        a, b = np.meshgrid(np.arange(3), np.arange(3), indexing="ij")
        edges[pair] = (a.ravel(), b.ravel(), rng.randint(1, 20, 9))
    tree = imputation.Tree(edges, smoothing=0.0)
    joint = np.ones((3,) * 5)
    # a tree's density with the root at the level: P(root) times each child's table
    letters = "abcde"
    p_level = tree.joint[2, 0].sum(1)
    given = lambda i, j: tree.joint[i, j] / tree.joint[i, j].sum(1, keepdims=True)
    joint = np.einsum("c,ca,cd,ce,ab->" + letters, p_level, given(2, 0), given(2, 3), given(2, 4), given(0, 1))
    mode, p = tree.posterior(2, np.array([[-1, 1, -1, 2, -1]]))
    want = joint[:, 1, :, 2, :].sum((0, 2))
    assert mode[0] == want.argmax() and p[0] == pytest.approx(want.max() / want.sum())


# ---------------------------------------------------------------- 7


def utc(*a):
    return (dt.datetime(*a) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


CASES = [
    ("2020-03-01T10:00:00Z", "log", "Asia/Tokyo", utc(2020, 3, 1, 10)),
    (" 2020-03-01 10:00:00,250\n", "log", "Asia/Tokyo", utc(2020, 3, 1, 1, 0, 0, 250000)),
    ("2020-03-01 10:00", "log", None, utc(2020, 3, 1, 9)),
    ("2020-10-25 02:30", "log", None, utc(2020, 10, 25, 0, 30)),  # twice: the earlier
    ("2020-03-29 02:30", "log", None, utc(2020, 3, 29, 1, 30)),  # skipped: the offset before
    ("05/03/2020 08:00", "log", "UTC", utc(2020, 3, 5, 8)),
    ("05/03/2020 8:00 PM", "isce_us", "UTC", utc(2020, 5, 3, 20)),
    ("12/25/2020 12:05 AM", "isce_us", "UTC", utc(2020, 12, 25, 0, 5)),
    ("31/02/2020 10:00", "log", "UTC", None),
    ("2019-02-29", "log", "UTC", None),
    ("20200301", "log", "bogus/zone", utc(2020, 2, 29, 23)),
    ("20200301T101112", "log", "UTC", utc(2020, 3, 1, 10, 11, 12)),
    ("2020-061T00:00:00", "log", "UTC", utc(2020, 3, 1)),
    ("2019-366T00:00:00", "log", "UTC", None),
    ("737851.25", "matlab", None, utc(2020, 3, 1, 6)),
    ("737485.25", "python", None, utc(2020, 3, 1, 6)),
    ("1583056800", "log", "Asia/Tokyo", utc(2020, 3, 1, 10)),
    ("1583056800123", "log", None, utc(2020, 3, 1, 10, 0, 0, 123000)),
    ("1583056800123456", "log", None, utc(2020, 3, 1, 10, 0, 0, 123456)),
    ("Sun, 01 Mar 2020 10:00:00 GMT", "log", None, utc(2020, 3, 1, 10)),
    ("01-Mar-2020 10:00:00.5", "log", "UTC", utc(2020, 3, 1, 10, 0, 0, 500000)),
    ("Mar 1, 2020 1:00 PM", "log", "UTC", utc(2020, 3, 1, 13)),
    ("2020-03-01 10:00:00 EDT", "log", "UTC", utc(2020, 3, 1, 14)),
    ("2020-03-01 10:00:00 XYZ", "log", "UTC", None),
    ("2020-03-01 10:00:00.000001-0330", "log", "UTC", utc(2020, 3, 1, 13, 30, 0, 1)),
    ("2020-03-01 10:00 Asia/Kathmandu", "log", "UTC", utc(2020, 3, 1, 4, 15)),
    ("2020-03-01 25:00", "log", "UTC", None),
    ("n/a", "log", "UTC", None),
    ("", None, "UTC", None),
    (None, "log", "UTC", None),
]


def test_timestamps(spark):
    log = spark.createDataFrame([(i, 1, w, z, t) for i, (t, w, z, _) in enumerate(CASES)], "rec_id long, stack_id int, writer string, tz_name string, raw string")
    got = {r.rec_id: r.utc_us for r in timestamps.normalise(log, spark.createDataFrame(STACKS, STACK), {"acq_day": "raw"}, conventions=WRITERS).collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][3]} == {} and len(got) == len(CASES)


def test_timestamps_without_any_zone(spark):
    log = spark.createDataFrame([(1, 2, "log", None, "2020-03-01 10:00"), (2, 77, "log", None, "20200301"), (3, 77, "log", None, "1583056800")], "rec_id long, stack_id int, writer string, tz_name string, raw string")
    out = {r.rec_id: (r.utc_us, r.status) for r in timestamps.normalise(log, spark.createDataFrame(STACKS, STACK), {"acq_day": "raw"}).collect()}
    assert out == {1: (None, "none"), 2: (None, "none"), 3: (utc(2020, 3, 1, 10), "ok")}
    assert timestamps.normalise(log.where("false"), spark.createDataFrame(STACKS, STACK), {"acq_day": "raw"}).count() == 0


def test_values_outweigh_a_wrong_convention(spark):
    """A source that writes months first is read so, whatever was thought of it; a text impossible in its format names no time."""
    rows = [(m * 100 + d, 1, w, "UTC", f"{m:02d}/{d:02d}/2020") for w in ("new",) for m in range(1, 13) for d in range(1, 29)]
    rows += [(10_000 + k, 1, "new", "UTC", f"{d}/05/2020") for k, d in enumerate((13, 25, 31))]
    rows += [(20_000, 1, "few", "UTC", "05/25/2020"), (20_001, 1, "few", "UTC", "25/05/2020"), (20_002, 1, "few", "UTC", "05/26/2020")]
    log = spark.createDataFrame(rows, "rec_id long, stack_id int, writer string, tz_name string, raw string")
    stacks = spark.createDataFrame([(1, 737700, 10, 60, 738000, "UTC")], STACK)
    got = {r.rec_id: r for r in timestamps.normalise(log, stacks, {"acq_day": "raw"}, conventions={"slashed": ("dmy", {"new": "dmy"})}).collect()}
    assert all(got[m * 100 + d].utc_us == utc(2020, m, d) for m in range(1, 13) for d in range(1, 29))
    for k, d in enumerate((13, 25, 31)):
        assert (got[10_000 + k].utc_us, got[10_000 + k].status, got[10_000 + k].other_us) == (None, "ambiguous", utc(2020, 5, d))
    assert got[20_000].utc_us == got[20_001].utc_us == utc(2020, 5, 25)  # with few values both readings are in use
