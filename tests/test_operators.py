"""Stack operators: fixtures with known answers, sources, sinks, parameters, numerical kernels."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.functions import kernels
from siltgrid.operators import components, correction, mesh, network, pairs, patches, phasegrid, ranking, topofit, unwrapping, weeding
from siltgrid.params import Params, deramp_list, image_list, prepare_modes
from siltgrid.sources import metadata, rasters, vectors

# ---------------------------------------------------------------- sources


def test_complex_raster_blocks_and_padding(spark, tmp_path):
    rng = np.random.RandomState(9876)
    z = (rng.normal(size=(8, 10)) + 1j * rng.normal(size=(8, 10))).astype("<c8")
    path = tmp_path / "a.slc"
    path.write_bytes(z.tobytes()[:-24])  # the last three samples are missing
    df = rasters.read_raster(spark, str(path), width=10, length=8, dtype="c64", block=3)
    got = df.orderBy("az", "rg").toPandas()
    want = z.copy()
    want[7, 7:] = 0
    assert len(got) == 80 and np.array_equal((got.re + 1j * got.im).to_numpy().astype("c8").reshape(8, 10), want)
    with pytest.raises(Exception, match="virtual"):
        rasters.read_raster(spark, str(tmp_path / "a.vrt"), width=10, dtype="c64").collect()


@pytest.mark.parametrize("scheme", ["BIL", "BIP", "BSQ"])
def test_band_schemes_and_sidecar(spark, tmp_path, scheme):
    a = np.arange(4 * 5 * 2, dtype=">f4").reshape(4, 5, 2)
    flat = {"BIP": a, "BIL": a.transpose(0, 2, 1), "BSQ": a.transpose(2, 0, 1)}[scheme]
    path = tmp_path / "los.rdr"
    path.write_bytes(np.ascontiguousarray(flat).tobytes())
    (tmp_path / "los.rdr.xml").write_text(f"<x><property name='WIDTH'><value>5</value></property><property name='number_bands'><value>2</value></property><property name='data_type'><value>float</value></property><property name='scheme'><value>{scheme}</value></property></x>")
    got = rasters.read_raster(spark, str(path), band=2, endian="big", length=4, block=2).orderBy("az", "rg").toPandas()
    assert np.array_equal(got.value.to_numpy().reshape(4, 5), a[:, :, 1])


def test_gather_and_mask(spark, tmp_path):
    (tmp_path / "h").write_bytes(np.arange(12, dtype="<f4").tobytes())
    (tmp_path / "m").write_bytes(bytes([0, 1] + [0] * 6))  # shorter than the raster: the rest is unmasked
    h = rasters.read_raster(spark, str(tmp_path / "h"), width=4)
    pts = spark.createDataFrame([(1, 2, 3), (2, 9, 9)], "pid long, az int, rg int")
    assert {r.pid: r.hgt for r in rasters.gather(pts, h, {"value": "hgt"}).collect()} == {1: 11.0, 2: None}
    mask = rasters.read_raster(spark, str(tmp_path / "m"), width=4, dtype="u1")
    assert rasters.unmasked(h, mask).count() == 11


def test_text_metadata(tmp_path):
    (tmp_path / "b.txt").write_text("Bperp (average): -12.5\n")
    assert metadata.average_baseline(tmp_path / "b.txt") == -12.5
    (tmp_path / "o").write_text("# x\n20200101 5\n20200113 15\nbad 1\n")
    assert metadata.baseline_overview(tmp_path / "o", 20200101, [20200113, 20200125]) == [10.0, 0.0]
    (tmp_path / "p").write_text("20200101,20200113 # first\n\n20200113 20200125\n")
    assert metadata.pair_list(tmp_path / "p") == [(20200101, 20200113), (20200113, 20200125)]
    (tmp_path / "c").write_text("x/20200113/a.slc 2.5\nx/20200101/a.slc 2.0\n")
    assert metadata.calibration_list(tmp_path / "c", 20200101) == [(20200113, 2.5)]
    with pytest.raises(ValueError):
        metadata.by_date(["a/20200101.slc", "b/20200101.slc"])
    for d, name, size in (("20200101", "a.slc", 5), ("20200101", "a.slc.full", 3), ("20200113", "b.slc", 1)):
        (tmp_path / "S" / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / "S" / d / name).write_bytes(b"x" * size)
    assert {k: v.rsplit("/", 1)[1] for k, v in metadata.discover_images(tmp_path / "S").items()} == {20200101: "a.slc.full", 20200113: "b.slc"}
    (tmp_path / "I" / "20200101_20200113").mkdir(parents=True)
    (tmp_path / "I" / "20200101_20200113" / "filt_x.int").write_bytes(b"")
    assert list(metadata.discover_pairs([tmp_path / "I"])) == [(20200101, 20200113)]
    assert metadata.nearest_shape(12, 40, 30) == (3, 4) and metadata.nearest_shape(1200, 40, 30) == (30, 40)
    assert metadata.reference_date({}, ["20200101_20200113", "20200101_20200125", "20200113_20200125"]) == 20200101


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 45.0, -3.5, None), (2, 10.1, 45.1, 2.0, 1.0)], "pid long, lon double, lat double, vel double, D20200101 double")
    vectors.write_geojson(df, str(tmp_path / "g"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert {x["properties"]["pid"]: x["geometry"]["coordinates"] for x in lines} == {1: [10.0, 45.0], 2: [10.1, 45.1]}
    assert vectors.write_geopackage(df, str(tmp_path / "x.gpkg")) == 2
    import sqlite3

    assert sqlite3.connect(tmp_path / "x.gpkg").execute("select count(*), sum(vel) from points").fetchone() == (2, -1.5)
    vectors.write_stage(df.withColumn("patch", F.lit(3)), str(tmp_path / "s"), "patch")
    assert spark.read.parquet(str(tmp_path / "s")).where("patch = 3").count() == 2
    assert len(vectors.with_wkb(df).first().geometry) == 21


def test_parameters(tmp_path):
    p = Params()
    assert p.get("density_rand") == 20 and Params(small_baseline=True).get("density_rand") == 2
    assert p.get("clap_al") == 1.0 and p.set("clap_alpha", 0.5).get("clap_alpha") == 0.5
    assert p.set("clap_alpha", 0.5).set("clap_alpha", math.nan).get("clap_alpha") == 1.0
    with pytest.raises(KeyError, match="could be"):
        p.get("clap")
    q = Params({"ref_x": 1.0}, {"ref_x": 2.0, "ref_y": 3.0})
    assert q.get("ref_x") == 2.0 and q.get("ref_y") == 3.0  # local values need no base entry
    p.write(tmp_path / "parms.json")
    assert Params.load(tmp_path).get("weed_max_noise") == math.inf
    assert image_list("[1, 3 99]", 5) == [0, 2] and image_list(None, 5) == [] and deramp_list("all", [0, 2], 5) == [0, 1] and deramp_list([3], [0, 2], 5) == [1]
    assert prepare_modes("auto", True, False) == ["sb"] and prepare_modes("ps,sb", False, False) == ["ps", "sb"]


# ---------------------------------------------------------------- graph and numerics


def test_patch_bounds_take_the_remainder():
    b = patches.patch_bounds(10, 8, 3, 2, 1)
    assert len(b) == 6 and b[-1] == (6, 6, 10, 4, 8, 7, 10, 5, 8) and b[0] == (1, 1, 4, 1, 5, 1, 3, 1, 4)


def test_pairs(spark):
    axis = pairs.image_axis(spark.createDataFrame([("2020-01-01",), ("2020-01-25",), ("2020-01-13",), ("2020-01-13",), (None,)], "d string"), "d")
    assert [(r.img1, r.img2) for r in pairs.consecutive_pairs(axis, 1).orderBy("ifg_ix").collect()] == [(0, 1), (1, 2)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (30, 31), (31, 30)] + [(100 + i, 101 + i) for i in range(70)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges for n in e if n != 20}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_distributed_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("v"), "id")
    got = ranking.distributed_rank(df, ["g"], [F.col("v"), F.col("id")]).toPandas()
    want = got.sort_values(["g", "v", "id"]).groupby("g").cumcount()
    assert (got.sort_values(["g", "v", "id"])["rank"] == want).all()


def test_adjacent_groups_split_a_line(spark):
    """Cells 1, 3, 4, 2 in a row are two groups: each goes with its least neighbour."""
    pts = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (4, 0, 2), (2, 0, 3)], "id long, az int, rg int").withColumn("s", F.lit(1))
    got = {r.node: r.component for r in weeding.adjacent_groups(weeding.neighbour_arcs(pts, ["s"], "id")).collect()}
    assert got == {1: 1, 3: 1, 4: 2, 2: 2}


def test_topofit_recovers_slope():
    rng = np.random.RandomState(3)
    b = rng.uniform(-200, 200, 20)
    k = rng.uniform(-0.02, 0.02, 50)
    z = np.exp(1j * (k[:, None] * b + 0.7))
    got = topofit.topofit(z, b, 2.0)
    assert np.allclose(got[0], k, atol=2e-4) and np.allclose(got[1], 0.7, atol=0.02) and (got[2] > 0.999).all()  # one refinement step
    z[0, 3] = 0
    k0, _, coh, *_ = topofit.topofit(z, b, 2.0)
    assert np.isnan(k0[0]) and coh[0] == 0


def test_filters_keep_smooth_phase():
    i, j = np.mgrid[:48, :48]
    z = np.exp(1j * (0.08 * i + 0.13 * j + 0.4 * np.sin(i / 5)))
    g = kernels.goldstein(z, 32, 0.8)
    assert np.allclose(np.abs(g), 1, atol=2e-6) and np.abs(g.imag).mean() > 0.2
    noisy = z * np.exp(1j * np.random.RandomState(1).normal(0, 0.7, z.shape))
    error = lambda x: np.abs(np.angle(x * np.conj(z))).mean()
    assert error(kernels.clap(noisy)) < 0.6 * error(noisy) and error(kernels.goldstein(noisy)) < 0.8 * error(noisy)


def test_upsampling_and_null_model():
    assert np.allclose(kernels.upsampled(np.ones(40))[150:250], 1, atol=0.02)
    a = kernels.random_coherence(np.linspace(-100, 100, 12), 1.0, 3000)
    assert a.sum() == 3000 and np.array_equal(a, kernels.random_coherence(np.linspace(-100, 100, 12), 1.0, 3000))


def test_delaunay_circles_are_empty():
    p = np.random.RandomState(2).rand(120, 2)
    t = mesh.delaunay(p)
    for a, b, c in t:
        m = np.array([p[b] - p[a], p[c] - p[a]]) * 2
        centre = np.linalg.solve(m, [p[b] @ p[b] - p[a] @ p[a], p[c] @ p[c] - p[a] @ p[a]])
        r = np.linalg.norm(p[a] - centre)
        assert (np.linalg.norm(p - centre, axis=1) >= r - 1e-9).all()
    hull_edges = 3 * len(t) - 2 * (len(mesh.edges_of(t)))
    assert len(p) - len(mesh.edges_of(t)) + len(t) == 1 and hull_edges <= 0  # planar
    assert len(mesh.delaunay(np.array([[0, 0], [1, 1], [2, 2.0]]))) == 0


def test_integration_over_parts():
    rng = np.random.RandomState(4)
    x = rng.normal(size=(30, 2))
    e = np.array([(i, j) for i in range(20) for j in range(i + 1, min(20, i + 4))] + [(20 + i, 21 + i) for i in range(9)])
    got = mesh.integrate(e, x[e[:, 1]] - x[e[:, 0]], 30)
    want = x - np.where(np.arange(30)[:, None] < 20, x[0], x[20])
    assert np.allclose(got, want, atol=1e-6)


def test_unwrap_grid_arcs(spark):
    """Six cells that part by more than half a turn from the first to the last date: a window of a few days tells how (one of 730 does not)."""
    cell = np.array([[0, 0], [0, 1], [0, 2], [2, 0], [2, 1], [2, 2]])
    day, rate = np.array([-24.0, -12.0, 0.0, 12.0, 24.0]), 0.7 * np.arange(6)
    owner = mesh.nearest_nodes((3, 3), cell)
    arcs, rows, columns = mesh.grid_arcs(owner)
    assert rows.shape == (2, 3) and columns.shape == (3, 2)
    for at in zip(*np.nonzero(rows)):
        e, (i, j) = rows[at], at
        assert tuple(arcs[abs(e) - 1]) == tuple(sorted((owner[i, j], owner[i + 1, j]))) and (e > 0) == (owner[i, j] < owner[i + 1, j])
    pairs_of, truth = [(2, k) for k in range(5) if k != 2], rate[:, None] * day[None] / 12
    pairs_phase = truth[:, [j for _, j in pairs_of]] - truth[:, [2]]
    cells = [(k, int(cell[p, 0]), int(cell[p, 1]), float(np.cos(v)), float(np.sin(v))) for p in range(6) for k, v in enumerate(pairs_phase[p])]
    df = spark.createDataFrame(cells, "img int, gi int, gj int, re double, im double")
    got = unwrapping.unwrap_space_time(df, pairs_of, day.tolist(), [10.0, -20.0, 30.0, 5.0], "3D", 6.0, None, filtered=False).toPandas()
    out = np.full((6, 4), np.nan)
    for r in got.itertuples():
        out[[tuple(c) for c in cell.tolist()].index((r.gi, r.gj)), r.img] = r.ph
    assert np.allclose((out - out[:1]) - (pairs_phase - pairs_phase[:1]), 0, atol=1e-6)


def test_unwrap_fixture_with_its_own_places_and_window(spark):
    """The published fixture as it stands: places in metres, a window of 730 days. Two points share a cell; series are finite and cells filled."""
    xy = [(0, 0), (200, 0), (600, 0), (0, 400), (400, 400), (600, 600)]
    day, rate = np.array([-24.0, -12.0, 0.0, 12.0, 24.0]), 0.7 * np.arange(6)
    pairs_of = [(2, k) for k in range(5) if k != 2]
    points = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid int, all int, x double, y double")
    cell = {r.pid: (r.gi, r.gj) for r in phasegrid.with_cells(points, ["all"], 200.0).collect()}
    assert {i for c in cell.values() for i in c} <= {0, 1, 2} and cell[4] == cell[5] == (2, 2)
    owner = mesh.nearest_nodes((3, 3), np.array(sorted(set(cell.values()))))
    _, rows, columns = mesh.grid_arcs(owner)
    assert rows.shape == (2, 3) and columns.shape == (3, 2)
    samples = spark.createDataFrame([(k, *cell[p], float(rate[p] * day[j] / 12)) for p in range(6) for k, (_, j) in enumerate(pairs_of)], "img int, gi int, gj int, p double")
    got = unwrapping.unwrap_space_time(phasegrid.accumulate(samples, ["img", "gi", "gj"], "p"), pairs_of, day.tolist(), [0.0] * 4, "3D_FULL", 730.0, None, filtered=False).toPandas()
    assert len(got) == 4 * len(set(cell.values())) and np.isfinite(got.ph).all()


@pytest.mark.parametrize("method,pairs_of", [("3D", [(5, k) for k in range(11) if k != 5]), ("3D_QUICK", [(k, k + d) for k in range(11) for d in (1, 2) if k + d < 11]), ("3D", [(k, k + d) for k in range(11) for d in (1, 2) if k + d < 11])])
def test_arcs_in_time(method, pairs_of):
    """Slope and motion of arcs, over a single reference and over a pair network."""
    rng = np.random.RandomState(2)
    day, b = 24.0 * np.arange(11), rng.uniform(-100, 100, 11)
    speed, k = rng.uniform(-1, 1, 40) * (0.4 if method == "3D" and pairs_of[0][0] == 5 else 0.8), rng.uniform(-0.01, 0.01, 40)
    series = speed[:, None] * day[None] / 24 + k[:, None] * b[None] + rng.normal(0, 0.05, (40, 11))
    first, second = np.array(pairs_of).T
    truth = series[:, second] - series[:, first]
    base = b[second] - b[first]
    kind, low = unwrapping.promoted(method, pairs_of)
    assert (kind, low) == (("3D_FULL", False) if pairs_of[0][0] == 5 else (method, method == "3D"))
    got, noise = unwrapping.unwrap_arcs(np.exp(1j * truth), pairs_of, day, base, kind, 730.0, 2.0)
    assert np.isfinite(noise).all() and np.allclose(got, truth, atol=1e-6)


def test_noisy_arcs_say_nothing():
    rng = np.random.RandomState(3)
    noise = unwrapping.unwrap_arcs(np.exp(1j * rng.uniform(-3.14, 3.14, (50, 40))), [(0, k) for k in range(1, 41)], 24.0 * np.arange(41), np.zeros(40), "3D_FULL", 730.0, None)[1]
    assert np.isnan(noise).all(1).mean() > 0.9 and (np.isnan(noise).all(1) | np.isfinite(noise).all(1)).all()
    assert np.isnan(unwrapping.unwrap_arcs(np.ones((2, 3), complex), [(0, 1), (1, 2), (0, 2)], np.arange(3.0), np.zeros(3), "2D", 1.0, None)[1]).all()


def test_unwrapping_rewraps_to_input():
    i, j = np.mgrid[:30, :20]
    truth = 0.4 * i + 0.25 * j + 2 * np.sin(i / 6)
    got = unwrapping.unwrap_grid(unwrapping.wrap(truth))
    assert np.allclose(got - got[0, 0], truth - truth[0, 0], atol=1e-9)
    noisy = unwrapping.wrap(truth + np.random.RandomState(1).normal(0, 1.5, truth.shape))
    noisy[3, 4] = np.nan
    out = unwrapping.unwrap_grid(noisy)
    assert np.allclose(unwrapping.wrap(out - noisy)[np.isfinite(noisy)], 0, atol=1e-9) and np.isnan(out[3, 4])


def test_network_inversion():
    net = [(0, 1), (1, 2), (0, 2), (2, 3)]
    x = np.array([0, 1.0, -0.5, 2.0])
    m = network.inverse(net, 4)
    assert np.allclose(m @ (network.design(net, 4) @ x), x)
    assert network.covariance_of_images(m, [1, 1, 1, 1]).shape == (4, 4)
    a = np.stack([np.ones(5), np.arange(5.0)], 1)
    assert np.allclose(network.lscov(a, np.diag([1, 2, 3, 4, 5.0])) @ (a @ [2, 3]), [2, 3])


def test_polynomial_ramps(spark):
    rng = np.random.RandomState(5)
    x, y = rng.uniform(0, 5000, 300), rng.uniform(0, 5000, 300)
    p = 0.3 + 0.2 * x / 1000 - 0.1 * y / 1000 + 0.05 * (x / 1000) ** 2
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(x, y, p)] + [(2, 0.0, 0.0, 1.0)], "image_ix int, x double, y double, ph double")
    got = {r.image_ix: r.coefficients for r in correction.polynomial_ramps(df, ["image_ix"], "ph", 2.0).collect()}
    assert np.allclose(got[1], [0.3, 0.2, -0.1, 0, 0.05, 0], atol=1e-6) and got[2] is None


def test_streamed_sums(spark, tmp_path):
    from siltgrid.streaming import acquisitions

    df = spark.range(60).selectExpr("id % 3 as ps_id", "cast(id as int) * 6 as day", "cast(id % 3 as double) * id * 0.1 as ph")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    acquisitions.follow(stream, str(tmp_path / "out"), 0.0, str(tmp_path / "progress")).awaitTermination()
    got = {r.ps_id: (r.slope, r.n) for r in acquisitions.slopes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert {k: n for k, (_, n) in got.items()} == {0: 20, 1: 20, 2: 20} and all(abs(s - k * 0.1 / 6) < 1e-9 for k, (s, _) in got.items())
