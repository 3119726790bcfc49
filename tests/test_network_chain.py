"""The chain on a planted pair network, and going on from tables in a folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import network
from siltgrid.params import Params
from siltgrid.plans import pipeline

POINT = "pid long, patch int, x double, y double, lon double, lat double, d_a double, hgt double, inc double, ph array<double>"
N = 10
PAIRS = [(k, k + d) for k in range(N) for d in (1, 2) if k + d < N]


def stack(spark, pairs):
    rng = np.random.RandomState(7)
    n, day = 240, [737000.0 + 24 * k for k in range(N)]
    bperp = [0.0 if k == 3 else float(v) for k, v in enumerate(rng.uniform(-120, 120, N))]
    images = pipeline.Images(day, bperp, 3, pairs=pairs)
    x, y = rng.uniform(0, 1500, n), rng.uniform(0, 1500, n)
    velocity = 8.0 * x / 1500
    k = rng.uniform(-0.004, 0.004, n)
    series = -velocity[:, None] * (np.array(day) - day[3])[None] / 365.25 * 4 * np.pi / 56 + k[:, None] * np.array(bperp)[None]
    ph = np.stack([series[:, j] - series[:, i] for i, j in pairs], 1) if pairs else series
    ph = ph + rng.normal(0, 0.03, ph.shape)
    if not pairs:
        ph[:, 3] = 0
    bad = np.arange(n) % 9 == 0
    ph[bad] = rng.uniform(-np.pi, np.pi, (bad.sum(), ph.shape[1]))
    rows = [(i, 1, float(x[i]), float(y[i]), float(10 + x[i] / 9e4), float(45 + y[i] / 1.11e5), 0.2, 100.0, 0.6, np.angle(np.exp(1j * ph[i])).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, POINT), images, velocity, bad


@pytest.fixture(scope="module")
def network_run(spark, tmp_path_factory):
    df, images, velocity, bad = stack(spark, PAIRS)
    params = Params(small_baseline=True).set("select_method", "PERCENT").set("merge_resample_size", 0.0)
    folder = f"file://{tmp_path_factory.mktemp('stages')}"
    return pipeline.run(df, images, params, folder=folder, corrections="v-d"), df, images, params, velocity, bad, folder


def test_network_velocities(network_run):
    done, _, images, _, velocity, bad, _ = network_run
    out = done["export"].toPandas()
    good = out[~bad[out.pid.to_numpy()]]
    assert len(good) > 180 and bad[out.pid.to_numpy()].mean() < 0.1
    v = good.vel.to_numpy() - velocity[good.pid.to_numpy()]
    assert np.median(np.abs(v - np.median(v))) < 0.5
    assert done["covariance"].shape == (N, N) and np.all(np.linalg.eigvalsh(done["covariance"]) > -1e-12) and not done["covariance"][3].any()
    row = done["unwrap"].select("uw", "misfit").first()
    assert len(row.uw) == N and row.uw[3] == 0 and len(row.misfit) == len(PAIRS)


def test_run_goes_on_from_the_folder(spark, network_run):
    done, df, images, params, _, _, folder = network_run
    stages = pipeline.Stages(spark, folder)
    assert stages.done() == list(pipeline.STEPS)
    again = pipeline.run(df, images, params, folder=folder)
    assert again["export"].count() == done["export"].count()
    before = done["export"].select("pid", F.round("vel", 6)).collect()
    pipeline.run(df, images, params, start="scla", end="scla", folder=folder)
    assert stages.done() == ["gamma", "select", "weed", "correct", "merge", "unwrap", "scla"]
    pipeline.run(df, images, params, folder=folder, corrections="v-d")
    after = stages.read("export").select("pid", F.round("vel", 6)).collect()
    assert sorted(before) == sorted(after)


def test_cells_of_a_network(spark, network_run):
    done, df, images, params, velocity, bad, _ = network_run
    coarse = params.set("merge_resample_size", 100.0)
    merged = pipeline.merge_patches(done["correct"], images, coarse).toPandas()
    points = done["correct"].toPandas()
    assert 20 < len(merged) < len(points) and set(merged.pid) <= set(points.pid)
    state = {**{s: done[s] for s in ("gamma", "select", "weed", "correct")}, "null": done["null"]}
    out = pipeline.run(df, images, coarse, start="merge", state=state, corrections="v-d")["export"].toPandas()
    v = out.vel.to_numpy() - 8.0 * (out.lon.to_numpy() - 10) * 9e4 / 1500
    assert np.median(np.abs(v - np.median(v))) < 0.5


def test_options_of_the_single_reference_chain(spark):
    """Dropped images, ramps, delays, L1, weights by signal over noise, part-time rejection."""
    df, images, velocity, bad = stack(spark, [])
    df = df.withColumn("tropo_a_l", F.array(*(F.lit(0.01 * k) for k in range(N))))
    params = Params().set("select_method", "PERCENT").set("drop_ifg_index", [5]).set("scla_method", "L1").set("filter_weighting", "SNR")
    params = params.set("gamma_stdev_reject", 0.3).set("scn_deramp_ifg", "all").set("scla_drop_index", "2").set("subtr_tropo", "y").set("scla_deramp", "n")
    out = pipeline.run(df, images, params, corrections="v-d")["export"].toPandas()
    good = out[~bad[out.pid.to_numpy()]]
    assert len(good) > 150
    v = good.vel.to_numpy() - velocity[good.pid.to_numpy()]
    assert np.median(np.abs(v - np.median(v))) < 0.6


def test_what_is_refused(spark):
    df, images, _, _ = stack(spark, [])
    with pytest.raises(ValueError, match="unwrap_alpha"):
        pipeline.run(df, images, Params().set("unwrap_alpha", 4.0))
    with pytest.raises(ValueError, match="corrections"):
        pipeline.export_points(df.withColumnRenamed("ph", "uw"), images, "v-x")
    with pytest.raises(ValueError, match="scla"):
        pipeline.export_points(df.withColumnRenamed("ph", "uw"), images, "v-d")


def test_incidence_falls_back(spark):
    rows = spark.createDataFrame([(0.0, 0.5), (0.6, 0.7)], "inc double, la double")
    assert pipeline.mean_incidence(rows) == 0.6
    assert pipeline.mean_incidence(rows.withColumn("inc", F.lit(0.0))) == pytest.approx(0.652)
    assert pipeline.mean_incidence(rows.select(F.lit(1).alias("x"))) == pytest.approx(np.radians(21))


def test_velocity_by_covariance(spark):
    """Generalised least squares against the closed form."""
    rng = np.random.RandomState(1)
    images = pipeline.Images([737000.0 + 12 * k for k in range(7)], [0.0] * 7, 2)
    a = rng.normal(0, 1, (7, 7))
    cov = a @ a.T + np.eye(7)
    u = rng.normal(0, 1, (5, 7))
    df = spark.createDataFrame([(i, 1.0, 1.0, r.tolist()) for i, r in enumerate(u)], "pid long, lon double, lat double, uw array<double>")
    got = {r.pid: r.vel for r in pipeline.export_points(df, images, "v", cov, [4]).collect()}
    use = [0, 1, 3, 5, 6]
    t = np.stack([np.ones(5), np.array(images.day)[use] - images.day[2]], 1)
    w = np.linalg.inv(cov[np.ix_(use, use)])
    slope = np.linalg.solve(t.T @ w @ t, t.T @ w @ u[:, use].T)[1]
    assert np.allclose([got[i] for i in range(5)], slope * -365.25 / (4 * np.pi) * 56, atol=1e-8)
    assert np.allclose(network.lscov(t, cov[np.ix_(use, use)])[1] @ u[:, use].T, slope)


def test_noise_weeding_of_a_network(spark):
    """With finite thresholds, arcs of pairs less their slope tell noisy points; the default thresholds keep all."""
    rng = np.random.RandomState(4)
    n = 150
    images = pipeline.Images([737000.0 + 24 * k for k in range(N)], [0.0, 60.0, -40.0, 0.0, 90.0, -70.0, 30.0, 110.0, -20.0, 50.0], 3, pairs=PAIRS)
    b = np.array(images.phase_bperp)
    k, noisy = rng.uniform(-0.003, 0.003, n), np.arange(n) % 8 == 0
    ph = k[:, None] * b + rng.normal(0, 0.1, (n, len(PAIRS)))
    ph[noisy] = rng.uniform(-np.pi, np.pi, (noisy.sum(), len(PAIRS)))
    rows = [(i, 1, float(x), float(y), 9.0, float(k[i]), 0.0, 0.9, ph[i].tolist()) for i, (x, y) in enumerate(rng.uniform(0, 2000, (n, 2)))]
    df = spark.createDataFrame(rows, "pid long, patch int, x double, y double, hgt double, k2 double, c2 double, coh2 double, ph array<double>")
    params = Params(small_baseline=True)
    assert pipeline.weed_points(df, images, params).count() == n
    kept = pipeline.weed_points(df, images, params.set("weed_standard_dev", 0.8)).toPandas().pid.to_numpy()
    assert (~noisy)[kept].sum() == (~noisy).sum() and noisy[kept].sum() == 0
