"""The chain of steps on a small planted stack."""

import numpy as np
import pytest

from siltgrid.params import Params
from siltgrid.plans import pipeline


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.RandomState(5)
    n, days = 220, [737000 + 24 * k for k in range(12)]
    bperp = [0.0 if k == 4 else float(v) for k, v in enumerate(rng.uniform(-120, 120, 12))]
    images = pipeline.Images(days, bperp, reference=4)
    x, y = rng.uniform(0, 1500, n), rng.uniform(0, 1500, n)
    velocity = 6.0 * (x / 1500)  # mm a year
    k = rng.uniform(-0.004, 0.004, n)
    years = (np.array(days) - days[4]) / 365.25
    truth = -velocity[:, None] * years[None] * 4 * np.pi / (images.wavelength * 1000)
    ph = truth + k[:, None] * np.array(bperp)[None] + rng.normal(0, 0.05, (n, 12))
    ph[:, 4] = 0
    bad = rng.rand(n) < 0.15
    ph[bad] = rng.uniform(-np.pi, np.pi, (bad.sum(), 12))
    rows = [(i, 1, float(x[i]), float(y[i]), float(10 + x[i] / 9e4), float(45 + y[i] / 1.11e5), 0.2, 100.0, np.angle(np.exp(1j * ph[i])).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "pid long, patch int, x double, y double, lon double, lat double, d_a double, hgt double, ph array<double>")
    params = Params().set("weed_standard_dev", 10.0).set("select_method", "PERCENT").set("percent_rand", 2.0)
    return pipeline.run(df, images, params), velocity, bad, images


def test_random_points_are_left_out(planted):
    done, _, bad, _ = planted
    kept = {r[0] for r in done["select"].select("pid").collect()}
    assert len(kept) > 120
    assert sum(bad[i] for i in kept) < 0.06 * len(kept)


def test_velocity_is_recovered(planted):
    done, velocity, bad, _ = planted
    out = done["export"].toPandas()
    good = out[~out.pid.map(lambda i: bad[i])]
    v = good.vel.to_numpy() - velocity[good.pid.to_numpy()]
    # the low-passed noise step may take a common part off; relative motion must stay
    assert np.median(np.abs(v - np.median(v))) < 1.5
    assert [c for c in out.columns if c.startswith("D")].__len__() == 12


def test_empty_input_stops_early(spark, planted):
    images = planted[3]
    none = spark.createDataFrame([], "pid long, patch int, x double, y double, lon double, lat double, d_a double, hgt double, ph array<double>")
    done = pipeline.run(none, images, end="gamma")
    assert done["gamma"].count() == 0


def test_steps_in_order(planted):
    with pytest.raises(ValueError):
        pipeline.run(None, planted[3], start="export", end="gamma")


def test_reference_area_and_ramps(spark):
    rows = [(k, 10.0 + k, 45.0, 100.0 * k, 7.0 * (k % 3), [0.0, 0.5 * k]) for k in range(8)]
    df = spark.createDataFrame(rows, "pid long, lon double, lat double, x double, y double, uw array<double>")
    boxed = Params().set("ref_lon", [11.5, 13.5])
    assert {r.pid: r.uw[1] for r in pipeline.referenced(df, boxed, 2).collect()} == {k: 0.5 * k - 1.25 for k in range(8)}
    nowhere = Params().set("ref_lon", [50.0, 51.0])
    assert {r.pid: r.uw[1] for r in pipeline.referenced(df, nowhere, 2).collect()} == {k: 0.5 * k - 1.75 for k in range(8)}
    near = Params().set("ref_radius", 1000.0).set("ref_centre_lonlat", [12.0, 45.0])
    assert {r.pid: r.uw[1] for r in pipeline.referenced(df, near, 2).collect()}[2] == 0.0
    assert all(abs(v) < 1e-9 for r in pipeline.deramped_series(df).collect() for v in r.uw)
