"""Noise weeding with the default parameters: all points are triangulated, in bounded tiles, and noisy ones go."""

import numpy as np
import pytest

from siltgrid.operators import mesh, weeding
from siltgrid.params import Params
from siltgrid.plans import analysis, pipeline

ROW = "pid long, patch int, x double, y double, hgt double, k2 double, c2 double, coh2 double, ph array<double>"


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.RandomState(8)
    n, images = 500, pipeline.Images([737000.0 + 12 * k for k in range(16)], analysis.BASELINE[:16], 7)
    b = np.array(images.bperp)
    xy, k, c = rng.uniform(0, 3000, (n, 2)), rng.uniform(-0.02, 0.02, n), rng.uniform(-3, 3, n)
    ph = k[:, None] * b + c[:, None] + rng.normal(0, 0.1, (n, 16))
    noisy = np.arange(n) % 10 == 0
    ph[noisy] = rng.uniform(-np.pi, np.pi, (noisy.sum(), 16))
    ph[:, 7] = 0
    rows = [(i, 1, float(xy[i, 0]), float(xy[i, 1]), 9.0, float(k[i]), float(c[i]), 0.9, ph[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, ROW), images, noisy, xy, k, c, ph


def test_noisy_points_go_and_all_tiles_run(planted):
    df, images, noisy, xy, k, c, ph = planted
    kept = pipeline.weed_points(df, images, Params(), target=60).toPandas()
    assert kept.ps_std.notna().all() and kept.ps_max.notna().all()
    assert noisy[kept.pid].sum() <= 0.2 * noisy.sum()
    assert (~noisy)[kept.pid].sum() == (~noisy).sum()
    # the triangulation of all points at once, written out
    q = ph - k[:, None] * np.array(images.bperp)
    q[:, 7] = c
    e = mesh.edges_of(mesh.delaunay(xy))
    noise, without = weeding.series_noise(np.exp(1j * (q[e[:, 1]] - q[e[:, 0]])), np.array(images.day), 730.0)
    b = np.array(images.bperp)
    w = b / without.var(0, ddof=1)
    noise = noise - ((noise @ w) / (w @ b))[:, None] * b
    least = np.full(len(xy), np.inf)
    for end in (0, 1):
        np.minimum.at(least, e[:, end], noise.std(1, ddof=1))
    assert set(kept.pid) ^ set(np.flatnonzero(least < 1)) <= set(np.flatnonzero(noisy))
    assert len(set(kept.pid) ^ set(np.flatnonzero(least < 1))) <= 3
    off = np.abs(kept.ps_std.to_numpy() - least[kept.pid])
    assert np.median(off) < 0.005 and (off < 0.02).mean() > 0.95


def test_tiles_are_bounded_and_home_is_one(planted):
    df = planted[0]
    t = weeding.tiles(df, "pid", target=60).toPandas()
    assert sorted(t[t.home].pid) == list(range(500))
    assert t.tile.nunique() == 9 and t[t.home].groupby("tile").size().max() < 75
    assert t.groupby("tile").size().max() < 200


def test_chain_query_keeps_the_default_noise_step(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pipeline, "run", lambda p, images, params: seen.append(params) or {"export": p})
    analysis.stack_chain(spark, "/root/testdata/sf0.001")
    assert seen[0].get("weed_standard_dev") == 1.0
