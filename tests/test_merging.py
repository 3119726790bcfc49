"""Merged patches: the winner's row is taken whole, and cells are weighted by what the residuals say."""

import numpy as np
import pytest

from siltgrid.operators import merging

ROW = "id long, az int, rg int, lon double, lat double, patch int, is_inner boolean, coh double, k double"


def test_patches_that_disagree(spark):
    rows = [
        (1, 5, 5, 1.0, 1.0, 1, True, 0.4, 0.1),
        (1, 5, 5, 1.0, 1.0, 2, False, 0.9, 0.2),
        (2, 6, 5, 2.0000001, 1.0, 1, True, 0.4, 0.3),
        (2, 6, 5, 2.0000002, 1.0, 2, False, 0.9, 0.4),
        (3, 7, 5, 3.0, 1.0, 2, False, 0.5, 0.5),
        (3, 7, 5, 3.0, 1.0, 3, True, float("nan"), 0.6),
        (4, 8, 5, 4.0, 1.0, 3, False, None, 0.7),
        (5, 9, 5, 1.0, 1.0, 3, True, 0.7, 0.8),
    ]
    df = spark.createDataFrame(rows, ROW)
    got = {(r.id, r.patch, r.k) for r in merging.merge_points(df, [], "coh", "id").collect()}
    assert got == {(5, 3, 0.8), (2, 1, 0.3), (3, 3, 0.6), (4, 3, 0.7)}  # 1 and 5 share a place, 5 is the more coherent
    assert {r.id for r in merging.merge_points(df, [], "coh", "id", keep_margin=False).collect()} == {2, 3, 5}
    assert merging.merge_points(df.where("false"), [], "coh", "id").count() == 0


def test_cells_are_weighted_by_their_residuals(spark):
    rng = np.random.RandomState(1)
    n, m = 40, 7
    c, res = rng.normal(0, 0.3, n), rng.normal(0, 0.4, (n, m))
    x, y, k, ph = rng.uniform(0, 100, n), rng.uniform(0, 100, n), rng.normal(0, 1, n), rng.uniform(-3, 3, (n, m))
    rows = [(i, float(x[i]), float(y[i]), 0.5, float(k[i]), float(c[i]), i % 5, res[i].tolist(), ph[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x double, y double, coh double, k double, c double, az int, res array<double>, ph array<double>").selectExpr("*", "1 as patch")
    got = merging.resample(df, ["patch"], 40.0, "coh", ["k"], 2.0, "res", "c", False, ("ph",), ("res",), ("az",), m).collect()
    z = np.c_[np.angle(np.exp(1j * (res - c[:, None]))), c]
    w = 1 / np.maximum(z.var(1, ddof=1), np.radians(10) ** 2)
    coh = np.minimum(np.abs(np.exp(1j * z).sum(1)) / m, merging.attainable_coherence())
    snr = 1 / (1 / coh**2 - 1)
    cells = np.stack([np.ceil((y - y.min() + 1e-9) / 40), np.ceil((x - x.min() + 1e-9) / 40)], 1).astype(int)
    assert len(got) == sum(w[(cells == u).all(1)].sum() >= 0.25 for u in np.unique(cells, axis=0))
    for r in got:
        at = (cells == [r.ci, r.cj]).all(1)
        assert r.n == at.sum() and r.weight == pytest.approx(w[at].sum())
        assert r.k == pytest.approx(np.average(k[at], weights=w[at]))
        assert r.az == int(np.round(np.average(np.arange(n)[at] % 5, weights=w[at])))
        assert np.allclose(r.res, np.average(res[at], axis=0, weights=w[at]))
        total = (snr[at, None] * np.exp(1j * ph[at])).sum(0)
        assert np.allclose(r.ph_re, total.real) and np.allclose(r.ph_im, total.imag)
        assert r.coh == pytest.approx(np.sqrt(1 / (1 + 1 / np.sqrt((snr[at] ** 2).sum()))))


def test_weight_floor(spark):
    rows = [(1, 0.0, 0.0, 0.5, 0.0, [3.0, -3.0, 0.5, -1.0]), (2, 90.0, 0.0, 0.5, 0.0, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, x double, y double, coh double, c double, res array<double>").selectExpr("*", "1 as patch")
    assert [r.cj for r in merging.resample(df, ["patch"], 50.0, "coh", [], 1.0, "res", "c", True).collect()] == [2]
