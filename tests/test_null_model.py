"""The null model of random phases is the full draw, in the registered query and in the chain."""

import numpy as np

from siltgrid.functions.kernels import random_coherence
from siltgrid.params import Params
from siltgrid.plans import analysis, pipeline

POINT = "pid long, patch int, x double, y double, lon double, lat double, d_a double, hgt double, ph array<double>"


def test_query_draws_all_samples(spark):
    rows = analysis.null_histogram(spark, "").collect()
    assert sum(r.n for r in rows) == 300_000
    assert [r.n for r in rows] == random_coherence(np.array(analysis.BASELINE[:16]), 1.0, 300_000).tolist()


def test_chain_scales_the_full_draw(spark):
    rng = np.random.RandomState(3)
    images = pipeline.Images([737000.0 + 12 * k for k in range(8)], [0.0, 40.0, -70.0, 15.0, 90.0, -30.0, 60.0, -110.0], 0)
    rows = [(i, 1, float(x), float(y), 10.0, 45.0, 0.2, 100.0, rng.uniform(-3, 3, 8).tolist()) for i, (x, y) in enumerate(rng.uniform(0, 100, (400, 2)))]
    _, null = pipeline.estimate_gamma(spark.createDataFrame(rows, POINT), images, Params().set("gamma_max_iterations", 1.0))
    full = random_coherence(np.array(images.bperp), images.wraps, 300_000)
    np.testing.assert_allclose(null / null.sum(), full / full.sum())
