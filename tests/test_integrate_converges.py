"""Node values are the least-squares solution however many rounds that takes, or an error."""

import numpy as np
import pytest

from siltgrid.operators import mesh


def test_long_chain_is_solved():
    n = 4000
    d = np.random.RandomState(2).normal(size=n - 1)
    x = mesh.integrate(np.stack([np.arange(n - 1), np.arange(1, n)], 1), d, n)
    np.testing.assert_allclose(x, np.r_[0, np.cumsum(d)], atol=1e-4)


def test_too_few_rounds_raise():
    edges = np.stack([np.arange(99), np.arange(1, 100)], 1)
    with pytest.raises(ArithmeticError):
        mesh.integrate(edges, np.ones(99), 100, rounds=5)
