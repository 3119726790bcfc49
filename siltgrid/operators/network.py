"""Inversion of a pair network, and small least-squares problems that are the same for every point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltgrid.functions.cplx import dot


def design(pairs: list[tuple[int, int]], n_images: int) -> np.ndarray:
    """Rows of -1 at the first and +1 at the second image of each pair."""
    g = np.zeros((len(pairs), n_images))
    for k, (i, j) in enumerate(pairs):
        g[k, i], g[k, j] = -1, 1
    return g


def inverse(pairs: list[tuple[int, int]], n_images: int, reference: int = 0, covariance: np.ndarray | None = None) -> np.ndarray:
    """Images by pairs: least-squares phases of the images with the reference at 0; whitened where a covariance is given."""
    keep = [k for k in range(n_images) if k != reference]
    g = design(pairs, n_images)[:, keep]
    if covariance is not None and not np.allclose(covariance, np.eye(len(pairs))):
        try:
            white = np.linalg.inv(np.linalg.cholesky(covariance))
            x = np.linalg.pinv(white @ g) @ white
        except np.linalg.LinAlgError:
            x = np.linalg.pinv(g)
    else:
        x = np.linalg.pinv(g)
    out = np.zeros((n_images, len(pairs)))
    out[keep] = x
    return out


def invert(phase: str, matrix: np.ndarray) -> Column:
    """Array column of image phases: one dot product per image, row by row in the JVM."""
    return F.array(*(dot(F.col(phase), row.tolist()) for row in matrix))


def covariance_of_images(matrix: np.ndarray, variances: list[float]) -> np.ndarray:
    v = np.maximum(np.nan_to_num(np.asarray(variances, float), nan=1e-6), 1e-6)
    return matrix @ np.diag(v) @ matrix.T


def lscov(design: np.ndarray, covariance: np.ndarray | None = None) -> np.ndarray:
    """Solver matrix of a generalised least-squares problem: parameters by observations."""
    if covariance is None or np.allclose(covariance, np.eye(len(design))):
        return np.linalg.pinv(design)
    try:
        white = np.linalg.inv(np.linalg.cholesky(covariance))
        return np.linalg.pinv(white @ design) @ white
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(covariance)
        return np.linalg.pinv(design.T @ inv @ design) @ design.T @ inv
