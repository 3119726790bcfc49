"""Look-angle error and coherence of each point by a maximum-coherence trial search with one refinement step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def topofit(z: np.ndarray, baseline: np.ndarray, wraps: float) -> tuple[np.ndarray, ...]:
    """K, C, coherence, trial, residual phase of rows of complex samples z (points by images).

    baseline: one vector for all points, or a row per point. A row with a zero sample is invalid: K is NaN, coherence 0.
    Trials are walked one at a time, so memory stays at the size of z.
    """
    b = np.broadcast_to(baseline, z.shape).astype(float)
    spread = np.ptp(b, axis=1)
    size = np.abs(z)
    total = size.sum(1)
    ok = (size > 0).all(1) & (spread > 0)
    unit = np.divide(b, spread[:, None], out=np.zeros_like(b), where=spread[:, None] > 0) * (np.pi / 4)
    span = int(np.ceil(8 * wraps))
    best, trial = np.full(len(z), -1.0), np.zeros(len(z))
    step = np.exp(-1j * unit)
    turned = z * np.exp(1j * unit * span)
    for t in range(-span, span + 1):
        coh = np.abs(turned.sum(1)) / np.maximum(total, 1e-300)
        better = coh > best
        best[better], trial[better] = coh[better], t
        turned = turned * step
    k0 = np.divide(np.pi / 4 * trial, spread, out=np.zeros(len(z)), where=spread > 0)
    r = z * np.exp(-1j * k0[:, None] * b)
    offset = r.sum(1)
    angle = np.angle(r * np.conj(offset)[:, None])
    w = size**2
    with np.errstate(divide="ignore", invalid="ignore"):
        k = k0 + (w * b * angle).sum(1) / (w * b * b).sum(1)
    left = z * np.exp(-1j * np.nan_to_num(k)[:, None] * b)
    total_left = left.sum(1)
    coh = np.abs(total_left) / np.maximum(total, 1e-300)
    residual = np.angle(left * np.conj(total_left)[:, None])
    return np.where(ok, k, np.nan), np.where(ok, np.angle(total_left), np.nan), np.where(ok, coh, 0.0), trial, residual


def fit_points(points: DataFrame, id_column: str, phase: str, baseline: list[float] | str, wraps: float = 1.0) -> DataFrame:
    """(id, k, c, coh, trial, residual array) of points with an array of phases; Arrow batches, no shuffle.

    baseline: one vector for all points (images of the stack, a small constant), or the name of an array column.
    """
    schema = T.StructType(
        [points.schema[id_column], *(T.StructField(c, T.DoubleType()) for c in ("k", "c", "coh", "trial")), T.StructField("residual", T.ArrayType(T.DoubleType()))]
    )
    columns = [id_column, phase] + ([baseline] if isinstance(baseline, str) else [])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            ph = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            b = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if isinstance(baseline, str) else np.asarray(baseline, float)
            z = np.where(np.isnan(ph), 0, np.exp(1j * np.nan_to_num(ph)))
            k, c, coh, trial, residual = topofit(z, b, wraps)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, residual.size + 1, residual.shape[1], dtype=np.int32)), pa.array(residual.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (k, c, coh, trial)), lists], names=schema.names)

    return points.select(*columns).mapInArrow(run, schema)


def snr_weight(amplitude: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Signal over noise of each point: g / sigma with g = mean(A cos r), sigma^2 = (mean A^2 - g^2) / 2."""
    g = (amplitude * np.cos(residual)).mean(1)
    variance = 0.5 * ((amplitude**2).mean(1) - g**2)
    return np.divide(g, np.sqrt(np.maximum(variance, 0)), out=np.zeros_like(g), where=variance > 0)
