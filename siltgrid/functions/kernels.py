"""Numerical kernels on dense grids, in NumPy: windows, low-passes, adaptive spectral filters, resampling."""

from __future__ import annotations

import numpy as np


def gauss_window(n: int, alpha: float = 2.5) -> np.ndarray:
    """Gaussian window of n points whose width is 1 / alpha of half the window."""
    k = np.arange(n) - (n - 1) / 2
    return np.exp(-0.5 * (alpha * k / ((n - 1) / 2 if n > 1 else 1)) ** 2)


def butterworth(n: int, cell: float, wavelength: float, order: int = 5) -> np.ndarray:
    """Low-pass of an n by n spectrum (zero frequency first): 1 / (1 + (f / f0)^(2 order)), separable in rows and columns."""
    f = np.fft.fftfreq(n, cell)
    h = 1 / (1 + (f * wavelength) ** (2 * order))
    return np.outer(h, h)


def smoothed(magnitude: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Spectrum magnitude (zero frequency first) smoothed by a small separable window about the middle of the spectrum, zero beyond it."""
    w, half = window / window.sum(), len(window) // 2
    m = np.fft.fftshift(magnitude, axes=(-2, -1))
    for axis in (-2, -1):
        size = m.shape[axis]
        wide = np.pad(m, [(half, half) if a == m.ndim + axis else (0, 0) for a in range(m.ndim)])
        m = sum(w[k] * np.take(wide, range(k, k + size), axis) for k in range(len(w)))
    return np.fft.ifftshift(m, axes=(-2, -1))


def adaptive_response(spectrum: np.ndarray, low: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Filter of one tile: beta * (smoothed magnitude over its median)^alpha - 1, floored at 0, plus the low-pass."""
    h = smoothed(np.abs(spectrum), gauss_window(7))
    middle = np.median(h, axis=(-2, -1), keepdims=True)
    h = np.divide(h, middle, out=np.ones_like(h), where=middle > 0) ** alpha - 1
    return beta * np.maximum(h, 0) + low


def tiles(size: int, window: int, hop: int) -> list[int]:
    """Starts of overlapping tiles that cover an axis; the last is moved back to end with it."""
    if size <= window:
        return [0]
    starts = list(range(0, size - window + 1, hop))
    return starts if starts[-1] + window >= size else [*starts, size - window]


def pyramid(window: int, least: int = 0) -> np.ndarray:
    """Weight of a tile: what it is from the nearest edge along either axis, summed."""
    up = np.arange(window // 2) + least
    ramp = np.r_[up, up[::-1]] if window % 2 == 0 else np.r_[up, window // 2 + least, up[::-1]]
    return np.add.outer(ramp, ramp).astype(float)


def overlap_add(grid: np.ndarray, window: int, hop: int, filtered, weight: np.ndarray) -> np.ndarray:
    """A grid filtered tile by tile and summed by weight; `filtered` maps a tile to its filtered values.

    The weight of a tile that was moved back to end with the grid moves with the rest of its axis: it starts at 0 for what was skipped.
    """
    out = np.zeros(grid.shape, complex)
    total = np.zeros(grid.shape)
    moved = lambda k, i: k * hop - i if k * hop > i else 0
    for m, i in enumerate(tiles(grid.shape[0], window, hop)):
        for n, j in enumerate(tiles(grid.shape[1], window, hop)):
            tile = grid[i : i + window, j : j + window]
            a, b = moved(m, i), moved(n, j)
            w = np.zeros((window, window))
            w[a:, b:] = weight[: window - a, : window - b]
            w = w[: tile.shape[0], : tile.shape[1]]
            out[i : i + window, j : j + window] += w * filtered(tile)
            total[i : i + window, j : j + window] += w
    return np.divide(out, total, out=out, where=total > 0)


def clap(grid: np.ndarray, cell: float = 50.0, window: int = 24, pad: int = 8, wavelength: float = 800.0, alpha: float = 1.0, beta: float = 0.3) -> np.ndarray:
    """Combined low-pass and adaptive phase filter of a complex grid by overlapping tiles."""
    n = window + pad
    low = butterworth(n, cell, wavelength)

    def one(tile):
        padded = np.zeros((n, n), complex)
        padded[: tile.shape[0], : tile.shape[1]] = tile
        spectrum = np.fft.fft2(padded)
        return np.fft.ifft2(spectrum * adaptive_response(spectrum, low, alpha, beta))[: tile.shape[0], : tile.shape[1]]

    return overlap_add(np.nan_to_num(grid), window, max(1, window // 4), one, pyramid(window) + 1e-6)


def clap_windows(windows: np.ndarray, cell: float = 50.0, wavelength: float = 800.0, alpha: float = 1.0, beta: float = 0.3) -> np.ndarray:
    """The same filter on a stack of whole windows (k, n, n), all transforms at once."""
    spectrum = np.fft.fft2(windows)
    return np.fft.ifft2(spectrum * adaptive_response(spectrum, butterworth(windows.shape[-1], cell, wavelength), alpha, beta))


def goldstein(grid: np.ndarray, window: int = 32, alpha: float = 0.8, low: bool = False) -> np.ndarray:
    """Power-spectrum filter |F|^alpha by overlapping tiles padded by a quarter; the size of each value stays as it was.

    low: a Gaussian low-pass of the spectrum in its place, an eighth of its width wide.
    """
    n = window + max(1, round(window / 4))
    wide = np.fft.ifftshift(gauss_window(n, 16.0))

    def one(tile):
        padded = np.zeros((n, n), complex)
        padded[: tile.shape[0], : tile.shape[1]] = tile
        spectrum = np.fft.fft2(padded)
        if low:
            h = np.outer(wide, wide)
        else:
            h = smoothed(np.abs(spectrum), gauss_window(7))
            middle = np.median(h)
            h = (h / middle if middle > 0 else np.ones_like(h)) ** alpha
        return np.fft.ifft2(spectrum * h)[: tile.shape[0], : tile.shape[1]]

    found = overlap_add(np.nan_to_num(grid), window, max(1, window // 2), one, pyramid(window, 1))
    return np.abs(grid) * np.exp(1j * np.angle(found))


def upsampled(values: np.ndarray, factor: int = 10) -> np.ndarray:
    """Values interpolated to `factor` times as many by a Kaiser-windowed sinc (half-length ten samples)."""
    half = 10 * factor
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / factor) * np.kaiser(2 * half + 1, 5.0)
    taps *= factor / taps.sum()
    spread = np.zeros(len(values) * factor)
    spread[::factor] = values
    return np.convolve(spread, taps, "full")[half : half + len(spread)]


def random_coherence(baseline: np.ndarray, wraps: float, n: int = 300_000, seed: int = 2005, chunk: int = 30_000, pairs: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Histogram in 100 bins of the coherence that random phases reach: the null model of the trial search.

    pairs: of a pair network, whose phases are differences of random images; baseline is then that of the pairs.
    One stream of random numbers in one task, so thresholds are the same wherever it runs.
    """
    from siltgrid.operators.topofit import topofit

    rng = np.random.RandomState(seed)
    counts = np.zeros(100, np.int64)
    for start in range(0, n, chunk):
        phase = 2 * np.pi * rng.rand(min(chunk, n - start), 1 + max(map(max, pairs)) if pairs else len(baseline))
        if pairs:
            first, second = np.array(pairs).T
            phase = phase[:, second] - phase[:, first]
        coh = topofit(np.exp(1j * phase), baseline, wraps)[2]
        counts += np.bincount(np.minimum((coh * 100).astype(int), 99), minlength=100)
    return counts


def weights_from_null(observed: np.ndarray, null: np.ndarray, low: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """(weight at each thousandth of coherence, 0 to 1; scaled null): (1 - chance of being random)^2.

    The null is scaled to the observed counts of the `low` lowest bins, where everything is random; above its last filled bin nothing is. Its
    share is smoothed by a causal seven-point Gaussian that starts from 1, and upsampled tenfold.
    """
    scaled = null * (observed[:low].sum() / max(1, null[:low].sum()))
    chance = scaled / np.where(observed > 0, observed, 1)
    chance[:low] = 1
    chance[np.max(np.flatnonzero(null), initial=-1) + 1 :] = 0
    w = gauss_window(7)
    chance = np.convolve(np.r_[np.ones(7), np.minimum(chance, 1)], w / w.sum())[7:107]
    return (1 - upsampled(np.r_[1, chance])[:1001]) ** 2, scaled


def coherence_threshold(observed: np.ndarray, null: np.ndarray, most: float, by_share: bool) -> float | None:
    """Lowest coherence at which what random points contribute stays under `most` (a share in percent, or a count).

    A cubic through six bins around the first good one refines it; None where no bin is good.
    """
    above_null, above = np.cumsum(null[::-1])[::-1], np.cumsum(observed[::-1])[::-1]
    level = 100 * np.divide(above_null, above, out=np.full(100, np.nan), where=above > 0) if by_share else above_null.astype(float)
    good = np.flatnonzero(level < most)
    if not len(good):
        return None
    k = int(good[0])
    if k < 3 or k + 2 >= 100:
        return (k + 1) / 100
    at = np.arange(k - 3, k + 3)
    x, y = level[at], (at + 1) / 100.0
    if not np.isfinite(x).all() or np.std(x) == 0:
        return (k + 1) / 100
    z = (x - x.mean()) / x.std()
    fit = np.polyval(np.polyfit(z, y, 3), (most - x.mean()) / x.std())
    return float(fit) if np.isfinite(fit) and 0 <= fit <= 1 else (k + 1) / 100
