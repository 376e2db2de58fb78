"""Transforms that columns can't express, over stacks of planes: arrays (rows, height, width).

What they return is small (profiles, histograms, sums); statistics of it are columns again.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

EPS = 1e-12
#: The low-pass analysis filter of the fourth Daubechies wavelet.
DB4 = (
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
)
#: The three high-pass kernels whose mean response is the noise residual.
HIGH_PASS = (
    ((0, 0, 0, 0, 0), (0, -1, 2, -1, 0), (0, 2, -4, 2, 0), (0, -1, 2, -1, 0), (0, 0, 0, 0, 0)),
    ((-1, 2, -2, 2, -1), (2, -6, 8, -6, 2), (-2, 8, -12, 8, -2), (2, -6, 8, -6, 2), (-1, 2, -2, 2, -1)),
    ((0, 0, 0, 0, 0), (0, 0, -1, 0, 0), (0, -1, 4, -1, 0), (0, 0, -1, 0, 0), (0, 0, 0, 0, 0)),
)


@lru_cache(maxsize=1)
def keep_heap() -> None:
    """Lets this process reuse what its arrays leave (64 MB at most) instead of asking the system for zeroed pages again for each of them; glibc only."""
    try:
        for option, size in ((-1, 64 << 20), (-3, 32 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(option, size)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


@lru_cache(maxsize=8)
def radius(height: int, width: int) -> np.ndarray:
    y, x = np.ogrid[:height, :width]
    return np.hypot(y, x)


@lru_cache(maxsize=8)
def radial_bins(height: int, width: int, n: int) -> np.ndarray:
    """Bins of log-spaced radii from the corner (0, 0)."""
    r = radius(height, width)
    edges = np.logspace(0.0, np.log10(r.max() + 1.0), n + 1) - 1.0
    edges[0] = 0.0
    return np.clip(np.searchsorted(edges, r, side="right") - 1, 0, n - 1)


@lru_cache(maxsize=8)
def sector_bins(height: int, width: int, n: int) -> np.ndarray:
    """Bins of angles, -1 outside the ring from 10 to 90 % of the largest radius."""
    y, x = np.mgrid[:height, :width]
    at = np.floor((np.arctan2(y, x) + np.pi) / (2 * np.pi) * n).astype(np.int64) % n
    r = radius(height, width)
    return np.where((r > 0.1 * r.max()) & (r < 0.9 * r.max()), at, -1)


def binned(values: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
    """Means of each plane's values by bin, 0 for empty bins; bin -1 counts nowhere."""
    inside = bins.ravel() >= 0
    own = bins.ravel()[inside]
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=n)
    sums = np.zeros((len(values), n))
    filled = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
    sums[:, filled] = np.add.reduceat(values.reshape(len(values), -1)[:, inside][:, order], starts, axis=1)
    return sums / np.maximum(counts, 1)


def histograms(values: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Counts of each row's values in ``n`` equal bins of its own range, the last one closed; an empty range is widened by a half to both sides."""
    low, high = np.broadcast_to(low, len(values)).astype(float), np.broadcast_to(high, len(values)).astype(float)
    flat = low == high
    low, high = np.where(flat, low - 0.5, low), np.where(flat, high + 0.5, high)
    at = np.minimum(((values - low[:, None]) * (n / (high - low))[:, None]).astype(np.int64), n - 1)
    return np.bincount((at + n * np.arange(len(values))[:, None]).ravel(), minlength=n * len(values)).reshape(len(values), n)


def moments(values: np.ndarray) -> np.ndarray:
    """Mean and second to fourth central moments of each row."""
    mean = values.mean(axis=1)
    apart = values - mean[:, None]
    square = apart * apart  # powers by ``**`` cost twenty times as much
    return np.stack([mean, square.mean(axis=1), *[np.einsum("ij,ij->i", square, x) / values.shape[1] for x in (apart, square)]], axis=1)


def tiles(planes: np.ndarray, size: int, centred: bool = False) -> np.ndarray:
    """(rows, tiles, size, size) of the whole tiles of each plane."""
    n, h, w = planes.shape
    th, tw = h // size * size, w // size * size
    y, x = ((h - th) // 2, (w - tw) // 2) if centred else (0, 0)
    cut = planes[:, y : y + th, x : x + tw].reshape(n, th // size, size, tw // size, size)
    return cut.swapaxes(2, 3).reshape(n, -1, size, size)


@lru_cache(maxsize=4)
def cosines(size: int) -> np.ndarray:
    """The orthonormal cosine basis, a row for each frequency."""
    u, x = np.ogrid[:size, :size]
    basis = np.cos(np.pi * (2 * x + 1) * u / (2 * size)) * np.sqrt(2.0 / size)
    basis[0] /= np.sqrt(2.0)
    return basis


def block_cosines(blocks: np.ndarray) -> np.ndarray:
    basis = cosines(blocks.shape[-1])
    return basis @ blocks @ basis.T


#: Length up to which a wavelet step is a product with a matrix.
SHORT = 128


def step_filters() -> tuple[np.ndarray, np.ndarray]:
    low = np.array(DB4)
    return low, low[::-1] * np.where(np.arange(len(low)) % 2, 1.0, -1.0)


@lru_cache(maxsize=32)
def step_matrix(n: int) -> np.ndarray:
    """(n, both halves): one wavelet step of ``n`` values, the low half-band first, mirrored at the ends."""
    taps = len(DB4)
    at = np.pad(np.arange(n), taps - 1, mode="symmetric")
    half = (n + taps - 1) // 2
    out = np.zeros((n, 2 * half))
    for side, own in enumerate(step_filters()):
        for k in range(half):
            np.add.at(out[:, side * half + k], at[2 * k + 1 : 2 * k + 1 + taps], own[::-1])
    return out


def halved(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half-band of one wavelet step along ``axis``, mirrored at the ends; a short axis as a product with its matrix."""
    n, taps = x.shape[axis], len(DB4)
    if n <= SHORT and axis in (x.ndim - 1, x.ndim - 2):
        both = step_matrix(n)
        half, found = both.shape[1] // 2, x @ both if axis == x.ndim - 1 else both.T @ x
        return (found[..., :half], found[..., half:]) if axis == x.ndim - 1 else (found[..., :half, :], found[..., half:, :])
    low, high = step_filters()
    x = np.moveaxis(x, axis, -1)
    room = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps - 1, taps - 1)], mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(room, taps, axis=-1)[..., 1::2, :][..., : (n + taps - 1) // 2, :]
    return tuple(np.moveaxis(windows @ h[::-1], -1, axis) for h in (low, high))


def wavelet(planes: np.ndarray, levels: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The coarsest average, and (horizontal, vertical, diagonal) details from the coarsest level on."""
    details = []
    for _ in range(levels):
        rows_low, rows_high = halved(planes, 1)
        planes, vertical = halved(rows_low, 2)
        horizontal, diagonal = halved(rows_high, 2)
        details.insert(0, (horizontal, vertical, diagonal))
    return planes, details


def stencil(planes: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """Each plane under a small kernel (correlation), its border extended by ``mode``."""
    k = len(kernel) // 2
    room = np.pad(planes, [(0, 0), (k, k), (k, k)], mode=mode)
    h, w = planes.shape[1:]
    out, part = np.zeros(planes.shape, np.float64), np.empty(planes.shape, np.float64)
    for y, row in enumerate(kernel):
        for x, weight in enumerate(row):
            if weight:
                out += np.multiply(weight, room[:, y : y + h, x : x + w], out=part)
    return out


def residual(planes: np.ndarray) -> np.ndarray:
    """Mean response of the high-pass kernels: their mean is even along both axes, so rows and columns at one distance are added first."""
    kernels = [np.array(k, np.float64) for k in HIGH_PASS]
    mean = sum(k / np.abs(k).sum() for k in kernels) / len(kernels)
    h, w = planes.shape[1:]
    room = np.pad(planes, [(0, 0), (2, 2), (2, 2)], mode="symmetric")
    rows = room[:, 2 : h + 2], room[:, 1 : h + 1] + room[:, 3 : h + 3], room[:, :h] + room[:, 4:]
    middle, near, far = (sum(mean[2 - y, 2 - x] * row for y, row in enumerate(rows)) for x in range(3))
    return middle[:, :, 2 : w + 2] + (near[:, :, 1 : w + 1] + near[:, :, 3 : w + 3]) + (far[:, :, :w] + far[:, :, 4:])


def size_of(found: np.ndarray) -> np.ndarray:
    """Absolute values of complex numbers that are neither huge nor tiny."""
    return np.sqrt(found.real * found.real + found.imag * found.imag)


def slopes(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y, by Sobel's kernels."""
    room = np.pad(planes, [(0, 0), (1, 1), (1, 1)], mode="reflect")
    x, y = room[:, :, 2:] - room[:, :, :-2], room[:, 2:] - room[:, :-2]
    return x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:], y[:, :, :-2] + 2 * y[:, :, 1:-1] + y[:, :, 2:]


def median3(planes: np.ndarray) -> np.ndarray:
    """Medians of 3 x 3: columns of three are sorted once for the three places that they are in, then the middle of lows, middles and highs is taken."""
    room = np.pad(planes, [(0, 0), (1, 1), (1, 1)], mode="edge")
    h, w = planes.shape[1:]
    a, b, c = (room[:, y : y + h] for y in range(3))
    low, high = np.minimum(a, b), np.maximum(a, b)
    middle, low, high = np.maximum(low, np.minimum(high, c)), np.minimum(low, c), np.maximum(high, c)
    side = lambda v: (v[:, :, x : x + w] for x in range(3))
    (a, b, c), (d, e, f) = side(low), side(high)
    return middle_of(np.maximum(np.maximum(a, b), c), middle_of(*side(middle)), np.minimum(np.minimum(d, e), f))


def middle_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def blurred(planes: np.ndarray, sigma: float, size: int) -> np.ndarray:
    """Each plane under a Gaussian of ``size`` taps, one axis after the other, mirrored at the border."""
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    line /= line.sum()
    k, (h, w) = size // 2, planes.shape[1:]
    room = np.pad(planes, [(0, 0), (k, k), (k, k)], mode="reflect")
    room = sum(weight * room[:, y : y + h] for y, weight in enumerate(line))
    return sum(weight * room[:, :, x : x + w] for x, weight in enumerate(line))


def overlaps(old: int, new: int) -> np.ndarray:
    """Weights (new, old) by which each new cell covers the old ones: area resampling along one axis."""
    edges = np.linspace(0.0, old, new + 1)
    cells = np.arange(old)
    cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    cover = np.maximum(cover, 0.0)
    return cover / cover.sum(axis=1, keepdims=True)


def between(old: int, new: int) -> np.ndarray:
    """Weights (new, old) of linear interpolation between cell centres, level at the ends."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.minimum(np.floor(at).astype(int), max(old - 2, 0))
    out = np.zeros((new, old))
    out[np.arange(new), low] = 1 - (at - low)
    out[np.arange(new), np.minimum(low + 1, old - 1)] += at - low
    return out


def resized(planes: np.ndarray, height: int, width: int, linear: bool = False) -> np.ndarray:
    """Planes at another size: by area where it shrinks, linearly where it grows or ``linear`` says so."""
    weights = [(_kept if a * b <= 1 << 14 else _weights)(a, b, linear) for a, b in ((planes.shape[1], height), (planes.shape[2], width))]
    return weights[0] @ planes @ weights[1].T


def _weights(old: int, new: int, linear: bool) -> np.ndarray:
    return between(old, new) if linear or new > old else overlaps(old, new)


#: Weights between small sizes, which many images share.
_kept = lru_cache(maxsize=256)(_weights)
