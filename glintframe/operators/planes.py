"""Image planes and the 120 numbers of their feature vector.

Each family of features has one small function that transforms stacks of planes (spectra, sub-bands, residuals) and
returns sums, profiles and histograms, and one that makes slopes, ratios, entropies and moments of these, for a stack at a time.
``measured`` runs all families in one pass over the images, whose planes never leave it; features alone do.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from glintframe.functions import codecs
from glintframe.functions import signal as S
from glintframe.functions.numeric import clip

RADIAL, SECTORS, BLOCK, LEVELS, SIDE = 24, 18, 8, 3, 256
TILES = 4
GLCM_LEVELS, PAIRS, BOX_SCALES = 64, 600, (2, 4, 8, 16, 32, 64)


def _kind(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(_kind(name[6:-1]))
    return {"double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}[name]


class Family(NamedTuple):
    """Numbers of stacked planes of one size: what computes them, their type as a struct, the planes it takes."""

    work: Callable[..., dict[str, Any]]
    kind: T.StructType
    planes: tuple[str, ...]


#: Families by name, as ``measured`` finds them.
FAMILIES: dict[str, Family] = {}


def family(name: str, kind: str, *planes: str) -> Callable:
    """Registers a family; what it returns is small: sums, profiles and histograms of each plane."""

    def add(work: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
        fields = [part.split(" ") for part in kind.split(", ")]
        FAMILIES[name] = Family(work, T.StructType([T.StructField(n, _kind(of)) for n, of in fields]), planes or ("y",))
        return work

    return add


def _spectra(planes: np.ndarray) -> dict[str, np.ndarray]:
    found = np.fft.rfft2(planes - planes.mean(axis=(1, 2), keepdims=True))
    size = S.size_of(found)
    n, h, w = size.shape
    r, bins = S.radius(h, w), S.radial_bins(h, w, RADIAL)
    beyond = r > 2.0
    power = size[:, beyond] ** 2
    phases = np.angle(found[:, beyond])
    inner, half = size[:, 1:, 1:], min(h, w) // 2
    above = np.logical_and.reduce([inner > np.roll(inner, step, axis) for axis in (1, 2) for step in (1, -1)])
    top = np.where(above, inner, -1.0).reshape(n, -1).max(axis=1)
    place = inner.reshape(n, -1).argmax(axis=1)
    return {
        "radial": S.binned(size, bins, RADIAL), "centres": S.binned(r[None], bins, RADIAL)[0], "sectors": S.binned(size, S.sector_bins(h, w, SECTORS), SECTORS),
        "phases": S.histograms(phases, 32, -np.pi, np.pi), "mean_log": np.log(power + S.EPS).mean(axis=1), "mean_power": power.mean(axis=1),
        "high": (size[:, -half:, -half:] ** 2).sum(axis=(1, 2)) if half > 2 else np.zeros(n), "dc": size[:, 0, 0] ** 2, "energy": (size**2).sum(axis=(1, 2)),
        "peak": np.maximum(top, 0.0), "median": np.median(inner.reshape(n, -1), axis=1), "peak_bin": bins[1:, 1:].ravel()[place],
    }


def _cosines(planes: np.ndarray) -> dict[str, np.ndarray]:
    found = S.block_cosines(S.tiles(planes, BLOCK, centred=True))
    n = len(found)
    corner = S.block_cosines(S.tiles(planes, BLOCK)) if planes.shape[1] % BLOCK or planes.shape[2] % BLOCK else found
    rest = corner[:, :, 1:, 1:].reshape(n, -1)
    low, high = rest.min(axis=1), rest.max(axis=1)
    return {
        "energy": (found**2).mean(axis=1).reshape(n, -1), "moments": S.moments(np.abs(found[:, :, 1:, 1:]).reshape(n, -1)), "history": S.histograms(rest, 64, low, high),
        "low": low, "high": high, "near_zero": (np.abs(rest) < 0.5).mean(axis=1), "ac": (rest**2).sum(axis=1), "all": (corner**2).sum(axis=(1, 2, 3)),
    }


def _subbands(planes: np.ndarray) -> dict[str, np.ndarray]:
    average, details = S.wavelet(planes, LEVELS)
    n = len(planes)
    bands = [b.reshape(n, -1) for level in details for b in level]
    finest = (np.clip(details[-1][0], 0.0, 1.0) * 255).astype(np.uint8)
    centre, (h, w) = finest[:, 1:-1, 1:-1], finest.shape[1:]
    around = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))  # fixed order of the code's bits
    codes = sum(((finest[:, 1 + y : h - 1 + y, 1 + x : w - 1 + x] >= centre).astype(np.int64) << bit for bit, (y, x) in enumerate(around)))
    gx, gy = S.slopes(details[-1][2])
    steep = np.sqrt(gx * gx + gy * gy)
    level = steep.mean(axis=(1, 2)), steep.std(axis=(1, 2))
    strong = (steep > (level[0] + level[1])[:, None, None]) & (level[0] >= S.EPS)[:, None, None]
    twice, many = 2 * np.arctan2(gy, gx), strong.sum(axis=(1, 2))
    blocks = np.abs(S.tiles(planes, BLOCK))
    half = BLOCK // 2
    pair = []
    for part in (blocks[:, :, :half, :half], blocks[:, :, half:, half:]):
        m = np.log1p(part.mean(axis=(2, 3)))
        low, span = m.min(axis=1, keepdims=True), m.max(axis=1, keepdims=True) + S.EPS - m.min(axis=1, keepdims=True)
        pair.append(np.where(span < S.EPS, 0, np.clip((m - low) / np.maximum(span, S.EPS) * 15, 0, 15)).astype(np.int64))
    joint = np.bincount((pair[0] * 16 + pair[1] + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 16, 16)
    return {
        "energies": np.stack([(b**2).sum(axis=1) for b in bands], axis=1), "histograms": np.stack([S.histograms(b, 32, b.min(axis=1), b.max(axis=1)) for b in bands], axis=1),
        "average": (average**2).sum(axis=(1, 2)), "plane": (planes**2).sum(axis=(1, 2)), "lbp": S.histograms(codes.reshape(n, -1), 256, 0, 256),
        "cos2": np.where(strong, np.cos(twice), 0).sum(axis=(1, 2)) / np.maximum(many, 1), "sin2": np.where(strong, np.sin(twice), 0).sum(axis=(1, 2)) / np.maximum(many, 1),
        "strong": many, "cells": joint,
    }


def _noise(planes: np.ndarray) -> dict[str, np.ndarray]:
    rest = S.residual(planes)
    flat = rest.reshape(len(rest), -1)
    power = S.size_of(np.fft.rfft(flat - flat.mean(axis=1, keepdims=True))) ** 2
    there = power > S.EPS
    many = there.sum(axis=1)
    return {
        "moments": S.moments(flat), "mean_abs": np.abs(flat).mean(axis=1), "tiles": (S.tiles(rest, 32) ** 2).sum(axis=(2, 3)), "bins": many,
        "mean_log": np.where(there, np.log(np.where(there, power, 1.0)), 0).sum(axis=1) / np.maximum(many, 1), "mean_power": np.where(there, power, 0).sum(axis=1) / np.maximum(many, 1),
    }


def _texture(planes: np.ndarray) -> dict[str, np.ndarray]:
    n, h, w = planes.shape
    grey = np.clip(planes * GLCM_LEVELS, 0, GLCM_LEVELS - 1).astype(np.int16)
    low, high = np.divmod(np.arange(GLCM_LEVELS**2), GLCM_LEVELS)
    apart = high - low
    # A pair counts both ways: sums over the matrix are sums over unordered pairs, of whole numbers up to the division.
    weights = np.stack([low + high, low**2 + high**2, apart**2, apart, 1 / (1.0 + apart**2)], axis=1).astype(np.float64)
    base, found = GLCM_LEVELS**2 * np.arange(n)[:, None, None], []
    for d in (1, 2):
        for dy, dx in ((0, d), (d, d), (d, 0), (d, -d)):
            a, b = grey[:, : h - dy, max(0, -dx) : w - max(0, dx)], grey[:, dy:, max(0, dx) : w - max(0, -dx)]
            cells = np.minimum(a, b) * np.int16(GLCM_LEVELS) + np.maximum(a, b)
            count = np.bincount((base + cells).ravel(), minlength=n * GLCM_LEVELS**2).reshape(n, -1).astype(np.float64)
            both, same = 2 * a[0].size, count[:, :: GLCM_LEVELS + 1]
            level, squares, contrast, gaps, near = (count @ weights).T
            spread, joint = both * squares - level**2, both * (squares - contrast) - level**2
            alike = np.where(spread == 0, 1.0, joint / np.maximum(spread, 1))
            energy = 2 * (np.einsum("ij,ij->i", count, count) + np.einsum("ij,ij->i", same, same))
            found.append([2 * contrast / both, alike, np.sqrt(energy) / both, 2 * near / both, 2 * gaps / both])
    gx, gy = S.slopes(planes)
    steep = np.sqrt(gx * gx + gy * gy)
    edge = steep > (steep.mean(axis=(1, 2)) + 0.5 * steep.std(axis=(1, 2)))[:, None, None]
    scales = [s for s in BOX_SCALES if s <= min(h, w) // 2]
    most = max(scales, default=1)
    whole = edge[:, : h // most * most, : w // most * most]
    boxes = [S.tiles(whole, s).any(axis=(2, 3)).sum(axis=1) for s in scales]
    return {
        "properties": np.array(found).transpose(2, 1, 0), "boxes": np.maximum(np.stack(boxes, axis=1), 1) if boxes else np.zeros((n, 0), np.int64), "scales": np.array(scales, float),
    }


def _colour_plane(plane: np.ndarray) -> dict[str, np.ndarray]:
    found = np.fft.rfft2(plane - plane.mean(axis=(1, 2), keepdims=True))
    size = S.size_of(found)
    n, h, w = size.shape
    power, r, half = size**2, S.radius(h, w), min(h, w) // 2
    flat = power.reshape(n, -1)
    there = flat > S.EPS
    many = there.sum(axis=1)
    flatness = np.exp(np.where(there, np.log(np.where(there, flat, 1.0)), 0).sum(axis=1) / np.maximum(many, 1)) / (np.where(there, flat, 0).sum(axis=1) / np.maximum(many, 1) + S.EPS)
    ring = (r > 2.0) & (r < 0.8 * r.max())
    x, y = np.log(r[ring]), np.log(size[:, ring] + S.EPS)
    slope = ((x - x.mean()) * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / max(((x - x.mean()) ** 2).sum(), S.EPS) if ring.sum() >= 5 else np.zeros(n)
    edges = np.linspace(0.0, r.max(), 24)
    profile = S.moments(S.binned(size, np.clip(np.searchsorted(edges, r, side="right") - 1, 0, 22), 23))
    high = power[:, -half:, -half:].sum(axis=(1, 2)) if half > 2 else np.zeros(n)
    return {
        "flatness": np.where(many < 4, 0.0, flatness), "high": high / (flat.sum(axis=1) + S.EPS), "slope": slope, "dc": power[:, 0, 0] / (flat.sum(axis=1) + S.EPS),
        "phases": S.histograms(np.angle(found).reshape(n, -1), 16, -np.pi, np.pi), "profile": profile,
    }


def _colour(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> dict[str, np.ndarray]:
    r, g, b = (np.floor(np.clip(c, 0, 1) * 255) for c in (red, green, blue))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    chroma = [np.clip(np.round((c - y) * k + 128), 0, 255) / 255.0 for c, k in ((r, 0.713), (b, 0.564))]
    found = [_colour_plane(c) for c in chroma]
    n = len(red)

    def alike(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        a, c = (v.reshape(n, -1) - v.reshape(n, -1).mean(axis=1, keepdims=True) for v in (a, c))
        size = np.sqrt((a * a).mean(axis=1)), np.sqrt((c * c).mean(axis=1))
        return np.where((size[0] < S.EPS) | (size[1] < S.EPS), 0.0, (a * c).mean(axis=1) / np.maximum(size[0] * size[1], S.EPS))

    return {k: np.stack([f[k] for f in found], axis=1) for k in found[0]} | {"correlations": np.stack([alike(*chroma), alike(red, green), alike(green, blue)], axis=1)}


def _coupling(planes: np.ndarray) -> dict[str, np.ndarray]:
    n, h, w = planes.shape
    even = planes[:, : h - h % 2, : w - w % 2]
    half = np.fft.fft2(even - even.mean(axis=(1, 2), keepdims=True))[:, : even.shape[1] // 2, : even.shape[2] // 2]
    hh, ww = half.shape[1:]
    none = dict.fromkeys(("coherence", "whole", "weighed", "there", "drawn", "first", "second"), np.zeros(n)) | {"real": np.zeros((n, 4)), "sizes": np.zeros((n, 4))}
    r = S.radius(hh, ww)
    middle = np.flatnonzero((r > 4.0) & (r < 0.6 * r.max()))
    if min(hh, ww) < 12 or len(middle) < 4:
        return none
    drawn = np.random.default_rng(42).choice(middle, size=(min(PAIRS, len(middle)), 2), replace=True)  # fixed seed of the sample
    (y1, x1), (y2, x2) = (np.unravel_index(drawn[:, k], (hh, ww)) for k in (0, 1))
    a, b, c = half[:, y1, x1], half[:, y2, x2], half[:, (y1 + y2) % hh, (x1 + x2) % ww]
    triple, sizes = c * a.conj() * b.conj(), np.abs(half)
    strength = np.abs(triple)
    weight = (np.abs(a) * np.abs(b) * np.abs(c)).mean(axis=1) + S.EPS
    return {
        "coherence": np.abs(triple.mean(axis=1)) / weight, "real": S.moments(triple.real), "sizes": S.moments(strength), "whole": strength.sum(axis=1), "there": (strength > 0).sum(axis=1),
        "weighed": (strength * np.log2(np.where(strength > 0, strength, 1.0))).sum(axis=1), "drawn": np.full(n, len(drawn)),
        "first": sizes[:, : hh // 2, : ww // 2].sum(axis=(1, 2)), "second": sizes[:, hh // 2 :, ww // 2 :].sum(axis=(1, 2)),
    }


def _sensor(planes: np.ndarray) -> np.ndarray:
    smooth = 0.5 * S.blurred(planes, 1.0, 5) + 0.5 * S.median3(planes)
    return (planes - smooth) / (planes + S.EPS)


def _print(planes: np.ndarray) -> dict[str, np.ndarray]:
    n, h, w = planes.shape
    rest = _sensor(planes)
    y, x = h // 2, w // 2
    parts = [rest[:, a : a + y, b : b + x].reshape(n, -1) for a in (0, y) for b in (0, x)]
    parts = np.stack([p[:, np.linspace(0, p.shape[1] - 1, 1024).astype(int)] for p in parts], axis=1)
    parts = parts - parts.mean(axis=2, keepdims=True)
    size = np.sqrt((parts**2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        alike = (parts @ parts.swapaxes(1, 2)) / (size[:, :, None] * size[:, None, :])
    small = S.resized(_sensor(S.resized(planes, h // 2, w // 2)), h, w, linear=True)
    a, b = (v.reshape(n, -1) - v.reshape(n, -1).mean(axis=1, keepdims=True) for v in (rest, small))
    sizes = np.sqrt((a**2).mean(axis=1)), np.sqrt((b**2).mean(axis=1))
    scaled = np.where((sizes[0] < S.EPS) | (sizes[1] < S.EPS), 0.0, (a * b).mean(axis=1) / np.maximum(sizes[0] * sizes[1], S.EPS))
    flat = rest.reshape(n, -1)
    strength = np.abs(flat).mean(axis=1)
    return {
        "quadrants": alike[:, *np.triu_indices(4, k=1)], "mean_abs": strength, "moments": S.moments(flat), "scales": scaled, "spread": flat.std(axis=1) / (strength + S.EPS),
    }


@family("hash", "bits array<int>", "gray")
def _perceptual(planes: np.ndarray) -> dict[str, np.ndarray]:
    small = np.round(S.resized(np.round(planes * 255), 32, 32))
    basis = S.cosines(32)
    low = (basis @ small @ basis.T)[:, :8, :8].reshape(len(planes), -1)
    return {"bits": (low > np.median(low, axis=1, keepdims=True)).astype(np.int32)}


@family("means", "y double, gray double, red double, green double, blue double", "y", "gray", "red", "green", "blue")
def _means(*planes: np.ndarray) -> dict[str, np.ndarray]:
    return {name: plane.mean(axis=(1, 2)) for name, plane in zip(PLANES, planes)}


TILE_BINS = 12


@family("tiles", "slope array<double>, flatness array<double>")
def _tile_spectra(planes: np.ndarray) -> dict[str, np.ndarray]:
    """Of the tiles of each plane slope and flatness of the spectrum; 2 and 0 where a tile has too few radial bins for a fit."""
    n, h, w = planes.shape
    side = max(2, min(TILES, min(h, w) // 16))
    th, tw = h // side, w // side
    cut = planes[:, : th * side, : tw * side].reshape(n, side, th, side, tw).swapaxes(2, 3).reshape(-1, th, tw)
    size = np.abs(np.fft.rfft2(cut - cut.mean(axis=(1, 2), keepdims=True)))
    r, bins = S.radius(*size.shape[1:]), S.radial_bins(*size.shape[1:], TILE_BINS)
    power, centres = size[:, r > 2.0] ** 2, S.binned(r[None], bins, TILE_BINS)[0]
    reach = centres > 2.0
    if reach.sum() < 4:
        return {"slope": np.full((n, side * side), 2.0), "flatness": np.zeros((n, side * side))}
    slope = inclines(np.log(centres[reach]), np.log(S.binned(size, bins, TILE_BINS)[:, reach] + S.EPS))[0]
    flatness = np.exp(np.log(power + S.EPS).mean(axis=1)) / (power.mean(axis=1) + S.EPS)
    return {"slope": slope.reshape(n, -1), "flatness": flatness.reshape(n, -1)}


def disorder(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row's counts, 1 for equal ones."""
    share = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    return -(share * np.log2(np.where(counts > 0, share, 1.0))).sum(axis=-1) / np.log2(counts.shape[-1])


def inclines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of least squares through (x, each row of y); level where all of x is one."""
    away = x - x.mean()
    size = (away * away).sum()
    slope = ((y - y.mean(axis=1, keepdims=True)) @ away) / size if size else np.zeros(len(y))
    return slope, y.mean(axis=1) - slope * x.mean()


def tail(m: np.ndarray) -> np.ndarray:
    return np.where(m[:, 1] > S.EPS * S.EPS, m[:, 3] / (m[:, 1] * m[:, 1] + S.EPS) - 3.0, 0.0)


def kurtosis(m: np.ndarray) -> np.ndarray:
    return np.where(np.sqrt(m[..., 1]) > S.EPS, m[..., 3] / (m[..., 1] * m[..., 1] + S.EPS), 0.0)


def spectral_features(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    shares = s["radial"] / (s["radial"].sum(axis=1, keepdims=True) + S.EPS)
    centres, none = s["centres"], np.zeros(len(shares))
    reach = (centres > 2.0) & (centres < centres.max() * 0.85)
    slope, intercept = inclines(np.log(centres[reach]), np.log(s["radial"][:, reach] + S.EPS)) if reach.sum() >= 5 else (none, none)
    energy = s["energy"] + S.EPS
    return {f"fft_radial_{i}": shares[:, i] for i in range(RADIAL)} | {f"fft_azimuthal_{i}": s["sectors"][:, i] for i in range(SECTORS)} | {
        "fft_slope": slope, "fft_intercept": intercept, "fft_flatness": np.exp(s["mean_log"]) / (s["mean_power"] + S.EPS) if (centres > 2.0).sum() > 10 else none,
        "fft_phase_entropy": disorder(s["phases"]), "fft_high_freq_ratio": s["high"] / energy, "fft_dc_ratio": s["dc"] / energy,
        "fft_peak_prominence": s["peak"] / (s["median"] + S.EPS), "fft_peak_radius_bin": s["peak_bin"],
    }


def cosine_features(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    e = c["energy"]
    u, v = np.divmod(np.arange(BLOCK * BLOCK), BLOCK)
    far = u * u + v * v
    rims = ((u % (BLOCK - 1) == 0) | (v % (BLOCK - 1) == 0)) & (far > 0)
    low, mid, high, rim = (e[:, cells].sum(axis=1) for cells in ((far > 0) & (far <= (BLOCK / 4) ** 2), (far > (BLOCK / 4) ** 2) & (far <= (BLOCK / 2) ** 2), far > (BLOCK / 2) ** 2, rims))
    ac = low + mid + high + S.EPS
    return {
        "dct_kurtosis": tail(c["moments"]), "dct_high_freq_ratio": high / ac, "dct_mid_band_ratio": mid / ac, "dct_boundary_energy": rim / (e.sum(axis=1) + S.EPS),
        "dct_std": np.sqrt(c["moments"][:, 1]), "dct_avg_dc": e[:, 0], "dct_low_high_ratio": (low + S.EPS) / (high + S.EPS),
    }


def history_features(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Traces of earlier compression in the histogram of block coefficients."""
    bars = c["history"]
    n, many = bars.sum(axis=1, keepdims=True), bars.shape[1]
    p, at = bars / n, c["low"][:, None] + (np.arange(many) + 0.5) * ((c["high"] - c["low"]) / many)[:, None]
    apart = (at - (p * at).sum(axis=1, keepdims=True)) ** 2
    second, fourth = (p * apart).sum(axis=1), (p * apart * apart).sum(axis=1)
    level = bars - n / many
    lagged = lambda lag: (level[:, : many - lag] * level[:, lag:]).sum(axis=1)
    zero = lagged(0) + S.EPS
    mode, place = bars.argmax(axis=1)[:, None], np.arange(many)
    mass = (bars * ((place >= mode - 3) & (place <= mode + 3))).sum(axis=1) / n[:, 0]
    return {
        "jpeg_quant_estimate": np.clip(40.0 + (c["ac"] / (c["all"] + S.EPS) - 0.1) * 120.0, 0.0, 100.0), "jpeg_hist_kurtosis": np.where(second > S.EPS, fourth / (second * second + S.EPS), 0.0),
        "jpeg_hist_periodicity": np.max([lagged(lag) / zero for lag in range(2, 12)], axis=0), "jpeg_zero_ratio": c["near_zero"], "jpeg_mode_spread": mass,
    }


def subband_features(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    e = w["energies"]
    levels = e.reshape(len(e), LEVELS, 3).sum(axis=2)
    shares, entropies, whole = e / np.repeat(np.where(levels < 1e-12, 1.0, levels), 3, axis=1), disorder(w["histograms"]), w["plane"] + S.EPS
    return {f"wavelet_energy_{i}": shares[:, i] for i in range(3 * LEVELS)} | {f"wavelet_entropy_{i}": entropies[:, i] for i in range(3 * LEVELS)} | {
        "wavelet_detail_ratio": levels.sum(axis=1) / whole, "wavelet_cross_scale_ratio": (levels[:, 0] + S.EPS) / (levels[:, -1] + S.EPS), "wavelet_ll_ratio": w["average"] / whole,
    }


#: Codes with two changes at most between digits as they are written: without leading zeros.
STEADY = np.array([f"{c:b}".count("01") + f"{c:b}".count("10") <= 2 for c in range(256)])


def second_order_features(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    share = w["lbp"] / (w["lbp"].sum(axis=1, keepdims=True) + S.EPS)
    code = np.arange(256.0)
    away = (code - (share @ code)[:, None]) ** 2
    cells = w["cells"].reshape(len(share), -1)
    blocks = cells.sum(axis=1) + S.EPS
    apart = np.abs(np.subtract.outer(np.arange(16), np.arange(16))).ravel()
    return {
        "freqtex_lbp_uniformity": share[:, STEADY].sum(axis=1), "freqtex_lbp_entropy": disorder(w["lbp"]), "freqtex_lbp_contrast": (share * away).sum(axis=1),
        "freqtex_dct_cooc_homogeneity": cells @ (1 / (apart + 1.0)) / blocks, "freqtex_dct_cooc_contrast": cells @ apart**2 / blocks,
        "freqtex_grad_consistency": np.where(w["strong"] < 10, 0.0, np.minimum(1.0, np.hypot(w["cos2"], w["sin2"]))),
    }


def noise_features(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    m, own = r["moments"], r["tiles"]
    even = np.clip(1.0 - own.std(axis=1) / (own.mean(axis=1) + S.EPS), 0.0, 1.0) if own.shape[1] else np.zeros(len(own))
    return {
        "noise_kurtosis": tail(m), "noise_std": np.sqrt(m[:, 1]), "noise_mean_abs": r["mean_abs"], "noise_block_consistency": even,
        "noise_flatness": np.where(r["bins"] < 4, 0.0, np.exp(r["mean_log"]) / (r["mean_power"] + S.EPS)),
    }


def texture_features(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = ("contrast", "correlation", "energy", "homogeneity", "dissimilarity")
    boxes = inclines(-np.log(t["scales"]), np.log(t["boxes"]))[0] if len(t["scales"]) else np.zeros(len(t["boxes"]))
    return {f"texture_{name}": t["properties"][:, k].sum(axis=1) / 8 for k, name in enumerate(names)} | {"texture_fractal_dim": boxes}


def colour_features(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    mean = lambda v: (v[:, 0] + v[:, 1]) / 2
    return {
        "chroma_flatness": mean(c["flatness"]), "chroma_high_freq_ratio": mean(c["high"]), "chroma_slope": mean(c["slope"]), "chroma_cb_dc_ratio": c["dc"][:, 0], "chroma_cr_dc_ratio": c["dc"][:, 1],
        "chroma_cb_cr_corr": c["correlations"][:, 0], "chroma_rg_corr": c["correlations"][:, 1], "chroma_gb_corr": c["correlations"][:, 2], "chroma_entropy": mean(disorder(c["phases"])),
        "chroma_radial_kurtosis": mean(kurtosis(c["profile"])),
    }


def coupling_features(b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    some, whole, there = b["drawn"] > 0, b["whole"], b["there"]
    spread, room = np.sqrt(b["sizes"][:, 1]), np.where(b["whole"] > S.EPS, b["whole"], 1.0)
    return {
        "hos_bicoherence": b["coherence"], "hos_bispectrum_kurtosis": np.where(some, kurtosis(b["real"]), 0.0),
        "hos_phase_coupling_entropy": np.where(some & (whole > S.EPS) & (there > 1), (np.log2(room) - b["weighed"] / room) / np.log2(np.maximum(there, 2)), 0.0),
        "hos_bicoherence_skew": np.where(some & (spread > S.EPS), b["sizes"][:, 2] / (spread + S.EPS) ** 3, 0.0),
        "hos_spectral_asymmetry": (b["first"] - b["second"]) / (b["first"] + b["second"] + S.EPS),
    }


def print_features(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        "prnu_residual_corr": np.fmin(np.maximum(p["quadrants"].sum(axis=1) / 6, -1.0), 1.0), "prnu_residual_energy": p["mean_abs"], "prnu_residual_kurtosis": kurtosis(p["moments"]),
        "prnu_scale_invariance": np.clip(p["scales"], -1.0, 1.0), "prnu_fingerprint_strength": p["spread"],
    }


PLANES = ("y", "gray", "red", "green", "blue")
#: The family of all features.
VECTOR = ("vector",)
#: Features in their contractual order, and the decimals that they are rounded to, if any.
FEATURES: dict[str, int | None] = {
    **dict.fromkeys([f"fft_radial_{i}" for i in range(RADIAL)] + [f"fft_azimuthal_{i}" for i in range(SECTORS)]),
    **dict.fromkeys([f"fft_{name}" for name in ("slope", "intercept", "flatness", "phase_entropy", "high_freq_ratio", "dc_ratio", "peak_prominence", "peak_radius_bin")]),
    **dict.fromkeys([f"dct_{name}" for name in ("kurtosis", "high_freq_ratio", "mid_band_ratio", "boundary_energy", "std", "avg_dc", "low_high_ratio")]),
    **dict.fromkeys([f"wavelet_{kind}_{i}" for kind in ("energy", "entropy") for i in range(3 * LEVELS)]),
    **dict.fromkeys([f"wavelet_{name}_ratio" for name in ("detail", "cross_scale", "ll")]),
    **dict.fromkeys([f"noise_{name}" for name in ("kurtosis", "std", "mean_abs", "block_consistency", "flatness")]),
    **dict.fromkeys([f"texture_{name}" for name in ("contrast", "correlation", "energy", "homogeneity", "dissimilarity", "fractal_dim")]),
    "chroma_flatness": 6, "chroma_high_freq_ratio": 6, "chroma_slope": 4, "chroma_cb_dc_ratio": 6, "chroma_cr_dc_ratio": 6, "chroma_cb_cr_corr": 4, "chroma_rg_corr": 4,
    "chroma_gb_corr": 4, "chroma_entropy": 4, "chroma_radial_kurtosis": 4,
    "hos_bicoherence": 6, "hos_bispectrum_kurtosis": 4, "hos_phase_coupling_entropy": 4, "hos_bicoherence_skew": 4, "hos_spectral_asymmetry": 6,
    "jpeg_quant_estimate": 2, "jpeg_hist_kurtosis": 4, "jpeg_hist_periodicity": 6, "jpeg_zero_ratio": 6, "jpeg_mode_spread": 4,
    "prnu_residual_corr": 4, "prnu_residual_energy": 6, "prnu_residual_kurtosis": 4, "prnu_scale_invariance": 4, "prnu_fingerprint_strength": 4,
    "freqtex_lbp_uniformity": 4, "freqtex_lbp_entropy": 4, "freqtex_lbp_contrast": 2, "freqtex_dct_cooc_homogeneity": 4, "freqtex_dct_cooc_contrast": 4, "freqtex_grad_consistency": 4,
}
#: Pixels of a plane that a task works on at a time.
PIECE = 1 << 17


@family("vector", "values array<double>, coherence double", "y", "gray", "red", "green", "blue")
def _vector(y: np.ndarray, gray: np.ndarray, red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> dict[str, np.ndarray]:
    """All features, not yet rounded, non-finite ones 0; the coherence, whose bounds a column sets, has a field of its own."""
    blocks, bands = _cosines(y), _subbands(y)
    with np.errstate(all="ignore"):
        found = {
            **spectral_features(_spectra(y)), **cosine_features(blocks), **subband_features(bands), **noise_features(_noise(y)), **texture_features(_texture(gray)),
            **colour_features(_colour(red, green, blue)), **coupling_features(_coupling(y)), **history_features(blocks), **print_features(_print(y)), **second_order_features(bands),
        }
    values = np.nan_to_num(np.stack([found[name] for name in FEATURES], axis=1).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    return {"values": values, "coherence": values[:, list(FEATURES).index("hos_bicoherence")]}


def _from_image(content: bytes | None, height: int | None, width: int | None, channels: int | None, kind: str | None, seed: int | None, side: int) -> list[tuple]:
    """(variant, number, height, width, planes) of one image, or of each of its variants; planes are None where the bytes are no image of that size."""
    if content is None or not height or not width or channels not in (1, 3, 4) or len(content) != height * width * channels:
        return [(None, None, height, width, None)]
    image = _pixels(content, height, width, channels)
    found = {None: image} if kind is None else VARIANTS[kind](image) if seed is None else VARIANTS[kind](image, seed)
    return [(name, n if name else None, own.shape[1], own.shape[2], planes_of(own, side)) for n, (name, own) in enumerate(found.items())]


def planes_of(image: np.ndarray, side: int) -> dict[str, np.ndarray]:
    """Planes in [0, 1] of a blue-green-red image at ``side``; gray is y."""
    b, g, r = letterboxed(image, side)
    scaled = lambda plane: (plane / 255.0).astype(np.float32).astype(np.float64)
    grey = scaled(np.round(0.299 * r + 0.587 * g + 0.114 * b))
    return {"y": grey, "gray": grey, "red": scaled(r), "green": scaled(g), "blue": scaled(b)}


def _square(values: list[float] | None) -> np.ndarray | None:
    side = int(round(np.sqrt(len(values or ()))))
    return np.asarray(values, np.float64).reshape(side, side) if values and side * side == len(values) else None


def _arrow(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """Numbers of stacked planes as a column: an axis of an array is a level of lists."""
    if isinstance(values, list) or values.ndim == 1:
        return pa.array(values, kind)
    own = _arrow(values.reshape(-1, *values.shape[2:]), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), own, type=kind)


def measured(df: DataFrame, families: Sequence[str] = VECTOR, side: int = SIDE, variants: str | None = None, seed_col: str | None = None, when: Column | None = None) -> DataFrame:
    """``df`` without its pixels or planes, with a struct column plane__<name> for each of ``families``: one pass over the rows.

    Rows are images (pixels: blue-green-red bytes, height, width, channels), which are letterboxed to ``side`` in the same pass, each once for each of its
    ``variants`` if these are asked for (then with variant, number, and the variant's size); or they have the planes y, gray, red, green, blue as arrays.
    An image goes to Python once, as bytes, and only the families' numbers come back, ``PIECE`` pixels at a time. Rows without an
    image of their size, and those for which ``when`` isn't true, get null structs.
    """
    images = "pixels" in df.columns
    own = {name: FAMILIES[name] for name in families}
    needed = [c for c in PLANES if any(c in f.planes for f in own.values())]
    sources = ["pixels"] if images else needed
    if when is not None:
        df = df.withColumns({c: F.when(when, F.col(c)) for c in sources})
    kept = [f for f in df.schema.fields if f.name not in (["pixels"] if images else PLANES)]
    extra = [T.StructField("variant", T.StringType()), T.StructField("number", T.IntegerType())] if variants else []
    schema = T.StructType([*kept, *extra, *[T.StructField(f"plane__{name}", f.kind) for name, f in own.items()]])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def numbers(planes: list[dict[str, np.ndarray] | None]) -> list[pa.Array]:
        by_shape: dict[tuple, list[int]] = {}
        for i, p in enumerate(planes):
            if p is not None:
                by_shape.setdefault(next(iter(p.values())).shape, []).append(i)
        stacks = [{c: np.stack([planes[i][c] for i in rows]) for c in needed} for rows in by_shape.values()]
        place = {i: at for at, i in enumerate(i for rows in by_shape.values() for i in rows)}
        places, out = pa.array([place.get(i) for i in range(len(planes))], pa.int64()), []
        for name, f in own.items():
            kind = arrow.field(f"plane__{name}").type
            found = [f.work(*[stack[c] for c in f.planes]) for stack in stacks]
            parts = [pa.StructArray.from_arrays([_arrow(v[field.name], field.type) for field in kind], fields=list(kind)) for v in found]
            out.append(pa.concat_arrays(parts).take(places) if parts else pa.nulls(len(planes), kind))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.keep_heap()
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}

            def emit(piece: list[tuple]) -> pa.RecordBatch:
                rows = pa.array([p[0] for p in piece], pa.int64())
                fixed = {n: column[n].take(rows) for n in names}
                if variants:
                    fixed |= {"variant": pa.array([p[1] for p in piece], pa.string()), "number": pa.array([p[2] for p in piece], pa.int32())}
                    fixed |= {n: pa.array([p[k] for p in piece], arrow.field(n).type) for n, k in (("height", 3), ("width", 4)) if n in names}
                return pa.RecordBatch.from_arrays([*fixed.values(), *numbers([p[5] for p in piece])], schema=arrow)

            piece, size = [], 0
            for i in range(batch.num_rows):
                if images:
                    seed = column[seed_col][i].as_py() if seed_col else None
                    found = _from_image(*[column[c][i].as_py() for c in ("pixels", "height", "width", "channels")], variants, seed, side)
                else:
                    planes = {c: _square(column[c][i].as_py()) for c in needed}
                    found = [(None, None, None, None, None if any(p is None for p in planes.values()) else planes)]
                for one in found:
                    piece.append((i, *one))
                    size += next(iter(one[4].values())).size if one[4] else 0
                    if size >= PIECE or len(piece) >= 1000:
                        yield emit(piece)
                        piece, size = [], 0
            if piece:
                yield emit(piece)

    return df.mapInArrow(run, schema)


def feature_columns() -> dict[str, Column]:
    """The features by name, in their contractual order, rounded as columns are: halves up, of the number as it is written."""
    values = F.col("plane__vector.values")
    found = {name: F.get(values, F.lit(i)) for i, name in enumerate(FEATURES)} | {"hos_bicoherence": clip(F.col("plane__vector.coherence"), 0.0, 1.0)}
    return {name: c if FEATURES[name] is None else F.round(c, FEATURES[name]) for name, c in found.items()}


def features_of() -> Column:
    """The array of all features; null where there is no image."""
    return F.when(F.col("plane__vector.values").isNotNull(), F.array(*feature_columns().values()))


def extract(df: DataFrame, side: int = SIDE, variants: str | None = None, seed_col: str | None = None) -> DataFrame:
    """``df`` (images or planes, as ``measured`` takes them) with ``features``: an array of 120, non-finite ones 0; null where there is no image."""
    parts = measured(df, VECTOR, side, variants, seed_col)
    kept = [c for c in parts.columns if not c.startswith("plane__")]
    return parts.select(*kept, features_of().alias("features"))


def perceptual_hash(df: DataFrame, name: str = "hash", side: int = SIDE) -> DataFrame:
    """``df`` with 64 bits, the first one highest: which low frequencies of the plane at 32 x 32 are above their median."""
    found = measured(df, ["hash"], side)
    bits = F.aggregate(F.col("plane__hash.bits"), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    return found.withColumn(name, bits).drop("plane__hash")


def tile_figures(t: Column) -> Column:
    """Of the tiles of one image an array of (slope, flatness)."""
    return F.arrays_zip(t["slope"].alias("slope"), t["flatness"].alias("flatness"))


def tile_slopes(df: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """(key, tile, slope, flatness) of the tiles of each plane."""
    parts = measured(df, ["tiles"], side).select(key, tile_figures(F.col("plane__tiles")).alias("t"))
    return parts.select(key, F.posexplode("t").alias("tile", "z")).select(key, "tile", "z.slope", "z.flatness")


def signature(side: int = SIDE, block: int = BLOCK, wavelet: str = "db4", levels: int = LEVELS, radial: int = RADIAL, sectors: int = SECTORS) -> str:
    """The settings that features depend on, as one text."""
    return ",".join(map(str, (side, block, wavelet, levels, radial, sectors)))


def missing(images: DataFrame, cached: DataFrame, key: tuple[str, ...] = ("sha256", "signature")) -> DataFrame:
    """Images whose features the cache table lacks."""
    return images.join(cached.select(*key).distinct(), list(key), "left_anti")


def bounded(cached: DataFrame, order: str, most: int) -> DataFrame:
    """The newest ``most`` rows of a cache that drops the oldest first."""
    return cached.orderBy(F.desc(order)).limit(most)


def synthetic(seeds: DataFrame, side: int = SIDE) -> DataFrame:
    """(id, label, pixels, height, width, channels) for each row of ``seeds`` (id): even ones have a natural spectrum (0), odd ones a flat one and a grid (1)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:side, :side]
        f = np.hypot(*np.meshgrid(np.fft.fftfreq(side), np.fft.fftfreq(side), indexing="ij"))
        f[0, 0] = 1.0
        for frame in frames:
            out = []
            for seed, label in zip(frame["id"] // 2, frame["id"] % 2):
                random = np.random.default_rng(int(seed))
                phase = random.uniform(0, 2 * np.pi, (side, side))
                base = np.fft.ifft2(f ** -(0.45 if label else 1.05) * np.exp(1j * phase)).real
                base /= np.abs(base).max() + 1e-9
                extra = 0.35 * np.sin(x * np.pi / 2) * np.sin(y * np.pi / 2) if label else 0.045 * np.sin(x / (10 + seed % 17)) * np.cos(y / (12 + seed % 23))
                image = base + extra + random.normal(0, 0.004 if label else 0.02, (side, side))
                out.append(np.repeat((np.clip(image * 0.5 + 0.5, 0, 1) * 255).astype(np.uint8)[:, :, None], 3, axis=2).tobytes())
                if len(out) * side * side >= PIECE:
                    yield frame_of(frame, out)
                    frame, out = frame.iloc[len(out) :], []
            yield frame_of(frame, out)

    def frame_of(frame: pd.DataFrame, out: list[bytes]) -> pd.DataFrame:
        ids = frame["id"].iloc[: len(out)]
        return pd.DataFrame({"id": ids, "label": (ids % 2).astype("int32"), "pixels": out})

    rows = seeds.select(F.col("id").cast("long").alias("id")).where("id is not null").mapInPandas(make, "id long, label int, pixels binary")
    return rows.withColumns({"height": F.lit(side), "width": F.lit(side), "channels": F.lit(3)})


def _pixels(content: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(3, height, width): blue, green, red."""
    image = np.frombuffer(content, np.uint8).reshape(height, width, channels)
    return (np.repeat(image, 3, axis=2) if channels == 1 else image[:, :, :3]).transpose(2, 0, 1).astype(np.float64)


def letterboxed(image: np.ndarray, side: int) -> np.ndarray:
    """Blue, green, red at ``side``, in whole steps of grey, proportions kept, on black."""
    h, w = image.shape[1:]
    scale = side / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    out = np.zeros((3, side, side))
    y, x = (side - nh) // 2, (side - nw) // 2
    out[:, y : y + nh, x : x + nw] = np.round(S.resized(image, nh, nw)) if (nh, nw) != (h, w) else image
    return out


def preprocess(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Images (pixels: blue-green-red bytes, height, width, channels) -> planes y, gray, red, green, blue in [0, 1]; other columns stay.

    For those who need the planes themselves: features come from ``extract``, which never sends them back.
    """
    kept = [f for f in images.schema.fields if f.name != "pixels"]
    schema = T.StructType([*kept, *[T.StructField(p, T.ArrayType(T.FloatType())) for p in PLANES]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PIECE // (side * side))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                planes = [_from_image(*[part.column(c)[i].as_py() for c in ("pixels", "height", "width", "channels")], None, None, side)[0][4] for i in range(part.num_rows)]
                made = [pa.array([None if p is None else p[c].ravel().astype(np.float32) for p in planes], arrow.field(c).type) for c in PLANES]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *made], schema=arrow)

    return images.mapInArrow(run, schema)


#: The luminance quantisation steps that JPEG quality scales, by rows.
QUANTA = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)


def recompressed(image: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG at ``quality`` loses: block coefficients in whole steps.  Every channel is quantised as luminance, in its own colour."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((np.array(QUANTA) * scale + 50) / 100), 1, 255)
    h, w = image.shape[1:]
    room = np.pad(image, [(0, 0), (0, -h % 8), (0, -w % 8)], mode="edge") - 128
    blocks = S.block_cosines(S.tiles(room, 8))
    basis = S.cosines(8)
    back = basis.T @ (np.round(blocks / steps) * steps) @ basis
    hh, ww = room.shape[1:]
    whole = back.reshape(3, hh // 8, ww // 8, 8, 8).swapaxes(2, 3).reshape(3, hh, ww)
    return np.clip(np.round(whole + 128), 0, 255)[:, :h, :w]


def round_trip(image: np.ndarray, scale: float) -> np.ndarray:
    h, w = image.shape[1:]
    small = np.round(S.resized(image, max(8, int(h * scale)), max(8, int(w * scale))))
    return np.round(S.resized(small, h, w, linear=True))


def degraded(image: np.ndarray, seed: int) -> np.ndarray:
    """One random chain of recompression, round trip, blur, noise and crop, the same for a seed."""
    random, (h, w) = np.random.default_rng(seed), image.shape[1:]
    if random.random() < 0.7:
        image = recompressed(image, int(random.integers(30, 96)))
    if random.random() < 0.5:
        image = round_trip(image, float(random.uniform(0.5, 2.0)))
    if random.random() < 0.4 and (sigma := float(random.uniform(0.0, 1.5))) > 0.05:
        image = np.round(S.blurred(image, sigma, 2 * int(np.ceil(3 * sigma)) + 1))
    if random.random() < 0.4 and (spread := float(random.uniform(0.0, 0.02))) > 0.0005:
        image = np.floor(np.clip(image + random.normal(0.0, spread, image.shape) * 255.0, 0, 255))
    if random.random() < 0.4:
        share = float(random.uniform(0.7, 1.0))
        ch, cw = max(8, int(h * share)), max(8, int(w * share))
        y, x = int(random.integers(0, h - ch + 1)), int(random.integers(0, w - cw + 1))
        image = np.round(S.resized(image[:, y : y + ch, x : x + cw], h, w, linear=True))
    return image


def tta(image: np.ndarray) -> dict[str, np.ndarray]:
    h, w = image.shape[1:]
    ch, cw = max(8, int(h * 0.85)), max(8, int(w * 0.85))
    return {"full": image, "small": round_trip(image, 0.75), "large": round_trip(image, 1.25), "top": image[:, :ch, :cw], "bottom": image[:, h - ch :, w - cw :]}


def demo(image: np.ndarray) -> dict[str, np.ndarray]:
    h, w = image.shape[1:]
    return {"pristine": image, "jpeg60": recompressed(image, 60), "resize": round_trip(image, 1.5), "crop": image[:, h // 8 : -(h // 8) or None, w // 8 : -(w // 8) or None]}


def benchmark(image: np.ndarray) -> dict[str, np.ndarray]:
    """As the benchmark makes them: the variant named jpeg60 has quality 50, the screenshot has bars above and below."""
    h, w = image.shape[1:]
    bars = np.full((3, h + 80, w), 245.0)
    bars[:, 40 : 40 + h] = image
    return {"pristine": image, "jpeg60": recompressed(image, 50), "resize": round_trip(image, 0.5), "screenshot": bars}


def augmented(image: np.ndarray, seed: int = 42) -> dict[str, np.ndarray]:
    return {"pristine": image, "degraded": degraded(image, seed)}


VARIANTS = {"tta": tta, "demo": demo, "benchmark": benchmark, "augmented": augmented}


def variants(images: DataFrame, kind: str, seed_col: str | None = None) -> DataFrame:
    """Each image once for each of its variants, named in ``variant`` and numbered in ``number``; sizes are those of the variants."""
    make = VARIANTS[kind]
    schema = T.StructType([*images.schema.fields, T.StructField("variant", T.StringType()), T.StructField("number", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                image = _pixels(row["pixels"], row["height"], row["width"], row["channels"])
                found = make(image, int(row[seed_col])) if seed_col else make(image)
                for number, (name, own) in enumerate(found.items()):
                    shape = {"pixels": own.transpose(1, 2, 0).astype(np.uint8).tobytes(), "height": own.shape[1], "width": own.shape[2], "channels": 3}
                    out.append(row | shape | {"variant": name, "number": number})
                    size += own[0].size
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, arrow)

    return images.mapInArrow(run, schema)


def as_files(images: DataFrame, key: str) -> DataFrame:
    """(key, png, bmp): each image in both containers."""
    schema = T.StructType([images.schema[key], T.StructField("png", T.BinaryType()), T.StructField("bmp", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shaped = [_pixels(*x).transpose(1, 2, 0).astype(np.uint8) for x in zip(*[batch.column(c).to_pylist() for c in ("pixels", "height", "width", "channels")])]
            for first in range(0, len(shaped), 256):
                own = shaped[first : first + 256]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, 256), pa.array(map(codecs.encode, own), pa.binary()), pa.array(map(codecs.encode_bmp, own), pa.binary())], schema=arrow)

    return images.mapInArrow(run, schema)


ORIENTATION = 0x0112


def turn_of(content: bytes | None) -> int:
    """The orientation (1 to 8) that a file's metadata gives; 1 where it gives none."""
    content = content or b""
    base = content.find(b"Exif\0\0") + 6
    order = {b"II": "<", b"MM": ">"}.get(content[base : base + 2]) if base >= 6 else None
    if order is None or len(content) < base + 10:
        return 1
    entries = content[base + struct.unpack(order + "I", content[base + 4 : base + 8])[0] :]
    count = struct.unpack(order + "H", entries[:2])[0] if len(entries) >= 2 else 0
    for at in range(2, min(2 + 12 * count, len(entries) - 11), 12):
        tag, _, _, value = struct.unpack(order + "HHIH", entries[at : at + 10])
        if tag == ORIENTATION:
            return value if 1 <= value <= 8 else 1
    return 1


def turned(image: np.ndarray, way: int) -> np.ndarray:
    """An image (rows, columns, samples) mirrored and turned as its orientation (1 to 8) says."""
    if way in (2, 5, 7):
        image = image[:, ::-1]
    if way == 4:
        image = image[::-1]
    return np.rot90(image, {3: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(way, 0))


@pandas_udf(T.IntegerType())
def orientation(content: pd.Series) -> pd.Series:
    return content.map(turn_of)


def upright(images: DataFrame, turn: str = "orientation") -> DataFrame:
    """Images turned and mirrored once as their orientation says; afterwards it is 1."""
    arrow = to_arrow_schema(images.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                image = turned(np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"]), row[turn] or 1)
                row |= {"pixels": image.tobytes(), "height": image.shape[0], "width": image.shape[1], turn: 1}
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return images.mapInArrow(run, images.schema)
