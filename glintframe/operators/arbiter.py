"""Checks of a picture's content, for scores that are in doubt: light, edges, skin.

Families of ``planes.measured`` measure (means of edge directions, edge coherence, skin components); flags are column
expressions over what they return.  ``arbitrate`` sends only images in doubt to Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.functions import signal as S
from glintframe.functions.numeric import lit
from glintframe.operators.narrative import arbiter_needed, suspicious
from glintframe.operators.planes import SIDE, family, measured

#: Bounds of the flags, least area of a region, regions that are too many.
LIGHT_SPREAD, EDGE_SPREAD, ASYMMETRY, NO_REGION = 0.55, 0.5, 0.55, 0.55
LEAST_AREA, MOST_SHARE, MANY_REGIONS, EDGE_LOW, EDGE_HIGH = 400, 0.6, 6, 100, 200
#: The sentences of the flags.
LABELS = {
    "light": "Inconsistent edge-gradient direction across quadrants (divergent light source)",
    "edges": "Background edge-orientation irregularity (non-Euclidean texture seams)",
    "none": "No plausible hand/limb regions detected",
    "many": "Implausibly many hand-like regions (%d)",
    "asymmetry": "Strong bilateral asymmetry in skin-tone distribution",
}


def edges(grey: np.ndarray) -> np.ndarray:
    """Thin edges of one plane (0 to 255): ridges of the gradient above the upper bound, and what is joined to them above the lower one."""
    gx, gy = (g[0] for g in S.slopes(grey[None]))
    steep = np.abs(gx) + np.abs(gy)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    room = np.pad(steep, 1)
    h, w = steep.shape
    ridge = np.zeros(steep.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = room[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], room[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        ridge |= (sector == k) & (steep > behind) & (steep >= ahead)
    weak, found = ridge & (steep > EDGE_LOW), ridge & (steep > EDGE_HIGH)
    while True:
        grown = weak & widened(found, 1)
        if (grown == found).all():
            return found
        found = grown


def widened(mask: np.ndarray, by: int) -> np.ndarray:
    """``mask`` with all that is ``by`` pixels from it at most, along each axis."""
    return around(np.logical_or, mask, by, False)


def around(join: np.ufunc, values: np.ndarray, by: int, outside: int | bool) -> np.ndarray:
    """``join`` (of two arrays, in any order) over the square of side 2 ``by`` + 1 around each place, one axis after the other."""
    for axis, size in enumerate(values.shape):
        room = np.full([n + 2 * by * (k == axis) for k, n in enumerate(values.shape)], outside, values.dtype)
        part = lambda first: (slice(None),) * axis + (slice(first, first + size),)  # noqa: B023, E731
        room[part(by)] = values
        values = join(room[part(0)], room[part(1)])
        for k in range(2, 2 * by + 1):
            join(values, room[part(k)], out=values)
    return values


def opened(mask: np.ndarray, by: int) -> np.ndarray:
    """``mask`` without what a square of side 2 ``by`` + 1 doesn't fit in."""
    return widened(~widened(~mask, by), by)


def regions(mask: np.ndarray) -> list[int]:
    """Areas of the 8-connected parts of ``mask``: of the polygon through the centres of their outermost pixels, by Pick's theorem."""
    if not mask.any():
        return []
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        least = np.where(mask, around(np.minimum, label, 1, h * w), h * w)
        flat = np.append(least.ravel(), h * w)
        least = np.where(mask, flat[least], h * w)  # a jump to the label that one's own label has by now
        if (least == label).all():
            break
        label = least
    rim = mask & widened(~np.pad(mask, 1), 1)[1:-1, 1:-1]
    sizes, rims = np.bincount(label[mask], minlength=1), np.bincount(label[rim], minlength=1)
    return [int(n - b / 2 - 1) for n, b in zip(sizes, np.pad(rims, (0, len(sizes) - len(rims)))) if n]


@family("light", "directions array<double>, irregularity double, edge_pixels long", "gray")
def _light(gray: np.ndarray) -> dict[str, np.ndarray]:
    grey = np.round(gray * 255)
    gx, gy = S.slopes(grey)
    angle, steep = np.arctan2(gy, gx + 1e-6), np.hypot(gx, gy)
    n, h, w = grey.shape
    y, x = h // 2, w // 2
    bound = np.percentile(steep.reshape(n, -1), 80, axis=1)
    means, spread, count = [], [], []
    for i in range(n):
        own = []
        for part in (angle[i, :y, :x], angle[i, :y, x:], angle[i, y:, :x], angle[i, y:, x:]):
            m = part[steep[i, : part.shape[0], : part.shape[1]] > bound[i]]  # strong edges of the first quadrant, for all four
            if m.size:
                own.append(float(np.arctan2(np.sin(m).mean(), np.cos(m).mean())))
        means.append(own)
        found = edges(grey[i])
        turned = angle[i][found]
        count.append(int(found.sum()))
        spread.append(float(1 - np.hypot(np.sin(turned).mean(), np.cos(turned).mean())) if len(turned) >= 4 else 0.0)
    return {"directions": means, "irregularity": np.array(spread), "edge_pixels": np.array(count)}


@family("skin", "areas array<int>, left double, right double, pixels long", "red", "green", "blue")
def _skin(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> dict[str, np.ndarray]:
    r, g, b = (np.round(c * 255) for c in (red, green, blue))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    width = np.maximum(top - low, 1e-9)
    hue = np.where(top == r, 30 * (g - b) / width, np.where(top == g, 60 + 30 * (b - r) / width, 120 + 30 * (r - g) / width)) % 180  # half degrees
    strong = (255 * (top - low) / np.maximum(top, 1) >= 30) & (top >= 40)
    skin = strong & ((np.round(hue) <= 25) | (np.round(hue) >= 160))
    half, out = red.shape[2] // 2, {"areas": [], "left": [], "right": [], "pixels": []}
    for own in skin:
        own = opened(own, 2)
        out["areas"].append(regions(own))
        out["left"].append(float(own[:, :half].sum()))
        out["right"].append(float(own[:, half:].sum()))
        out["pixels"].append(own.size)
    return out


def _flag(kind: str, condition: Column, label: Column | str, score: Column) -> Column:
    words = F.lit(label) if isinstance(label, str) else label
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), words.alias("label"), F.least(lit(1.0), score).alias("score")))


def flags(light_parts: Column, skin_parts: Column) -> Column:
    """Flags (kind, label, score) that are raised: anatomy, optics, topology."""
    d = light_parts["directions"]
    mean = lambda f: F.aggregate(d, lit(0.0), lambda s, x: s + f(x)) / F.size(d)
    spread = lit(1.0) - F.sqrt(mean(F.sin) * mean(F.sin) + mean(F.cos) * mean(F.cos))
    hands = F.size(F.filter(skin_parts["areas"], lambda a: (a >= LEAST_AREA) & (a <= skin_parts["pixels"] * MOST_SHARE)))
    left, right = skin_parts["left"], skin_parts["right"]
    uneven = F.abs(left - right) / (left + right + 1e-6 / 255)
    raised = [
        _flag("anatomy", hands == 0, LABELS["none"], lit(NO_REGION)), _flag("anatomy", hands > MANY_REGIONS, F.format_string(LABELS["many"], hands), hands / lit(12.0)),
        _flag("anatomy", uneven > ASYMMETRY, LABELS["asymmetry"], uneven), _flag("optics", (F.size(d) >= 2) & (spread > LIGHT_SPREAD), LABELS["light"], spread),
        _flag("topology", light_parts["irregularity"] > EDGE_SPREAD, LABELS["edges"], light_parts["irregularity"]),
    ]
    return F.array_compact(F.array(*raised))


def arbitrate(df: DataFrame, p: str = "p", side: int = SIDE) -> DataFrame:
    """``df`` (images or planes, as ``measured`` takes them, and a score) with flags and whether they make it suspicious; none for scores out of doubt."""
    asked = measured(df, ["light", "skin"], side, when=arbiter_needed(F.col(p)))
    none = F.array().cast("array<struct<kind:string,label:string,score:double>>")
    raised = F.when(F.col("plane__light.edge_pixels").isNotNull(), flags(F.col("plane__light"), F.col("plane__skin"))).otherwise(none)
    out = asked.withColumn("flags", raised).drop("plane__light", "plane__skin")
    return out.withColumn("suspicious", suspicious(F.transform("flags", lambda f: f["score"])))
