"""Spectral, block-transform and texture statistics of square tiles, with SQL functions only.

A tile is a row with an array of side * side values.  Transforms are products with constant
bases inside the row, so pixels are never shuffled; what is grouped afterwards are counts and
sums of an image's tiles, combined before the shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions.numeric import bin_index, clip, finite, lit, ratio

#: Fixed value.
EPS = 1e-12
#: Neighbours in the order of the code's bits.
OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
#: GLCM steps: distances 1 and 2 at 0, 45, 90 and 135 degrees.
STEPS = tuple((d * dy, d * dx) for d in (1, 2) for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)))


def constant(values: list, kind: str) -> Column:
    """A literal array of any depth, folded when the query is planned."""
    return F.from_json(F.lit(json.dumps({"x": values})), f"struct<x:{kind}>")["x"]


def dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), lit(0.0), lambda s, x: s + x)


def bound(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` uses it in lambdas of its own."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def product(values: Column, basis: list[list[float]]) -> Column:
    return bound(values, lambda own: F.transform(constant(basis, "array<array<double>>"), lambda row: dot(own, row)))


def plane(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def centred(values: Column) -> Column:
    mean = F.aggregate(values, lit(0.0), lambda s, x: s + x) / F.size(values)
    return bound(mean, lambda m: F.transform(values, lambda x: x - m))


def dct_basis(side: int) -> list[list[float]]:
    """Orthonormal DCT-II: one row per coefficient (u, v), over pixels (y, x)."""
    w = [[(math.sqrt(1 / side) if not u else math.sqrt(2 / side)) * math.cos((2 * x + 1) * u * math.pi / (2 * side)) for x in range(side)] for u in range(side)]
    return [[w[u][y] * w[v][x] for y in range(side) for x in range(side)] for u in range(side) for v in range(side)]


def dct(values: Column, side: int = 8) -> Column:
    return product(plane(values), dct_basis(side))


def half_grid(side: int) -> list[tuple[int, int]]:
    """Frequencies (row, column) of a real transform's half plane, rows unshifted."""
    return [(u, w) for u in range(side) for w in range(side // 2 + 1)]


def spectrum(values: Column, side: int = 8) -> tuple[Column, Column]:
    """Real and imaginary parts of the centred tile's transform; noise below 1e-9 is cut so that signs of zeros agree."""
    angle = [[2 * math.pi * (u * y + w * x) / side for y in range(side) for x in range(side)] for u, w in half_grid(side)]
    px = centred(plane(values))
    cut = lambda c: F.transform(c, lambda v: F.floor(v * lit(1e9) + lit(0.5)) / lit(1e9))
    return cut(product(px, [[math.cos(a) for a in row] for row in angle])), cut(product(px, [[-math.sin(a) for a in row] for row in angle]))


def with_spectrum(df: DataFrame, vector: str, side: int = 8) -> DataFrame:
    """Adds arrays magnitude and phase over ``half_grid``."""
    re, im = spectrum(F.col(vector), side)
    staged = df.withColumn("re", re).withColumn("im", im)
    return staged.withColumns({
        "magnitude": F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)), "phase": F.zip_with("im", "re", lambda a, b: F.atan2(a, b)),
    }).drop("re", "im")


def masks_mean(values: Column, groups: list[int], n: int) -> Column:
    """Mean of ``values`` by the group number of each place; 0 for an empty group."""
    rows = []
    for g in range(n):
        count = max(1, groups.count(g))
        rows.append([1.0 / count if own == g else 0.0 for own in groups])
    return product(values, rows)


def masked_sum(values: Column, mask: list[bool]) -> Column:
    return dot(values, constant([float(m) for m in mask], "array<double>"))


def radii(side: int) -> list[float]:
    """Distance of each frequency from index (0, 0) of the unshifted half plane."""
    return [math.hypot(u, w) for u, w in half_grid(side)]


def radial_bins(side: int, n: int) -> list[int]:
    r = radii(side)
    edges = [10 ** (i * math.log10(max(r) + 1) / n) - 1 for i in range(n + 1)]
    edges[0] = 0.0
    return [max(0, min(n - 1, sum(e <= x for e in edges) - 1)) for x in r]


def radial_centres(side: int, n: int) -> list[float]:
    """Mean radius of each bin, 0 for an empty one."""
    bins, r = radial_bins(side, n), radii(side)
    return [sum(x for x, b in zip(r, bins) if b == k) / max(1, bins.count(k)) for k in range(n)]


def radial_profile(magnitude: Column, side: int, n: int) -> Column:
    """Mean magnitude by log-spaced radius, as shares of their sum."""
    means = masks_mean(magnitude, radial_bins(side, n), n)
    total = F.aggregate(means, lit(EPS), lambda s, x: s + x)
    return F.transform(means, lambda x: x / total)


def azimuthal_bins(side: int, n: int) -> list[int]:
    """Sector of each frequency between a tenth and nine tenths of the greatest radius; -1 outside."""
    r = radii(side)
    sector = [math.floor((math.atan2(u, w) + math.pi) / (2 * math.pi) * n) % n for u, w in half_grid(side)]
    return [s if 0.1 * max(r) < x < 0.9 * max(r) else -1 for s, x in zip(sector, r)]


def spectral_scalars(df: DataFrame, side: int = 8) -> DataFrame:
    """Adds flatness (r > 2), phase_entropy (r > 2, 32 bins), high_ratio, dc_ratio and quadrant_asymmetry."""
    r, grid = radii(side), half_grid(side)
    far = [x > 2 for x in r]
    n = float(sum(far))
    power = F.transform("magnitude", lambda m: m * m)
    total = F.aggregate(power, lit(EPS), lambda s, x: s + x)
    logs = F.transform(power, lambda p: F.log(p + lit(EPS)))
    nyquist, rows, cols = min(side, side // 2 + 1) // 2, side, side // 2 + 1
    high = [u >= rows - nyquist and w >= cols - nyquist for u, w in grid] if nyquist > 2 else [False] * len(grid)
    q1, q4 = [u < rows // 2 and w < cols // 2 for u, w in grid], [u >= rows // 2 and w >= cols // 2 for u, w in grid]
    enough = sum(c > 2 for c in radial_centres(side, 24)) > 10
    chosen = F.filter(F.zip_with("phase", constant([float(f) for f in far], "array<double>"), lambda p, f: F.when(f > 0, p)), lambda p: p.isNotNull())
    bins = F.transform(chosen, lambda p: F.least(F.floor((p + lit(math.pi)) / lit(2 * math.pi) * 32), F.lit(31)).cast("int"))
    shares = F.transform(F.array_distinct(bins), lambda b: F.size(F.filter(bins, lambda x: x == b)) / F.size(bins))
    entropy = F.aggregate(shares, lit(0.0), lambda s, p: s - p * F.log2(p)) / lit(5.0)
    a, d = masked_sum(F.col("magnitude"), q1), masked_sum(F.col("magnitude"), q4)
    return df.withColumns({
        "flatness": F.exp(masked_sum(logs, far) / n) / (masked_sum(power, far) / n + lit(EPS)) if enough else lit(0.0), "phase_entropy": entropy,
        "high_ratio": masked_sum(power, high) / total, "dc_ratio": F.get(power, F.lit(0)) / total, "quadrant_asymmetry": (a - d) / (a + d + lit(EPS)),
    })


def slope_fit(df: DataFrame, key: str, side: int = 8, n: int = 24) -> DataFrame:
    """Per tile: least-squares slope and intercept of ln(mean magnitude) on ln(mean radius) over log-spaced radial bins.

    Bins with a mean radius above 2 and below 0.85 of the largest count; with fewer than five of them both are 0.
    """
    bins, centres = radial_bins(side, n), radial_centres(side, n)
    kept = [k for k, c in enumerate(centres) if 2 < c < 0.85 * max(centres)]
    if len(kept) < 5:
        return df.select(key, lit(0.0).alias("slope"), lit(0.0).alias("intercept"))
    x = [math.log(centres[k]) for k in kept]
    mean = sum(x) / len(x)
    pull = [(v - mean) / sum((u - mean) ** 2 for u in x) for v in x]  # weights of least squares
    logs = bound(masks_mean(F.col("magnitude"), bins, n), lambda own: F.transform(constant(kept, "array<int>"), lambda k: F.log(F.get(own, k) + lit(EPS))))
    slope = bound(logs, lambda y: F.struct(dot(y, constant(pull, "array<double>")).alias("slope"), (F.aggregate(y, lit(0.0), lambda s, v: s + v) / len(x)).alias("mean")))
    return df.select(key, slope.alias("fit")).select(key, "fit.slope", (F.col("fit.mean") - F.col("fit.slope") * mean).alias("intercept"))


def dct_statistics(df: DataFrame, image: str, vector: str, side: int = 8) -> DataFrame:
    """Per image over its tiles: band ratios, boundary energy, mean DC, low to high, and deviation and excess kurtosis of the inner coefficients' magnitudes."""
    places = [(u, v) for u in range(side) for v in range(side)]
    r = [math.hypot(u, v) for u, v in places]
    bands = {
        "low": [0 < x <= side / 4 for x in r], "mid": [side / 4 < x <= side / 2 for x in r], "high": [x > side / 2 for x in r],
        "edge": [(u in (0, side - 1) or v in (0, side - 1)) and (u, v) != (0, 0) for u, v in places], "all": [True] * len(r), "dc": [p == (0, 0) for p in places],
    }
    inner = [u > 0 and v > 0 for u, v in places]
    energy = F.transform(dct(F.col(vector), side), lambda c: c * c)
    staged = df.select(image, energy.alias("energy"))
    size = F.transform("energy", lambda e: F.sqrt(e))
    power = lambda k: masked_sum(F.transform(size, lambda x: F.pow(x, lit(k))), inner)
    sums = staged.select(image, *[masked_sum(F.col("energy"), m).alias(n) for n, m in bands.items()], *[power(float(k)).alias(f"p{k}") for k in (1, 2, 3, 4)])
    g = sums.groupBy(image).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (*bands, "p1", "p2", "p3", "p4")])
    count = F.col("n") * float(sum(inner))
    m1, m2, m3, m4 = (F.col(f"p{k}") / count for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    ac = F.col("low") + F.col("mid") + F.col("high") + lit(EPS)
    return g.select(
        image, "n", (F.col("mid") / ac).alias("mid_ratio"), (F.col("high") / ac).alias("high_ratio"), (F.col("edge") / (F.col("all") + lit(EPS))).alias("boundary"),
        (F.col("dc") / F.col("n")).alias("avg_dc"), ((F.col("low") + lit(EPS)) / (F.col("high") + lit(EPS))).alias("low_high"),
        F.sqrt(var).alias("coeff_std"), (fourth / (var * var + lit(EPS)) - 3).alias("coeff_kurtosis"),
    )


def jpeg_history(df: DataFrame, image: str, vector: str, side: int = 8, bins: int = 64) -> DataFrame:
    """Per image: quality estimate, and of the inner coefficients' histogram kurtosis, periodicity, share near zero and mass around the mode."""
    staged = df.select(image, dct(F.col(vector), side).alias("c"))
    # One pass over the coefficients: an expression that names them within a lambda would compute them again for each place.
    picked = F.filter("c", lambda x, i: (i >= side) & (i % side > 0))
    squares = lambda a: F.aggregate(a, lit(0.0), lambda s, x: s + x * x)
    edges = staged.groupBy(image).agg(
        F.min(F.array_min(picked)).alias("low"), F.max(F.array_max(picked)).alias("high"), F.sum(squares(F.col("c"))).alias("total"), F.sum(squares(picked)).alias("ac")
    )
    # Edges meet the rows before these are taken apart.
    long = staged.select(image, picked.alias("picked")).join(edges, image).select(image, "low", "high", "total", "ac", F.explode("picked").alias("x"))
    counted = long.groupBy(image, "low", "high", "total", "ac", bin_index(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum((F.abs("x") < 0.5).cast("long")).alias("zeros")
    )
    grouped = counted.groupBy(image, "low", "high", "total", "ac").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"), F.sum("zeros").alias("zeros"), F.sum("n").alias("all"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("counts", b), F.lit(0)).cast("double") + lit(EPS))  # ``bins`` numbers
    h = grouped.withColumn("h", hist).withColumn("sum", F.aggregate("h", lit(0.0), lambda s, x: s + x))
    at = lambda i: F.col("low") + (F.col("high") - F.col("low")) * (i + lit(0.5)) / bins
    h = h.withColumn("mean", F.aggregate(F.transform("h", lambda x, i: x / F.col("sum") * at(i)), lit(0.0), lambda s, x: s + x))
    moment = lambda k: F.aggregate(F.transform("h", lambda x, i: x / F.col("sum") * F.pow(at(i) - F.col("mean"), lit(k))), lit(0.0), lambda s, x: s + x)
    flat = F.transform("h", lambda x: x - F.col("sum") / bins)
    lag = lambda k: F.aggregate(F.transform(F.slice("flat", 1, bins - k), lambda x, i: x * F.get(F.col("flat"), i + k)), lit(0.0), lambda s, x: s + x)
    h = h.withColumn("flat", flat).withColumn("peak", F.array_position("h", F.array_max("h")).cast("int") - 1)
    mass = F.aggregate(F.transform("h", lambda x, i: F.when((i >= F.col("peak") - 3) & (i <= F.col("peak") + 3), x).otherwise(lit(0.0))), lit(0.0), lambda s, x: s + x)
    var = moment(2.0)
    return h.select(
        image, clip(lit(40.0) + (F.col("ac") / (F.col("total") + lit(EPS)) - lit(0.1)) * lit(120.0), 0.0, 100.0).alias("quality"),
        F.when(var > EPS, moment(4.0) / (var * var + lit(EPS))).otherwise(lit(0.0)).alias("kurtosis"),
        (F.greatest(*[lag(k) for k in range(2, 12)]) / (lag(0) + lit(EPS))).alias("periodicity"),
        (F.col("zeros") / F.col("all")).alias("zero_ratio"), clip(mass / F.col("sum"), 0.0, 1.0).alias("mode_mass"),
    )


def histogram_entropy(df: DataFrame, image: str, vector: str, bins: int) -> DataFrame:
    """Normalised Shannon entropy of an equal-width histogram over each image's own range; its rows have arrays of values."""
    rows = df.select(image, plane(F.col(vector)).alias("xs"))
    edges = rows.groupBy(image).agg(F.min(F.array_min("xs")).alias("low"), F.max(F.array_max("xs")).alias("high"))
    at = F.when(F.col("high") > F.col("low"), bin_index(F.col("x"), F.col("low"), F.col("high"), bins)).otherwise(F.lit(0))
    long = rows.join(edges, image).select(image, "low", "high", F.explode("xs").alias("x"))
    counts = long.groupBy(image, at.alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(image))
    return counts.select(image, (-p * F.log2(p)).alias("part")).groupBy(image).agg((F.sum("part") / math.log2(bins)).alias("entropy"))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, 0 where a side doesn't vary."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return finite(F.when((sa > EPS) & (sb > EPS), F.covar_pop(a, b) / (sa * sb)))


def quantised(values: Column, levels: int) -> Column:
    """Values of [0, 1] as levels."""
    return F.transform(values, lambda x: clip(F.floor(x.cast("double") * levels).cast("double"), 0.0, levels - 1.0).cast("int"))


def glcm(df: DataFrame, image: str, vector: Column, side: int = 8, levels: int = 64) -> DataFrame:
    """Per image: contrast, dissimilarity, homogeneity, energy and correlation of symmetric co-occurrences, averaged over steps."""
    pairs = []
    for s, (dy, dx) in enumerate(STEPS):
        for y in range(side):
            for x in range(side):
                if 0 <= y + dy < side and 0 <= x + dx < side:
                    a, b = y * side + x, (y + dy) * side + x + dx
                    pairs += [[s, a, b], [s, b, a]]
    q = df.select(image, quantised(vector, levels).alias("q"))
    cells = F.explode(F.transform(constant(pairs, "array<array<int>>"), lambda t: F.struct(F.get(t, F.lit(0)).alias("step"), F.get(F.col("q"), F.get(t, F.lit(1))).alias("i"), F.get(F.col("q"), F.get(t, F.lit(2))).alias("j"))))
    counts = q.select(image, cells.alias("c")).groupBy(image, "c.step", "c.i", "c.j").agg(F.count("*").alias("n"))
    own = Window.partitionBy(image, "step")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(own))
    i, j, w = F.col("i"), F.col("j"), F.col("p")
    d = i - j
    sums = p.groupBy(image, "step").agg(
        F.sum(w * d * d).alias("contrast"), F.sum(w * F.abs(d)).alias("dissimilarity"), F.sum(w / (lit(1.0) + d * d)).alias("homogeneity"), F.sqrt(F.sum(w * w)).alias("energy"),
        F.sum(w * i).alias("m"), F.sum(w * i * i).alias("m2"), F.sum(w * i * j).alias("ij"),
    )
    var = F.col("m2") - F.col("m") * F.col("m")
    corr = F.when(var > 1e-15, (F.col("ij") - F.col("m") * F.col("m")) / var).otherwise(lit(1.0))
    return sums.withColumn("correlation", corr).groupBy(image).agg(*[F.avg(c).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")])


def uniform_code(code: int) -> bool:
    """Up to two changes in the code as it is printed in binary, prefix included."""
    text = bin(code)
    return text.count("01") + text.count("10") <= 2


def lbp(df: DataFrame, image: str, vector: Column, side: int = 8) -> DataFrame:
    """Per image: uniformity, entropy and variance of 8-neighbour codes (clockwise from the north-west)."""
    cells = [[y * side + x, *[(y + dy) * side + x + dx for dy, dx in OFFSETS]] for y in range(1, side - 1) for x in range(1, side - 1)]
    q = df.select(image, F.transform(vector, lambda v: F.floor(clip(v.cast("double"), 0.0, 1.0) * 255).cast("int")).alias("q"))

    def code(cell: Column) -> Column:
        centre = F.get(F.col("q"), F.get(cell, F.lit(0)))
        return sum((F.when(F.get(F.col("q"), F.get(cell, F.lit(k + 1))) >= centre, 1 << k).otherwise(0) for k in range(8)), F.lit(0))

    counts = q.select(image, F.explode(F.transform(constant(cells, "array<array<int>>"), code)).alias("code")).groupBy(image, "code").agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(image)))
    uniform = [c for c in range(256) if uniform_code(c)]
    s = p.groupBy(image).agg(
        F.sum(F.when(F.col("code").isin(uniform), F.col("p")).otherwise(lit(0.0))).alias("uniformity"), (-F.sum(F.col("p") * F.log2("p")) / 8).alias("entropy"),
        F.sum(F.col("p") * F.col("code")).alias("m"), F.sum(F.col("p") * F.col("code") * F.col("code")).alias("m2"),
    )
    return s.select(image, "uniformity", "entropy", (F.col("m2") - F.col("m") * F.col("m")).alias("variance"))


def block_cooccurrence(df: DataFrame, image: str, vector: str, side: int = 8) -> DataFrame:
    """Per image: homogeneity and contrast of the joint histogram of its tiles' mean sizes in the first and the last quadrant."""
    half = side // 2
    q1 = [i // side < half and i % side < half for i in range(side * side)]
    q4 = [i // side >= half and i % side >= half for i in range(side * side)]
    size = F.transform(plane(F.col(vector)), lambda x: F.abs(x))
    rows = df.select(image, *[F.log(lit(1.0) + masked_sum(size, m) / float(half * half)).alias(n) for n, m in (("a", q1), ("b", q4))])
    edges = rows.groupBy(image).agg(*[f(c).alias(f"{c}_{n}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))])

    def at(c: str) -> Column:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high") + lit(EPS)
        return F.when(high - low < EPS, 0).otherwise(F.least(F.floor((F.col(c) - low) / (high - low) * 15), F.lit(15)).cast("int"))

    joint = rows.join(edges, image).groupBy(image, at("a").alias("i"), at("b").alias("j")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(image))
    d = F.col("i") - F.col("j")
    return joint.withColumn("p", p).groupBy(image).agg(F.sum(F.col("p") / (lit(1.0) + F.abs(d))).alias("homogeneity"), F.sum(F.col("p") * d * d).alias("contrast"))


def gradient_consistency(df: DataFrame, image: str, vector: str, side: int = 8) -> DataFrame:
    """Per image: resultant length of the doubled Sobel directions where the gradient is strong."""
    cells = [[(y + dy) * side + x + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)] for y in range(1, side - 1) for x in range(1, side - 1)]
    px = plane(F.col(vector))
    at = lambda cell, k: F.get(F.col("px"), F.get(cell, F.lit(k)))

    def gradient(cell: Column) -> Column:
        gx = at(cell, 2) - at(cell, 0) + 2 * (at(cell, 5) - at(cell, 3)) + at(cell, 8) - at(cell, 6)
        gy = at(cell, 6) - at(cell, 0) + 2 * (at(cell, 7) - at(cell, 1)) + at(cell, 8) - at(cell, 2)
        return F.struct(gx.alias("gx"), gy.alias("gy"))

    turned = lambda g: F.struct(F.sqrt(g["gx"] * g["gx"] + g["gy"] * g["gy"]).alias("size"), F.atan2(g["gy"], g["gx"]).alias("angle"))
    rows = df.select(image, px.alias("px")).select(image, F.transform(F.transform(constant(cells, "array<array<int>>"), gradient), turned).alias("steps"))
    bound = rows.select(image, F.explode("steps.size").alias("size")).groupBy(image).agg((F.avg("size") + F.stddev_pop("size")).alias("bound"))
    strong = rows.join(bound, image).select(image, F.explode(F.filter("steps", lambda g: g["size"] > F.col("bound"))).alias("g")).select(image, "g.angle")
    s = strong.groupBy(image).agg(F.count("*").alias("n"), F.avg(F.cos(F.col("angle") * 2)).alias("c"), F.avg(F.sin(F.col("angle") * 2)).alias("s"))
    return s.select(image, "n", F.when(F.col("n") < 10, lit(0.0)).otherwise(clip(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")), 0.0, 1.0)).alias("consistency"))


def block_consistency(df: DataFrame, image: str, vector: str) -> DataFrame:
    """Per image: 1 less the relative deviation of its tiles' energies, in [0, 1]."""
    energy = F.aggregate(plane(F.col(vector)), lit(0.0), lambda s, x: s + x * x)
    g = df.select(image, energy.alias("e")).groupBy(image).agg(F.stddev_pop("e").alias("std"), F.avg("e").alias("mean"))
    return g.select(image, clip(lit(1.0) - ratio(F.col("std"), F.col("mean") + lit(EPS)), 0.0, 1.0).alias("consistency"))
