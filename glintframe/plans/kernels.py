"""Registered queries: embeddings as 8 x 8 tiles, labels as images made of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, round6
from glintframe.operators import kernels as K
from glintframe.operators import verdict as V
from glintframe.plans.evaluation import SOFT_SQL, STATE_SQL, r6
from glintframe.plans.registry import Registry, rounded
from glintframe.tables import table

reg = Registry()


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def unit(vector: str = "embedding"):
    """Components of a unit vector brought into [0, 1]."""
    return F.transform(vector, lambda x: x.cast("double") * lit(2.0) + lit(0.5))


PX = "px AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings)"
DCT_SQL = f"""{PX}, n8 AS (SELECT unnest(range(8)) AS u), w AS (SELECT a.u AS u, b.u AS x, (CASE WHEN a.u = 0 THEN sqrt(1/8e0) ELSE 5e-1 END) * cos((2 * b.u + 1) * a.u * pi() / 16) AS w FROM n8 a, n8 b),
rw AS (SELECT vec_id, label, i // 8 AS y, w.u AS cv, sum(v * w) AS t FROM px JOIN w ON px.i % 8 = w.x GROUP BY ALL),
cf AS (SELECT vec_id, label, w.u AS cu, cv, sum(t * w) AS c FROM rw JOIN w ON rw.y = w.x GROUP BY ALL),
dd AS (SELECT label, count(DISTINCT vec_id) AS n, sum(c * c) FILTER (cu*cu+cv*cv BETWEEN 1 AND 4) AS lo, sum(c * c) FILTER (cu*cu+cv*cv > 4 AND cu*cu+cv*cv <= 16) AS mi, sum(c * c) FILTER (cu*cu+cv*cv > 16) AS hi,
 sum(c * c) FILTER ((cu IN (0,7) OR cv IN (0,7)) AND cu + cv > 0) AS ed, sum(c * c) AS al, sum(c * c) FILTER (cu + cv = 0) AS dc, stddev_pop(abs(c)) FILTER (cu > 0 AND cv > 0) AS sd, kurtosis_pop(abs(c)) FILTER (cu > 0 AND cv > 0) AS ku FROM cf GROUP BY label)"""


@reg(f"""WITH {DCT_SQL} SELECT label, n, {r6("mi / (lo + mi + hi)")} AS mid_ratio, {r6("hi / (lo + mi + hi)")} AS high_ratio, {r6("ed / al")} AS boundary, {r6("dc / n")} AS avg_dc, {r6("lo / hi")} AS low_high, {r6("sd")} AS coeff_std, {r6("ku")} AS coeff_kurtosis FROM dd""")
def dct_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.dct_statistics(tiles(spark, d), "label", "embedding"), "mid_ratio", "high_ratio", "boundary", "avg_dc", "low_high", "coeff_std", "coeff_kurtosis")


FLAG_SQL = f"""{DCT_SQL}, e AS (SELECT vec_id AS id, sum(c * c) FILTER (cu*cu+cv*cv > 16) / sum(c * c) FILTER (cu + cv > 0) AS share FROM cf GROUP BY vec_id),
scored AS (SELECT id, 1e0 / (1e0 + exp(-(share - 6e-1) * 2e1)) AS p, 37e-2 AS t FROM e)"""


@reg(f"""WITH {FLAG_SQL}, {SOFT_SQL}, v AS (SELECT scored.id, p, {STATE_SQL} AS verdict_state, ['real','diffusion','gan','other'][list_position(s.s, list_max(s.s))] AS family FROM scored JOIN s ON scored.id = s.id)
SELECT verdict_state, family, count(*) AS n, {r6("avg(p)")} AS mean_p FROM v GROUP BY ALL""")
def dct_verdict_mix(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: tiles to block transforms, band energies, score, verdict, family, mix."""
    energy = F.transform(K.dct(F.col("embedding")), lambda c: c * c)
    far = [u * u + v * v > 16 for u in range(8) for v in range(8)]
    ac = [i > 0 for i in range(64)]
    share = tiles(spark, d).select(F.col("vec_id").alias("id"), energy.alias("e")).select("id", (K.masked_sum(F.col("e"), far) / K.masked_sum(F.col("e"), ac)).alias("share"))
    p = lit(1.0) / (lit(1.0) + F.exp(-(F.col("share") - lit(0.6)) * lit(20.0)))
    states = V.with_verdict(share.select("id", p.alias("p")), threshold=lit(0.37)).withColumn("family", V.top_family(F.col("p"))["family"])
    return rounded(states.groupBy("verdict_state", "family").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p")), "mean_p")


FREQ = f"""{PX}, mn AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), fq AS (SELECT a.u AS u, b.w AS w FROM (SELECT unnest(range(8)) AS u) a, (SELECT unnest(range(5)) AS w) b),
ft AS (SELECT px.vec_id, u, w, floor(sum((v - m) * cos(2 * pi() * (u * (i // 8) + w * (i % 8)) / 8)) * 1e9 + 5e-1) / 1e9 AS re, floor(sum(-(v - m) * sin(2 * pi() * (u * (i // 8) + w * (i % 8)) / 8)) * 1e9 + 5e-1) / 1e9 AS im FROM px JOIN mn ON px.vec_id = mn.vec_id, fq GROUP BY ALL),
mg AS (SELECT vec_id, u, w, sqrt(re*re+im*im) AS m, atan2(im, re) AS ph, sqrt(u*u+w*w) AS r FROM ft)"""
BINS = 4


@reg(f"""WITH {FREQ}, ed AS (SELECT unnest(range(1, 5)) AS k), b AS (SELECT mg.*, least(3, (SELECT count(*) FROM ed WHERE pow(1e1, k * log10(sqrt(65) + 1) / 4) - 1 <= mg.r)) AS bin FROM mg),
a AS (SELECT vec_id, bin, avg(m) AS a FROM b GROUP BY ALL), s AS (SELECT vec_id, bin, a / sum(a) OVER (PARTITION BY vec_id) AS p FROM a)
SELECT vec_id, bin::INT AS bin, {r6("p")} AS share FROM s""")
def dft_radial(spark: SparkSession, d: str) -> DataFrame:
    s = K.with_spectrum(tiles(spark, d).select("vec_id", "embedding"), "embedding")
    return s.select("vec_id", F.posexplode(K.radial_profile(F.col("magnitude"), 8, BINS)).alias("bin", "share")).withColumn("share", round6(F.col("share")))


@reg(f"""WITH {FREQ}, b AS (SELECT vec_id, m, floor((atan2(u, w) + pi()) / (2 * pi()) * 12)::INT % 12 AS s FROM mg WHERE r > 1e-1 * sqrt(65) AND r < 9e-1 * sqrt(65))
SELECT t.vec_id, k.s::INT AS sector, {r6("coalesce(avg(b.m), 0)")} AS magnitude FROM (SELECT DISTINCT vec_id FROM px) t CROSS JOIN (SELECT unnest(range(12)) AS s) k LEFT JOIN b ON b.vec_id = t.vec_id AND b.s = k.s GROUP BY ALL""")
def dft_azimuthal(spark: SparkSession, d: str) -> DataFrame:
    s = K.with_spectrum(tiles(spark, d).select("vec_id", "embedding"), "embedding")
    means = K.masks_mean(F.col("magnitude"), K.azimuthal_bins(8, 12), 12)
    return s.select("vec_id", F.posexplode(means).alias("sector", "magnitude")).withColumn("magnitude", round6(F.col("magnitude")))


@reg(f"""WITH {FREQ}, h AS (SELECT vec_id, least(floor((ph + pi()) / (2 * pi()) * 32), 31) AS b, count(*) AS n FROM mg WHERE r > 2 GROUP BY ALL), p AS (SELECT vec_id, n / sum(n) OVER (PARTITION BY vec_id) AS p FROM h),
e AS (SELECT vec_id, -sum(p * log2(p)) / 5 AS e FROM p GROUP BY 1),
s AS (SELECT vec_id, exp(avg(ln(m*m + 1e-12)) FILTER (r > 2)) / (avg(m*m) FILTER (r > 2) + 1e-12) AS flat, sum(m*m) FILTER (u = 0 AND w = 0) / sum(m*m) AS dc, sum(m) FILTER (u < 4 AND w < 2) AS q1, sum(m) FILTER (u >= 4 AND w >= 2) AS q4 FROM mg GROUP BY 1)
SELECT s.vec_id, {r6("flat")} AS flatness, {r6("e")} AS phase_entropy, {r6("dc")} AS dc_ratio, {r6("(q1 - q4) / (q1 + q4 + 1e-12)")} AS quadrant_asymmetry FROM s JOIN e ON s.vec_id = e.vec_id""")
def dft_scalars(spark: SparkSession, d: str) -> DataFrame:
    s = K.spectral_scalars(K.with_spectrum(tiles(spark, d).select("vec_id", "embedding"), "embedding"))
    return rounded(s.select("vec_id", "flatness", "phase_entropy", "dc_ratio", "quadrant_asymmetry"), "flatness", "phase_entropy", "dc_ratio", "quadrant_asymmetry")


@reg(f"""WITH {FREQ}, ed AS (SELECT unnest(range(1, 25)) AS k), b AS (SELECT mg.*, least(23, (SELECT count(*) FROM ed WHERE pow(1e1, k * log10(sqrt(65) + 1) / 24) - 1 <= mg.r)) AS bin FROM mg),
a AS (SELECT vec_id, bin, avg(m) AS m, avg(r) AS r FROM b GROUP BY ALL)
SELECT vec_id, {r6('regr_slope(ln(m + 1e-12), ln(r))')} AS slope, {r6('regr_intercept(ln(m + 1e-12), ln(r))')} AS intercept FROM a WHERE r > 2 AND r < 85e-2 * (SELECT max(r) FROM a) GROUP BY vec_id""")
def dft_slope(spark: SparkSession, d: str) -> DataFrame:
    s = K.with_spectrum(tiles(spark, d).select("vec_id", "embedding"), "embedding")
    return rounded(K.slope_fit(s, "vec_id"), "slope", "intercept")


@reg(f"""WITH {PX}, e AS (SELECT label, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), c AS (SELECT px.label, least(floor((v - lo) / (hi - lo) * 32), 31) AS b, count(*) AS n FROM px JOIN e ON px.label = e.label GROUP BY ALL),
p AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM c) SELECT label, {r6("-sum(p * log2(p)) / 5")} AS entropy FROM p GROUP BY 1""")
def hist_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.histogram_entropy(tiles(spark, d), "label", "embedding", 32), "entropy")


@reg(f"SELECT label, {r6('corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE)')} AS first, {r6('corr(embedding[1]::DOUBLE, embedding[64]::DOUBLE)')} AS far, 0e0 AS constant FROM embeddings GROUP BY label")
def pearson_guard(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    g = tiles(spark, d).groupBy("label").agg(K.guarded_corr(e(0), e(1)).alias("first"), K.guarded_corr(e(0), e(63)).alias("far"), K.guarded_corr(e(0), lit(1.0) + e(1) * 0).alias("constant"))
    return rounded(g, "first", "far", "constant")


GLCM_SQL = f"""{PX}, q AS (SELECT vec_id, label, i // 8 AS y, i % 8 AS x, greatest(0, least(15, floor((v * 2e0 + 5e-1) * 16)))::INT AS q FROM px), st(s, dy, dx) AS (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,2),(5,2,2),(6,2,0),(7,2,-2)),
pr AS (SELECT a.label, s, a.q AS i, b.q AS j FROM q a, st JOIN q b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx), sy AS (SELECT * FROM pr UNION ALL SELECT label, s, j, i FROM pr),
ct AS (SELECT label, s, i, j, count(*) AS n FROM sy GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label, s) AS p FROM ct),
g AS (SELECT label, s, sum(p*(i-j)*(i-j)) AS c, sum(p*abs(i-j)) AS d, sum(p/(1+(i-j)*(i-j))) AS h, sqrt(sum(p*p)) AS e, sum(p*i) AS m, sum(p*i*i) AS m2, sum(p*i*j) AS ij FROM p GROUP BY ALL)"""


@reg(f"WITH {GLCM_SQL} SELECT label, {r6('avg(c)')} AS contrast, {r6('avg(d)')} AS dissimilarity, {r6('avg(h)')} AS homogeneity, {r6('avg(e)')} AS energy, {r6('avg((ij - m*m) / (m2 - m*m))')} AS correlation FROM g GROUP BY label")
def glcm_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.glcm(tiles(spark, d), "label", unit(), levels=16), "contrast", "dissimilarity", "homogeneity", "energy", "correlation")


LBP_SQL = f"""{PX}, q AS (SELECT vec_id, label, i // 8 AS y, i % 8 AS x, floor(greatest(0e0, least(1e0, v * 2e0 + 5e-1)) * 255)::INT AS q FROM px), o(k, dy, dx) AS (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,1),(4,1,1),(5,1,0),(6,1,-1),(7,0,-1)),
cd AS (SELECT a.vec_id, a.label, a.y, a.x, sum(CASE WHEN b.q >= a.q THEN (1 << k) ELSE 0 END)::INT AS code FROM q a, o JOIN q b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL),
h AS (SELECT label, code, count(*) AS n FROM cd GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM h)"""
UNIFORM = ",".join(str(c) for c in range(256) if K.uniform_code(c))


@reg(f"WITH {LBP_SQL} SELECT label, {r6(f'sum(CASE WHEN code IN ({UNIFORM}) THEN p ELSE 0 END)')} AS uniformity, {r6('-sum(p * log2(p)) / 8')} AS entropy, {r6('sum(p * code * code) - sum(p * code) * sum(p * code)')} AS variance FROM p GROUP BY label")
def lbp_hist(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.lbp(tiles(spark, d), "label", unit()), "uniformity", "entropy", "variance")


@reg(f"""WITH {PX}, t AS (SELECT vec_id, label, ln(1e0 + avg(abs(v)) FILTER (i // 8 < 4 AND i % 8 < 4)) AS a, ln(1e0 + avg(abs(v)) FILTER (i // 8 >= 4 AND i % 8 >= 4)) AS b FROM px GROUP BY ALL),
e AS (SELECT label, min(a) AS al, max(a) + 1e-12 AS ah, min(b) AS bl, max(b) + 1e-12 AS bh FROM t GROUP BY 1),
j AS (SELECT t.label, least(floor((a - al) / (ah - al) * 15), 15) AS i, least(floor((b - bl) / (bh - bl) * 15), 15) AS j, count(*) AS n FROM t JOIN e ON t.label = e.label GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM j)
SELECT label, {r6("sum(p / (1 + abs(i - j)))")} AS homogeneity, {r6("sum(p * (i - j) * (i - j))")} AS contrast FROM p GROUP BY label""")
def block_cooc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.block_cooccurrence(tiles(spark, d), "label", "embedding"), "homogeneity", "contrast")


JPEG_SQL = f"""{DCT_SQL}, ac AS (SELECT label, c FROM cf WHERE cu > 0 AND cv > 0), e AS (SELECT label, min(c) AS lo, max(c) AS hi, avg((abs(c) < 5e-1)::INT) AS z, sum(c*c) AS a FROM ac GROUP BY 1),
ct AS (SELECT ac.label, least(floor((c - lo) / (hi - lo) * 64), 63)::INT AS b, count(*) AS n FROM ac JOIN e ON ac.label = e.label GROUP BY ALL),
h AS (SELECT e.label, k.b, coalesce(ct.n, 0) + 1e-12 AS h, e.lo + (e.hi - e.lo) * (k.b + 5e-1) / 64 AS x FROM e CROSS JOIN (SELECT unnest(range(64))::INT AS b) k LEFT JOIN ct ON ct.label = e.label AND ct.b = k.b),
s AS (SELECT label, sum(h) AS s, sum(h * x) / sum(h) AS m, avg(h) AS a, arg_max(b, h) AS pk FROM h GROUP BY 1),
mo AS (SELECT h.label, sum(h / s * (x - m) ** 2) AS v, sum(h / s * (x - m) ** 4) AS f, sum(h) FILTER (b BETWEEN pk - 3 AND pk + 3) / max(s) AS mm FROM h JOIN s ON h.label = s.label GROUP BY 1),
lg AS (SELECT a.label, k.k, sum((a.h - s.a) * (b.h - s.a)) AS c FROM h a JOIN s ON a.label = s.label, (SELECT unnest([0,2,3,4,5,6,7,8,9,10,11]) AS k) k JOIN h b ON b.label = a.label AND b.b = a.b + k.k GROUP BY ALL),
pe AS (SELECT label, max(c) FILTER (k > 0) / max(c) FILTER (k = 0) AS p FROM lg GROUP BY 1)"""


@reg(f"""WITH {JPEG_SQL} SELECT e.label, {r6("greatest(0e0, least(1e2, 4e1 + (e.a / dd.al - 1e-1) * 12e1))")} AS quality, {r6("f / (v * v + 1e-12)")} AS kurtosis, {r6("pe.p")} AS periodicity, {r6("z")} AS zero_ratio, {r6("mm")} AS mode_mass
FROM e JOIN dd ON e.label = dd.label JOIN mo ON mo.label = e.label JOIN pe ON pe.label = e.label""")
def jpeg_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.jpeg_history(tiles(spark, d), "label", "embedding"), "quality", "kurtosis", "periodicity", "zero_ratio", "mode_mass")


@reg(f"""WITH {PX}, g AS (SELECT a.vec_id, a.label, a.i, sum(CASE b.i - a.i WHEN -7 THEN b.v WHEN 1 THEN 2*b.v WHEN 9 THEN b.v WHEN -9 THEN -b.v WHEN -1 THEN -2*b.v WHEN 7 THEN -b.v ELSE 0 END) AS gx,
 sum(CASE b.i - a.i WHEN 7 THEN b.v WHEN 8 THEN 2*b.v WHEN 9 THEN b.v WHEN -9 THEN -b.v WHEN -8 THEN -2*b.v WHEN -7 THEN -b.v ELSE 0 END) AS gy FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(b.i // 8 - a.i // 8) <= 1 AND abs(b.i % 8 - a.i % 8) <= 1
 WHERE a.i // 8 BETWEEN 1 AND 6 AND a.i % 8 BETWEEN 1 AND 6 GROUP BY ALL), m AS (SELECT label, sqrt(gx*gx+gy*gy) AS s, atan2(gy, gx) AS a FROM g), b AS (SELECT label, avg(s) + stddev_pop(s) AS b FROM m GROUP BY 1)
SELECT m.label, count(*) AS n, {r6("sqrt(avg(cos(2*a)) ** 2 + avg(sin(2*a)) ** 2)")} AS consistency FROM m JOIN b ON m.label = b.label WHERE s > b GROUP BY m.label""")
def gradient_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.gradient_consistency(tiles(spark, d), "label", "embedding"), "consistency")


@reg(f"WITH {PX}, e AS (SELECT vec_id, label, sum(v * v) AS e FROM px GROUP BY ALL) SELECT label, {r6('greatest(0e0, 1e0 - stddev_pop(e) / (avg(e) + 1e-12))')} AS consistency FROM e GROUP BY label")
def block_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.block_consistency(tiles(spark, d), "label", "embedding"), "consistency")
