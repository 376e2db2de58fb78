"""Registered queries: provenance, narratives, cards, saliency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, round6
from glintframe.operators import narrative as N
from glintframe.operators import verdict as V
from glintframe.plans.evaluation import SOFT_SQL, STATE_SQL, members, r6
from glintframe.plans.registry import Registry, rounded
from glintframe.tables import SCORED_SQL, scored, table

reg = Registry()
SAID = {k: v.replace("'", "''") for k, v in N.SENTENCES.items()}

#: Buffers of all kinds, made of the pages: every fifth a bare JPEG, one with IPTC data, one with a C2PA marker, one with metadata, the page itself.
BUFFER_SQL = """b AS (SELECT page_id, page_id % 5 AS k FROM pages),
f AS (SELECT page_id, k = 2 AS has_c2pa, k = 3 AS has_exif, k = 1 AS has_iptc, k = 0 AS void FROM b)"""


def buffers(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda tag, kind, slot: tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + (1).to_bytes(4, "little") + slot
    exif = N.EXIF + b"II*\0" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + entry(0x8827, 3, b"\x64\0\0\0") + entry(0x0110, 2, b"X1\0\0")
    jpeg = bytes.fromhex(N.CONTAINERS["jpeg"])
    kinds = [jpeg + b"plain", jpeg + b"..iptc..", jpeg + b"..c2pa..", jpeg + exif, b"plain"]
    content = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", content.alias("content"))


@reg(f"""WITH {BUFFER_SQL} SELECT page_id, has_c2pa, has_exif, has_iptc, void, CASE WHEN void THEN 1e-1 ELSE 0e0 END AS penalty, has_c2pa AS bifurcated,
CASE WHEN has_c2pa THEN '{SAID["c2pa"]}' WHEN has_exif THEN '{SAID["exif"].replace("%d", "2")}' WHEN has_iptc THEN '{SAID["iptc"]}' WHEN void THEN '{SAID["void"]}' ELSE '{SAID["none"]}' END AS summary,
CASE WHEN has_exif THEN 100 END AS iso_speed, CASE WHEN has_exif THEN 'X1' END AS model FROM f""")
def provenance_summary(spark: SparkSession, d: str) -> DataFrame:
    found = N.provenance(buffers(spark, d), "content")
    return found.select("page_id", "has_c2pa", "has_exif", "has_iptc", "void", "penalty", "bifurcated", "summary", F.col("exif")["iso_speed"].cast("int").alias("iso_speed"), F.col("exif")["model"].alias("model"))


@reg("""SELECT page_id, contains(html, 'jumb') OR contains(html, 'c2pa') OR contains(html, 'cai_') OR contains(html, 'contentcredentials') OR contains(html, 'claim_generator') AS c2pa,
CASE WHEN starts_with(html, 'BM') THEN 'bmp' WHEN starts_with(html, 'RIFF') THEN 'webp' END AS container FROM pages""")
def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", N.has_marker(content, N.C2PA).alias("c2pa"), N.container(content).alias("container"))


@reg("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::INT AS bytes FROM pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("bytes"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = V.with_verdict(scored(spark, d), threshold=lit(0.37))
    return s.withColumns({"agreement": V.agreement(members(F.col("p"))), "suspicious": F.col("toxic") == 1, "verified": F.col("id") % 11 == 0})


VERDICT_SQL = f"""{SCORED_SQL}, m AS (SELECT *, 37e-2 AS t, [p, p * p, sqrt(p), (p + 1e0) / 2e0] AS members FROM scored), a AS (SELECT *, list_avg(members) AS avg4 FROM m),
v AS (SELECT *, {STATE_SQL} AS verdict_state, greatest(0e0, least(1e0, 1e0 - sqrt(list_avg(list_transform(members, lambda x: (x - avg4) ** 2))) / 5e-1)) AS agreement FROM a)"""


@reg(f"""WITH {VERDICT_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN '[PROVENANCE VERIFIED]' WHEN verdict_state = 'ai' THEN CASE WHEN agreement >= 5e-1 THEN '[DETERMINISTIC AI]' ELSE '[PROBABLE AI]' END
WHEN verdict_state = 'uncertain' THEN CASE WHEN toxic = 1 THEN '[PROBABLE AI]' ELSE '[INCONCLUSIVE]' END ELSE '[DETERMINISTIC REAL]' END AS severity,
CASE WHEN agreement < 5e-1 THEN 'Uncertain' WHEN verdict_state = 'ai' THEN 'AI Generated' WHEN verdict_state = 'authentic' THEN 'Authentic Image' ELSE 'Uncertain' END AS shown FROM v""")
def severity(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d)
    s = N.severity(F.col("verdict_state"), F.col("agreement"), F.col("suspicious"), F.col("verified"))
    return v.select("id", s.alias("severity"), V.ui_verdict(F.col("verdict_state"), F.col("agreement")).alias("shown"))


LABELS_SQL = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILY_LABELS.items()) + " END"
WHOLE = "floor({} * 1e2 + 5e-1)"
TOLD_SQL = f"""{VERDICT_SQL}, {SOFT_SQL}, q AS (SELECT v.*, ['real','diffusion','gan','other'][list_position(s.s, list_max(s.s))] AS family, list_max(s.s) AS share FROM v JOIN s ON v.id = s.id),
told AS (SELECT id, concat_ws(' ', CASE WHEN verdict_state = 'ai' THEN printf('{SAID["ai"]}', {WHOLE.format("p")}) WHEN verdict_state = 'authentic' THEN printf('{SAID["authentic"]}', {WHOLE.format("p")})
  ELSE printf('{SAID["uncertain"]}', {WHOLE.format("p")}) END,
 CASE WHEN toxic = 1 THEN '{SAID["absent"]}' WHEN id % 3 = 0 THEN '{SAID["iptc"]}' END,
 CASE WHEN id % 5 = 0 THEN 'Generator attribution: flux 70.0%, sdxl 20.0%.' WHEN {WHOLE.format("share")} / 1e2 >= 3e-1 THEN printf('{SAID["family"]}', {LABELS_SQL}, {WHOLE.format("share")}) END,
 CASE WHEN agreement < 5e-1 THEN '{SAID["disagree"]}' ELSE printf('{SAID["members"]}', CASE WHEN y = 1 THEN 'forest 90%, svm 40%' ELSE 'svm 40%, forest 10%' END) END,
 CASE WHEN id % 7 = 0 THEN printf('{SAID["flag"]}', 'odd shadows', 75e-2) END,
 printf('{SAID["signal"]}', 'spectral_slope', floor(abs(p - 5e-1) * 1e1 + 5e-1), CASE WHEN p > 5e-1 AND floor(abs(p - 5e-1) * 1e1 + 5e-1) > 0 THEN '{N.TOWARD[0]}' ELSE '{N.TOWARD[1]}' END)) AS narrative FROM q)"""


@reg(f"WITH {TOLD_SQL} SELECT id, narrative, (len(string_split(narrative, '. ')) - 1 + CASE WHEN ends_with(narrative, '.') THEN 1 ELSE 0 END)::INT AS sentences FROM told")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    """Percentages are cut to whole ones first: engines round halves differently when they print."""
    whole = lambda c: F.floor(c * lit(100.0) + lit(0.5)) / lit(100.0)
    v = verdicts(spark, d).withColumn("top", V.top_family(F.col("p")))
    strong = F.when(F.col("y") == 1, lit(0.9)).otherwise(lit(0.1))
    pull = F.floor(F.abs(F.col("p") - lit(0.5)) * lit(10.0) + lit(0.5)) * F.when(F.col("p") > 0.5, lit(1.0)).otherwise(lit(-1.0))
    text = N.narrative(
        F.col("verdict_state"), whole(F.col("p")), F.col("suspicious"), F.col("top.family"), whole(F.col("top.probability")), F.col("agreement"),
        F.create_map(F.lit("forest"), strong, F.lit("svm"), lit(0.4)), F.lit("spectral_slope"), pull, F.when(F.col("id") % 3 == 0, N.SENTENCES["iptc"]).otherwise(N.SENTENCES["none"]),
        F.when(F.col("id") % 5 == 0, F.create_map(F.lit("sdxl"), lit(0.2), F.lit("flux"), lit(0.7), F.lit("gan"), lit(0.1))),
        F.array(F.struct(F.lit("Odd Shadows").alias("label"), F.when(F.col("id") % 7 == 0, lit(0.75)).otherwise(lit(0.25)).alias("score"))),
    )
    return v.select("id", text.alias("narrative")).withColumn("sentences", N.sentence_count(F.col("narrative")))


CARD_SQL = f"""{SCORED_SQL}, c AS (SELECT id, unnest(['Spectral Slope','Spectral Flatness','Phase Entropy','Noise Kurtosis','Patch Inconsistency']) AS card,
unnest([abs(abs(p * 4) - 2) / 2, p / 10 * 8, 1 - p, abs(p * 7 - 3) / 6, p * p]) AS s FROM scored), k AS (SELECT id, card, greatest(0e0, least(1e0, s)) AS score FROM c)"""


def card_scores(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return N.cards(scored(spark, d), "id", {"slope": p * 4, "flatness": p / 10, "entropy": p, "kurtosis": p * 7 - 3, "patch": p * p})


@reg(f"WITH {CARD_SQL} SELECT id, card, {r6('score')} AS score FROM k")
def forensic_cards(spark: SparkSession, d: str) -> DataFrame:
    return rounded(card_scores(spark, d), "score")


@reg(f"""WITH {CARD_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, card) AS dn, row_number() OVER (PARTITION BY id ORDER BY score, card) AS up FROM k)
SELECT id, string_agg(card, ', ' ORDER BY dn) FILTER (dn <= 3) AS strongest, string_agg(card, ', ' ORDER BY up) FILTER (up <= 2) AS weakest,
CASE WHEN max(score) * 100 >= 85 THEN 'high' WHEN max(score) * 100 >= 65 THEN 'moderate' ELSE 'low' END AS band FROM q GROUP BY id""")
def top_signals(spark: SparkSession, d: str) -> DataFrame:
    return N.top_signals(card_scores(spark, d), "id")


@reg(f"""WITH t AS (SELECT user_id AS image, event_id AS tile, value / 5e1 AS slope, value / 1e3 AS flatness FROM events),
w AS (SELECT *, abs(slope - 2) AS dev, avg(slope) OVER (PARTITION BY image) AS m, stddev_pop(slope) OVER (PARTITION BY image) AS s, stddev_pop(flatness) OVER (PARTITION BY image) AS f FROM t),
z AS (SELECT *, CASE WHEN s > 0 THEN abs(slope - m) / s ELSE 0 END AS z FROM w)
SELECT image, tile, {r6("dev / max(dev) OVER (PARTITION BY image)")} AS saliency, {r6("z / max(z) OVER (PARTITION BY image)")} AS inconsistency, {r6("greatest(0e0, least(1e0, s / abs(m) + f))")} AS score FROM z""")
def saliency_norm(spark: SparkSession, d: str) -> DataFrame:
    tiles = table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("tile"), (F.col("value") / lit(50.0)).alias("slope"), (F.col("value") / lit(1000.0)).alias("flatness"))
    return rounded(N.saliency(tiles), "saliency", "inconsistency", "score")


@reg(f"""WITH {SCORED_SQL}, a AS (SELECT id, p, [[68,1,84],[72,40,120],[62,74,137],[49,104,142],[38,130,142],[31,158,137],[53,183,121],[109,205,89],[253,231,37]] AS lut, least(floor(p * 8), 7)::INT AS i FROM scored)
SELECT id, floor(lut[i+1][1] + (lut[i+2][1] - lut[i+1][1]) * (p * 8 - i) + 5e-1)::INT AS r, floor(lut[i+1][2] + (lut[i+2][2] - lut[i+1][2]) * (p * 8 - i) + 5e-1)::INT AS g, floor(lut[i+1][3] + (lut[i+2][3] - lut[i+1][3]) * (p * 8 - i) + 5e-1)::INT AS b FROM a""")
def viridis_lut(spark: SparkSession, d: str) -> DataFrame:
    rgb = N.viridis(F.col("p"))
    return scored(spark, d).select("id", rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"))


@reg(f"WITH {SCORED_SQL} SELECT id, p BETWEEN 3e-1 AND 7e-1 AS arbiter, (p >= 5e-1 OR p * p >= 5e-1) AS flagged, greatest(2, least(8, floor(least(size, 480) / 16)))::INT AS tiles FROM scored")
def arbiter_trigger(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return scored(spark, d).select(
        "id", N.arbiter_needed(p).alias("arbiter"), N.suspicious(F.array(p, p * p)).alias("flagged"), N.tiles_per_side(F.lit(8), F.col("size"), F.lit(480)).alias("tiles")
    )


BAND_SQL = """a AS (SELECT vec_id, [abs(x)::DOUBLE for x in embedding[1:9]] AS e, [abs(x)::DOUBLE / (1 + abs(x)::DOUBLE) for x in embedding[10:18]] AS h FROM embeddings),
u AS (SELECT vec_id, unnest(range(9)) AS i, unnest(e) AS energy, unnest(h) AS entropy FROM a),
bands AS (SELECT vec_id, (i // 3)::INT AS level, ['LH', 'HL', 'HH'][i % 3 + 1] AS band, energy, entropy FROM u)"""


def band_rows(spark: SparkSession, d: str) -> DataFrame:
    size = lambda x: F.abs(x.cast("double"))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 9), size).alias("energies"), F.transform(F.slice("embedding", 10, 9), lambda x: size(x) / (size(x) + 1)).alias("entropies")
    )
    return N.bands(rows, "vec_id", "energies", "entropies")


@reg(f"WITH {BAND_SQL} SELECT vec_id, level, band, {r6('energy')} AS energy, {r6('entropy')} AS entropy FROM bands")
def wavelet_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(band_rows(spark, d), "energy", "entropy")


@reg(f"""WITH {BAND_SQL} SELECT vec_id, level, {r6('sum(energy)')} AS energy, {r6('avg(entropy)')} AS entropy, {r6('greatest(0e0, least(1e0, avg(1 - entropy)))')} AS anomaly, level = 0 AS selected
FROM bands GROUP BY vec_id, level""")
def wavelet_levels(spark: SparkSession, d: str) -> DataFrame:
    """Flat arrays of bands as levels of three."""
    return rounded(N.levels(band_rows(spark, d), "vec_id"), "energy", "entropy", "anomaly")


@reg(f"""WITH u AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS bin, unnest(embedding)::DOUBLE AS magnitude, len(embedding) AS n FROM embeddings)
SELECT vec_id, bin, floor(bin / (n - 1) * 22050 + 5e-1)::BIGINT AS hz, {r6('magnitude')} AS magnitude, {r6('magnitude * magnitude')} AS energy FROM u""")
def spectrum_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("profile"))
    return rounded(N.spectrum_points(rows, "vec_id", "profile"), "magnitude", "energy")


SERIES_SQL = """u AS (SELECT vec_id, 'radial' AS kind, unnest(range(24))::INT AS place, unnest(embedding[1:24])::DOUBLE AS value FROM embeddings
UNION ALL SELECT vec_id, 'azimuthal', unnest(range(18))::INT, unnest(embedding[25:42])::DOUBLE FROM embeddings)"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    part = lambda start, n: F.transform(F.slice("embedding", start, n), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", part(1, 24).alias("radial"), part(25, 18).alias("azimuthal"))


@reg(f"WITH {SERIES_SQL} SELECT vec_id, kind, place, {r6('value')} AS value, {r6('avg(value) OVER (PARTITION BY vec_id)')} AS mean_magnitude, {r6('avg(value * value) OVER (PARTITION BY vec_id)')} AS mean_energy FROM u")
def explorer_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.explorer_series(profiles(spark, d), "vec_id", "radial", "azimuthal"), "value", "mean_magnitude", "mean_energy")


@reg(f"WITH {SERIES_SQL} SELECT vec_id, kind, place, {r6('value')} AS value FROM u WHERE kind = 'radial' AND place = 21")
def explorer_default(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.default_point(profiles(spark, d), "vec_id", "radial", "azimuthal"), "value")


@reg(f"""WITH {SCORED_SQL}, {SOFT_SQL}, u AS (SELECT id, unnest(['real','diffusion','gan','other']) AS family, unnest(s) AS probability FROM s)
SELECT id, family, {r6('probability')} AS probability, row_number() OVER (PARTITION BY id ORDER BY {r6('probability')} DESC, family)::INT AS place,
CASE family {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.DISPLAY_LABELS.items())} END AS name FROM u""")
def family_list(spark: SparkSession, d: str) -> DataFrame:
    shares = V.attribution(F.col("p"))
    rows = scored(spark, d).select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), round6(shares[i]).alias("probability")) for i, f in enumerate(V.FAMILIES)])))
    return N.family_list(rows, "id")


@reg(f"WITH {CARD_SQL}, c2 AS (SELECT id, card, {r6('score')} AS score FROM k) SELECT id, card, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, card)::INT AS place FROM c2")
def parameter_list(spark: SparkSession, d: str) -> DataFrame:
    return N.sorted_list(rounded(card_scores(spark, d), "score"), "id", "score", "card")


@reg(f"""WITH {CARD_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, card) AS dn, row_number() OVER (PARTITION BY id ORDER BY score, card) AS up FROM k),
t AS (SELECT id, string_agg(card, ', ' ORDER BY dn) FILTER (dn <= 3) AS strongest, string_agg(card, ', ' ORDER BY up) FILTER (up <= 2) AS weakest FROM q GROUP BY id)
SELECT t.id, printf('- The detector reports %s (%.1f%%) for %s content.', CASE WHEN c >= 85 THEN 'high confidence' WHEN c >= 65 THEN 'moderate confidence' ELSE 'low confidence' END, c, CASE WHEN p >= 5e-1 THEN 'AI-generated' ELSE 'authentic' END)
  || chr(10) || printf('- The strongest signals are %s, which align with %s.', strongest, 'GAN') || chr(10)
  || printf('- Lower-impact signals (%s) suggest reviewing source quality (compression/resizing) before final action.', weakest) AS insight
FROM t JOIN (SELECT id, p, floor(p * 1e2 + 5e-1) AS c FROM scored) s ON t.id = s.id""")
def local_insight(spark: SparkSession, d: str) -> DataFrame:
    top = N.top_signals(card_scores(spark, d), "id").join(scored(spark, d).select("id", "p"), "id")
    whole = F.floor(F.col("p") * lit(100.0) + lit(0.5)).cast("double")
    return top.select("id", N.insight(whole, F.col("p") >= 0.5, F.lit("GAN"), F.col("strongest"), F.col("weakest")).alias("insight"))


PREDICTION_SQL = f"""{SCORED_SQL}, {SOFT_SQL}, r AS (SELECT scored.*, p >= 5e-1 AS is_ai, ['real','diffusion','gan','other'][list_position(s.s, list_max(s.s))] AS top FROM scored JOIN s ON scored.id = s.id),
p AS (SELECT id, CASE WHEN NOT is_ai THEN 'Real' WHEN top = 'diffusion' THEN 'Diffusion' WHEN top = 'gan' THEN 'GAN' ELSE 'Unknown' END AS family,
  CASE WHEN NOT is_ai THEN 'Real Camera' WHEN top = 'diffusion' THEN 'Diffusion Model' WHEN top = 'gan' THEN 'GAN' ELSE 'Unknown Generator' END AS model, p AS confidence, p * p AS cdcs,
  least(1e0, p * 2) AS checkerboard, CASE WHEN 1 - p * 15e-1 > 0 THEN 1 - p * p ELSE 5e-1 END AS calibration FROM r)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    rows = scored(spark, d).withColumn("top", V.top_family(p))
    made = N.prediction(p >= 0.5, F.col("top.family"), p * 100, p * p, p * 20, p * 1.5)
    return rows.select("id", made.alias("made")).select("id", "made.*")


@reg(f"WITH {PREDICTION_SQL} SELECT id, family, model, {r6('confidence')} AS confidence, {r6('cdcs')} AS cdcs, {r6('checkerboard')} AS checkerboard, {r6('calibration')} AS calibration FROM p")
def stage_prediction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions(spark, d), "confidence", "cdcs", "checkerboard", "calibration")


@reg(f"""WITH {PREDICTION_SQL} SELECT id, family, CASE family WHEN 'Diffusion' THEN 4 WHEN 'GAN' THEN 3 ELSE 0 END AS n_models,
CASE family WHEN 'Diffusion' THEN 'Stable Diffusion XL' WHEN 'GAN' THEN 'StyleGAN3' ELSE '' END AS selected, 85 AS confidence_default FROM p""")
def label_form(spark: SparkSession, d: str) -> DataFrame:
    rows = N.label_form(predictions(spark, d).select("id", "family"), N.model_choices(spark))
    return rows.select("id", "family", F.size("models").alias("n_models"), "selected", "confidence_default")


@reg(f"WITH {SCORED_SQL} SELECT '2.0.0' AS version, 'full' AS training_mode, {r6('avg((y = (p >= 5e-1)::INT)::INT)')} AS accuracy, count(*) AS n_training_samples FROM scored")
def model_info(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("int")
    report = scored(spark, d).agg(round6(F.avg(hit)).alias("accuracy"), F.count("*").alias("n_training_samples"), F.lit(None).cast("string").alias("training_mode"))
    return N.model_info(report, {"version": "2.0.0", "training_mode": "full", "accuracy": 0.0, "n_training_samples": 0})


@reg("SELECT (i - 1)::INT AS place, i / 8e0 AS x, (i / 8e0) * (i / 8e0) AS y FROM (SELECT unnest(range(1, 9)) AS i)")
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    xs = [i / 8 for i in range(1, 9)]
    return N.curve_points(spark.createDataFrame([(xs, [x * x for x in xs])], "fpr array<double>, tpr array<double>"), "fpr", "tpr")


@reg("""WITH c AS (SELECT DISTINCT label, ['software-' || label, 'camera-x', 'other'] AS patterns, CASE label % 4 WHEN 0 THEN 'Diffusion' WHEN 1 THEN 'GAN' WHEN 2 THEN 'Transformer' ELSE 'Real' END AS family FROM embeddings)
SELECT label, family, ['software-' || label] AS software, ['camera-x'] AS camera, []::VARCHAR[] AS processing,
CASE family WHEN 'Diffusion' THEN ['diffusion', 'stable', 'latent'] WHEN 'GAN' THEN ['gan', 'stylegan', 'generator'] WHEN 'Transformer' THEN ['transformer', 'dalle', 'attention'] ELSE [] END AS style FROM c""")
def provenance_profile(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("label") % 4
    family = F.when(n == 0, "Diffusion").when(n == 1, "GAN").when(n == 2, "Transformer").otherwise("Real")
    rows = table(spark, d, "embeddings").select("label").distinct().select("label", F.array(F.concat(F.lit("software-"), "label"), F.lit("camera-x"), F.lit("other")).alias("patterns"), family.alias("family"))
    return N.provenance_profile(rows, "patterns", "family").drop("patterns")
