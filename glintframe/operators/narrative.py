"""Provenance of byte buffers, severity, narratives and report cards."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from glintframe.functions.numeric import clip, lit

#: What marks content credentials and IPTC data.
C2PA = (b"jumb", b"c2pa", b"cai_", b"contentcredentials", b"claim_generator")
IPTC = (b"Photoshop 3.0", b"iptc", b"XMLPacket")
EXIF = b"Exif\x00\x00"
#: The metadata tags that are read.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "datetime", 0x8827: "iso_speed", 0x920A: "focal_length", 0x829A: "exposure_time"}
#: First bytes of image containers, in hexadecimal.
CONTAINERS = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "bmp": "424D", "webp": "52494646"}
VOID_PENALTY = 0.10
SEVERITIES = ("[PROVENANCE VERIFIED]", "[DETERMINISTIC AI]", "[PROBABLE AI]", "[DETERMINISTIC REAL]", "[INCONCLUSIVE]")


def has_marker(content: Column, markers: tuple[bytes, ...]) -> Column:
    """Whether any marker occurs; compared as bytes, case by case."""
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(content, F.lit(marker))
    return found


def container(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, magic in reversed(CONTAINERS.items()):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def _tags(content: bytes | None) -> dict[str, str]:
    """The tags of the first metadata directory; what doesn't fit an entry's four bytes is given as these bytes in hexadecimal."""
    content = content or b""
    base = content.find(EXIF) + len(EXIF)
    order = {b"II": "<", b"MM": ">"}.get(content[base : base + 2]) if base >= len(EXIF) else None
    if order is None or len(content) < base + 8:
        return {}
    magic, first = struct.unpack(order + "HI", content[base + 2 : base + 8])
    entries = content[base + first :]
    if magic != 42 or len(entries) < 2:
        return {}
    found = {}
    for at in range(2, 2 + 12 * struct.unpack(order + "H", entries[:2])[0], 12):
        if len(entries) < at + 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entries[at : at + 8])
        slot = entries[at + 8 : at + 12]
        if tag in EXIF_TAGS:
            if kind == 2 and count <= 4:
                value = slot.split(b"\0", 1)[0].decode("utf-8", "replace")
            elif kind in (3, 4) and count == 1:
                value = str(struct.unpack(order + "HI"[kind - 3], slot[: 2 * kind - 4])[0])
            else:
                value = slot.hex()
            found[EXIF_TAGS[tag]] = value
    return found


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def exif_tags(content: pd.Series) -> pd.Series:
    return content.map(_tags)


def provenance(df: DataFrame, content: str, c2pa: tuple[bytes, ...] = C2PA, iptc: tuple[bytes, ...] = IPTC) -> DataFrame:
    """Adds exif (tags), has_c2pa, has_exif, has_iptc, void, penalty (reported only), bifurcated and summary.

    Only contents that hold the metadata's header go to Python.
    """
    b, said = F.col(content), SENTENCES
    tags = F.when(has_marker(b, (EXIF,)), exif_tags(F.when(has_marker(b, (EXIF,)), b))).otherwise(F.create_map().cast("map<string,string>"))
    df = df.withColumn("exif", tags)
    df = df.withColumns({"has_c2pa": has_marker(b, c2pa), "has_exif": F.size("exif") > 0, "has_iptc": has_marker(b, iptc)})
    void = container(b).isNotNull() & ~(F.col("has_c2pa") | F.col("has_exif") | F.col("has_iptc"))
    summary = (
        F.when(F.col("has_c2pa"), said["c2pa"]).when(F.col("has_exif"), F.format_string(said["exif"], F.size("exif")))
        .when(F.col("has_iptc"), said["iptc"]).when(void, said["void"]).otherwise(said["none"])
    )
    penalty = F.when(void, lit(VOID_PENALTY)).otherwise(lit(0.0))
    return df.withColumns({"void": void, "penalty": penalty, "bifurcated": F.col("has_c2pa"), "summary": summary})


def severity(state: Column, agreement: Column, suspicious: Column, verified: Column) -> Column:
    proven, ai, maybe, real, open_ = SEVERITIES
    return (
        F.when(verified, proven)
        .when(state == "ai", F.when(agreement >= 0.5, ai).otherwise(maybe))
        .when(state == "uncertain", F.when(suspicious, maybe).otherwise(open_))
        .when(state == "authentic", real)
        .otherwise(open_)
    )


#: The sentences of provenance summaries and narratives.
SENTENCES = {
    "c2pa": "C2PA / Content-Credentials manifest detected — strong attestation signal.",
    "exif": "EXIF metadata detected (%d tags).",
    "iptc": "IPTC metadata detected.",
    "void": "Provenance Void — metadata stripped (common adversarial/social re-upload).",
    "none": "No metadata detected.",
    "ai": "High confidence of synthetic generation (%.1f%% confidence).",
    "authentic": "Strong indication this is an authentic camera image (%.1f%% confidence in real).",
    "uncertain": "Verdict is inconclusive (%.1f%% fake probability).",
    "absent": "Cryptographic provenance is absent (Provenance Void) — metadata was stripped, a common adversarial or social re-upload tactic.",
    "generators": "Generator attribution: %s.",
    "family": "Artifact signature is most consistent with %s (%.1f%%).",
    "disagree": "Ensemble members disagree substantially, so the hard verdict is downgraded.",
    "members": "Ensemble agreement is high; strongest members: %s.",
    "flag": "Semantic arbitration flagged: %s (severity %.2f).",
    "signal": "Strongest single signal is %s (%.2f), %s.",
}
#: Fixed values.
FAMILY_LABELS = {"real": "real camera", "diffusion": "latent diffusion", "gan": "GAN", "other": "an unknown/other generator"}
TOWARD = ("pushing toward fake", "pushing toward real")


def strongest(shares: Column, n: int, form: str) -> Column:
    """The ``n`` greatest entries of a map, printed and joined; equal ones by name."""
    ordered = F.slice(F.array_sort(F.transform(F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("name")))), 1, n)
    return F.array_join(F.transform(ordered, lambda s: F.format_string(form, s["name"], s["order"] * -100)), ", ")


def labelled(value: Column, labels: dict[str, str]) -> Column:
    out = value
    for name, label in labels.items():
        out = F.when(value == name, label).otherwise(out)
    return out


def narrative(
    state: Column, p: Column, void: Column, family: Column, family_share: Column, agreement: Column, members: Column, feature: Column, contribution: Column,
    summary: Column | None = None, generators: Column | None = None, flags: Column | None = None,
) -> Column:
    """Sentences that fit, joined: verdict, provenance, generators or family, agreement, flags, strongest signal.

    members, generators: maps of name to probability.  flags: array of (label, score), of the first three those of 0.5 and more are told.
    """
    said = SENTENCES
    none = F.lit(None).cast("string")
    lead = F.when(state == "ai", F.format_string(said["ai"], p * 100)).when(state == "authentic", F.format_string(said["authentic"], p * 100)).otherwise(F.format_string(said["uncertain"], p * 100))
    known = none if summary is None else F.when((summary != "") & (summary != said["none"]), F.concat(F.rtrim(summary, F.lit(".")), F.lit(".")))
    origin = F.when(void, said["absent"]).otherwise(known)
    source = F.when(family_share >= 0.3, F.format_string(said["family"], labelled(family, FAMILY_LABELS), family_share * 100))
    if generators is not None:
        source = F.when(F.size(generators) > 0, F.format_string(said["generators"], strongest(generators, 2, "%s %.1f%%"))).otherwise(source)
    together = F.when(agreement < 0.5, said["disagree"]).when(F.size(members) > 0, F.format_string(said["members"], strongest(members, 2, "%s %.0f%%")))
    raised = none
    if flags is not None:
        told = F.filter(F.slice(flags, 1, 3), lambda f: (f["label"] != "") & (f["score"] >= 0.5))
        raised = F.when(F.size(told) > 0, F.array_join(F.transform(told, lambda f: F.format_string(said["flag"], F.lower(f["label"]), f["score"])), " "))
    signal = F.when(feature.isNotNull(), F.format_string(said["signal"], feature, F.abs(contribution), F.when(contribution > 0, TOWARD[0]).otherwise(TOWARD[1])))
    return F.concat_ws(" ", lead, origin, source, together, raised, signal)


def sentence_count(text: Column) -> Column:
    return F.size(F.split(text, r"\. ")) - 1 + F.when(text.endswith("."), 1).otherwise(0)


#: Card -> how its score follows from the feature.
CARDS = {
    "Spectral Slope": ("slope", lambda f: F.abs(F.abs(f) - 2) / 2), "Spectral Flatness": ("flatness", lambda f: f * 8), "Phase Entropy": ("entropy", lambda f: lit(1.0) - f),
    "High-Freq Energy": ("high", lambda f: f * 20), "DCT High-Freq": ("dct_high", lambda f: f * 12), "Checkerboard Peaks": ("peak", lambda f: f / 10),
    "Noise Kurtosis": ("kurtosis", lambda f: F.abs(f) / 6), "Fractal Dimension": ("fractal", lambda f: (f - 1) / lit(0.9)), "Wavelet Detail Ratio": ("detail", lambda f: f * 2),
    "Patch Inconsistency": ("patch", lambda f: f),
}


def cards(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, card, score) for each card whose feature is in ``columns``."""
    own = [F.struct(F.lit(card).alias("card"), clip(f(columns[name].cast("double")), 0.0, 1.0).alias("score")) for card, (name, f) in CARDS.items() if name in columns]
    return df.select(key, F.explode(F.array(*own)).alias("c")).select(key, "c.card", "c.score")


def top_signals(scores: DataFrame, key: str, high: int = 3, low: int = 2) -> DataFrame:
    """The names of the highest and the lowest scores, and a confidence band of the highest."""
    down, up = Window.partitionBy(key).orderBy(F.desc("score"), "card"), Window.partitionBy(key).orderBy("score", "card")
    ranked = scores.withColumns({"down": F.row_number().over(down), "up": F.row_number().over(up)})
    names = lambda place, n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(place) <= n, F.struct(place, "card")))), lambda s: s["card"]), ", ")
    best = F.max("score") * 100
    band = F.when(best >= 85, "high").when(best >= 65, "moderate").otherwise("low")
    return ranked.groupBy(key).agg(names("down", high).alias("strongest"), names("up", low).alias("weakest"), band.alias("band"))


def saliency(tiles: DataFrame, image: str = "image") -> DataFrame:
    """Tiles (image, tile, slope, flatness) with deviation from slope 2 and from the image's mean, both by their greatest, and the image's score."""
    own = Window.partitionBy(image)
    dev = F.abs(F.col("slope") - 2)
    mean, std = F.avg("slope").over(own), F.stddev_pop("slope").over(own)
    z = F.when(std > 0, F.abs(F.col("slope") - mean) / std).otherwise(lit(0.0))
    staged = tiles.withColumns({"dev": dev, "z": z, "spread": std, "mean": mean, "flat_spread": F.stddev_pop("flatness").over(own)})
    most = lambda c: F.when(F.max(c).over(own) > 0, F.col(c) / F.max(c).over(own)).otherwise(lit(0.0))
    score = clip(F.when(F.col("mean") != 0, F.col("spread") / F.abs("mean")).otherwise(lit(0.0)) + F.col("flat_spread"), 0.0, 1.0)
    return staged.select(image, "tile", most("dev").alias("saliency"), most("z").alias("inconsistency"), score.alias("score"))


def tiles_per_side(requested: Column, height: Column, width: Column) -> Column:
    return F.greatest(F.lit(2), F.least(requested, F.floor(F.least(height, width) / 16))).cast("int")


#: Nine anchors of the viridis colour map.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (109, 205, 89), (253, 231, 37))


def viridis(x: Column) -> Column:
    """(r, g, b) of a value in [0, 1], linear between anchors."""
    table = F.array(*[F.array(*map(F.lit, rgb)) for rgb in VIRIDIS])
    at = clip(x, 0.0, 1.0) * (len(VIRIDIS) - 1)
    low = F.least(F.floor(at), F.lit(len(VIRIDIS) - 2)).cast("int")
    share = at - low
    a, b = F.get(table, low), F.get(table, low + 1)
    return F.zip_with(a, b, lambda p, q: F.floor(p + (q - p) * share + 0.5).cast("int"))


def arbiter_needed(p: Column) -> Column:
    return p.between(0.30, 0.70)


def suspicious(flags: Column) -> Column:
    return F.exists(flags, lambda s: s >= 0.5)


#: Highest frequency shown; labels of families and of models by family.
MOST_HERTZ = 22050
DISPLAY_LABELS = {"real": "Real Camera", "diffusion": "Diffusion Model", "gan": "GAN", "other": "Other / Unknown"}
PREDICTED_FAMILIES = {"real": "Real", "diffusion": "Diffusion", "gan": "GAN", "other": "Unknown"}
KNOWN_MODELS = {
    "Diffusion": ("Stable Diffusion XL", "Stable Diffusion v2.1", "Stable Diffusion v1.5", "Custom"), "GAN": ("StyleGAN3", "StyleGAN2", "Custom"),
    "Transformer": ("DALL-E 3", "DALL-E 2", "Custom"), "Real": (), "Unknown": (),
}
STYLE_WORDS = {"Diffusion": ("diffusion", "stable", "latent"), "GAN": ("gan", "stylegan", "generator"), "Transformer": ("transformer", "dalle", "attention")}
FORM_CONFIDENCE = 85


def spectrum_points(df: DataFrame, key: str, profile: str) -> DataFrame:
    """A radial profile as chart points: bin, hz (of a share of the highest frequency), magnitude, energy."""
    long = df.select(key, F.size(profile).alias("n"), F.posexplode(profile).alias("bin", "magnitude"))
    share = F.col("bin") / F.greatest(F.col("n") - 1, F.lit(1))
    return long.select(key, "bin", F.floor(share * MOST_HERTZ + 0.5).cast("long").alias("hz"), "magnitude", (F.col("magnitude") * F.col("magnitude")).alias("energy"))


def explorer_series(df: DataFrame, key: str, radial: str, azimuthal: str) -> DataFrame:
    """Radial and azimuthal profiles in one series (key, kind, place, value), and the series' mean value and energy."""
    one = df.select(key, F.lit("radial").alias("kind"), F.posexplode(radial).alias("place", "value"))
    two = df.select(key, F.lit("azimuthal").alias("kind"), F.posexplode(azimuthal).alias("place", "value"))
    own = Window.partitionBy(key)  # the bins of one image
    series = one.unionByName(two)
    return series.withColumns({"mean_magnitude": F.avg("value").over(own), "mean_energy": F.avg(F.col("value") * F.col("value")).over(own)})


def default_point(df: DataFrame, key: str, radial: str, azimuthal: str) -> DataFrame:
    """The point in the middle of the joined series, selected at first."""
    both = F.concat(F.transform(radial, lambda v, i: F.struct(F.lit("radial").alias("kind"), i.alias("place"), v.alias("value"))), F.transform(azimuthal, lambda v, i: F.struct(F.lit("azimuthal").alias("kind"), i.alias("place"), v.alias("value"))))
    return df.select(key, F.get(both, F.floor(F.size(both) / 2).cast("int")).alias("point")).select(key, "point.*")


def bands(df: DataFrame, key: str, energies: str, entropies: str) -> DataFrame:
    """Flat arrays of energies and entropies, three to a level -> (key, level, band, energy, entropy)."""
    long = df.select(key, F.posexplode(F.arrays_zip(F.col(energies).alias("energy"), F.col(entropies).alias("entropy"))).alias("i", "b"))
    name = F.element_at(F.array(F.lit("LH"), F.lit("HL"), F.lit("HH")), F.col("i") % 3 + 1)
    return long.select(key, F.floor(F.col("i") / 3).cast("int").alias("level"), name.alias("band"), "b.energy", "b.entropy")


def levels(rows: DataFrame, key: str) -> DataFrame:
    """Bands by level: summed energy, mean entropy, anomaly (mean lack of entropy), and whether the level is shown first."""
    out = rows.groupBy(key, "level").agg(F.sum("energy").alias("energy"), F.avg("entropy").alias("entropy"), clip(F.avg(1 - F.col("entropy")), 0.0, 1.0).alias("anomaly"))
    return out.withColumn("selected", F.col("level") == F.min("level").over(Window.partitionBy(key)))


def sorted_list(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """Each key's rows numbered from 1 by ``by`` downwards, equal ones by name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), name)))


def family_list(rows: DataFrame, key: str) -> DataFrame:
    """(key, family, probability) by probability, with display labels."""
    return sorted_list(rows, key, "probability", "family").withColumn("name", labelled(F.col("family"), DISPLAY_LABELS))


def insight(confidence: Column, is_ai: Column, model: Column, strong: Column, weak: Column) -> Column:
    """Three lines on a result; strong and weak are the printed signals."""
    band = F.when(confidence >= 85, "high confidence").when(confidence >= 65, "moderate confidence").otherwise("low confidence")
    kind = F.when(is_ai, "AI-generated").otherwise("authentic")
    return F.concat_ws(
        "\n",
        F.format_string("- The detector reports %s (%.1f%%) for %s content.", band, confidence, kind),
        F.format_string("- The strongest signals are %s, which align with %s.", strong, model),
        F.format_string("- Lower-impact signals (%s) suggest reviewing source quality (compression/resizing) before final action.", weak),
    )


def prediction(is_ai: Column, family: Column, confidence: Column, inconsistency: Column, prominence: Column, deviation: Column) -> Column:
    """An analysis as the prediction that labelling starts from: family, model, confidence, cdcs, checkerboard, calibration."""
    known = F.when(~is_ai, "Real").when(family.isin("diffusion", "gan"), labelled(family, PREDICTED_FAMILIES)).otherwise("Unknown")
    model = F.when(~is_ai, "Real Camera").when(family == "diffusion", "Diffusion Model").when(family == "gan", "GAN").otherwise("Unknown Generator")
    calibration = F.when(lit(1.0) - deviation > 0, clip(lit(1.0) - inconsistency, 0.0, 1.0)).otherwise(lit(0.5))
    return F.struct(
        known.alias("family"), model.alias("model"), (confidence / 100).alias("confidence"), inconsistency.alias("cdcs"), F.least(lit(1.0), prominence / 10).alias("checkerboard"), calibration.alias("calibration"),
    )


def model_choices(spark) -> DataFrame:
    """(family, place, model): the small table that the label form looks families up in."""
    return spark.createDataFrame([(f, n, m) for f, models in KNOWN_MODELS.items() for n, m in enumerate(models)], "family string, place int, model string")


def label_form(predictions: DataFrame, choices: DataFrame, family: str = "family") -> DataFrame:
    """Each prediction with the models of its family to choose from, the first chosen ("" if there are none), and the default confidence."""
    own = choices.groupBy(F.col("family").alias("form__family")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "model"))), lambda s: s["model"]).alias("models"))
    out = predictions.join(own, F.col(family) == F.col("form__family"), "left").drop("form__family")  # a row for each family: the planner broadcasts it
    models = F.coalesce("models", F.array().cast("array<string>"))
    return out.withColumns({"models": models, "selected": F.coalesce(F.get(models, F.lit(0)), F.lit("")), "confidence_default": F.lit(FORM_CONFIDENCE)})


def model_info(report: DataFrame, fallback: dict[str, object]) -> DataFrame:
    """Fields of the loaded model: the report's, else the fallback's."""
    return report.select(*[F.coalesce(F.col(name) if name in report.columns else F.lit(None), F.lit(value)).alias(name) for name, value in fallback.items()])


def curve_points(report: DataFrame, xs: str, ys: str) -> DataFrame:
    """Two arrays of a report as rows (place, x, y)."""
    return report.select(F.posexplode(F.arrays_zip(F.col(xs).alias("x"), F.col(ys).alias("y"))).alias("place", "p")).select("place", "p.x", "p.y")


def provenance_profile(clusters: DataFrame, patterns: str, family: str) -> DataFrame:
    """Patterns of a cluster by the word they contain, and its family's style words."""
    kept = lambda word: F.filter(patterns, lambda x: x.contains(word))
    words = F.lit(None).cast("array<string>")
    for name, own in STYLE_WORDS.items():
        words = F.when(F.col(family) == name, F.array(*map(F.lit, own))).otherwise(words)
    return clusters.withColumns({
        "software": kept("software"), "camera": kept("camera"), "processing": kept("processing"), "style": F.coalesce(words, F.array().cast("array<string>")),
    })
