"""From image files to verdicts: decoding, features, scores, provenance, content checks, words, in one row a file.

An image goes to Python once: all families, the tiles and the content checks come from the same pass.  What can't be decoded, and what can't
be scored, is an error row; the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.functions.numeric import clip, lit, mean
from glintframe.operators import narrative as N
from glintframe.operators import planes as P
from glintframe.operators import verdict as V
from glintframe.operators.arbiter import flags
from glintframe.operators.models import MEMBERS, Trained, contributions

#: Features whose contribution is looked at, and those that are told.
PROBE, TOLD = 24, 10


def unevenness(tiles: Column) -> Column:
    """How much an image's tiles (slope, flatness) differ: the slopes' spread by their mean, and the flatnesses' spread; 0 to 1."""
    spread = lambda c: V.deviation(F.transform(tiles, lambda t: t[c]))
    centre = mean(F.transform(tiles, lambda t: t["slope"]))
    return clip(F.when(centre != 0, spread("slope") / F.abs(centre)).otherwise(lit(0.0)) + spread("flatness"), 0.0, 1.0)


def described(images: DataFrame, side: int = P.SIDE) -> DataFrame:
    """Images with features, the unevenness of their tiles, and what the content checks measure."""
    from glintframe.operators import arbiter  # noqa: F401  its families

    parts = P.measured(images, (*P.VECTOR, "tiles", "light", "skin"), side)
    kept = [c for c in images.columns if c != "pixels"]
    there = F.col("plane__vector.values").isNotNull()
    return parts.select(*kept, P.features_of().alias("features"), F.when(there, unevenness(P.tile_figures(F.col("plane__tiles")))).alias("unevenness"), "plane__light", "plane__skin")


def analyze(images: DataFrame, trained: Trained, key: str = "path", side: int = P.SIDE, threshold: float | None = None, probe: int = PROBE, told: int = TOLD, stored=None) -> DataFrame:
    """A row for each image file (``key``, content, reason, and pixels, height, width, channels): verdict, evidence, provenance, flags, severity, narrative.

    ``stored`` writes a frame and rereads it: what is described is read twice, for the scores and for the contributions of the ``probe`` largest features.
    """
    rows = described(images, side)
    rows = stored(rows) if stored else rows
    scored = trained.score(rows, broken=F.col("reason"))
    ok = F.col("error").isNull()
    scored = N.provenance(V.with_verdict(scored, threshold=None if threshold is None else lit(threshold)), "content")
    scored = scored.withColumn("agreement", V.agreement(F.col("members")))
    gated = V.agreement_gate(scored)
    open_ = N.arbiter_needed(F.col("p"))
    none = F.array().cast("array<struct<kind:string,label:string,score:double>>")
    gated = gated.withColumn("flags", F.when(ok & open_, flags(F.col("plane__light"), F.col("plane__skin"))).otherwise(none))
    gated = gated.withColumns({"suspicious": N.suspicious(F.transform("flags", lambda f: f["score"])), "families": V.attribution(F.col("p")), "top": V.top_family(F.col("p"))})
    found = contributions(trained.ensemble, rows.where("features is not null"), key, probe=probe, keep=told)
    names = F.array(*[F.lit(n) for n in P.feature_columns()])
    signal = F.struct(F.abs("delta").alias("size"), F.get(names, F.col("feature")).alias("feature"), "value", "delta")
    evidence = found.groupBy(F.col(key).alias("evidence__key")).agg(F.sort_array(F.collect_list(signal), asc=False).alias("evidence"))  # ``told`` a file
    joined = gated.join(evidence, F.col(key) == F.col("evidence__key"), "left")
    strongest = F.get("evidence", F.lit(0))
    members = F.map_from_arrays(F.array(*map(F.lit, MEMBERS)), F.col("members"))
    shares = F.map_from_arrays(F.array(*map(F.lit, V.FAMILIES)), F.col("families"))
    words = N.narrative(
        F.col("verdict_state"), F.col("p"), F.col("void"), F.col("top.family"), F.col("top.probability"), F.col("agreement"), members, strongest["feature"], strongest["delta"],
        F.col("summary"), shares, F.col("flags"),
    )
    said = lambda c: F.when(ok, c)
    return joined.select(
        key, F.sha2("content", 256).alias("sha256"), "height", "width", "status", "error", F.round("p", 4).alias("p"), "members", F.round("agreement", 4).alias("agreement"),
        *[said(F.col(c)).alias(c) for c in ("is_ai", "verdict_state")], F.round("confidence", 2).alias("confidence"), said(F.col("families")).alias("families"),
        said(F.round("unevenness", 4)).alias("unevenness"), F.transform("evidence", lambda e: e.dropFields("size")).alias("evidence"), "has_c2pa", "has_exif", "has_iptc", "void",
        F.col("summary").alias("provenance"), "flags", "suspicious", said(N.severity(F.col("verdict_state"), F.col("agreement"), F.col("suspicious"), F.col("has_c2pa"))).alias("severity"),
        said(words).alias("narrative"),
    )
