"""From member probabilities to a verdict: thresholds, states, agreement, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions.numeric import clip, lit, logistic, mean

#: Fixed values.
LEAST_THRESHOLD, GREATEST_THRESHOLD, AMBIGUITY, EPSILON = 0.05, 0.5, 0.05, 1e-9
FAMILIES = ("real", "diffusion", "gan", "other")
#: Intercept and slope of each family's logit in the fake probability.
FAMILY_WEIGHTS = ((3.0, -6.0), (-1.0, 2.0), (-2.5, 4.5), (-2.0, 3.0))


def clamp_threshold(t: Column) -> Column:
    """Unusable thresholds become 0.5, too small ones 0.05."""
    return F.when(t.isNull() | F.isnan(t) | (t >= GREATEST_THRESHOLD), lit(GREATEST_THRESHOLD)).otherwise(F.greatest(t, lit(LEAST_THRESHOLD)))


def resolve_threshold(*candidates: Column) -> Column:
    return clamp_threshold(F.coalesce(*candidates, F.lit(None).cast("double")))


def verdict_state(p: Column, threshold: Column) -> Column:
    """ai at the gate and at 0.5; uncertain at the gate below 0.5, or just below the gate; else authentic."""
    return (
        F.when((p >= threshold) & (p >= 0.5), "ai")
        .when(p >= threshold, "uncertain")
        .when(p >= threshold - AMBIGUITY - EPSILON, "uncertain")
        .otherwise("authentic")
    )


def with_verdict(df: DataFrame, p: str = "p", threshold: Column | None = None) -> DataFrame:
    t = clamp_threshold(lit(0.5) if threshold is None else threshold)
    return df.withColumns({"is_ai": F.col(p) >= t, "verdict_state": verdict_state(F.col(p), t), "confidence": F.col(p) * 100})


def deviation(members: Column) -> Column:
    """Population standard deviation of an array."""
    return F.sqrt(mean(F.transform(members, lambda x: (x - mean(members)) * (x - mean(members)))))


def agreement(members: Column) -> Column:
    return F.when(F.size(members) < 2, lit(1.0)).otherwise(clip(lit(1.0) - deviation(members) / lit(0.5), 0.0, 1.0))


def agreement_gate(df: DataFrame) -> DataFrame:
    """Split ensembles below probability 0.9 are uncertain, whatever the threshold says."""
    split = (F.col("agreement") < 0.5) & (F.col("p") < 0.9)
    return df.withColumns({
        "verdict_state": F.when(split, "uncertain").otherwise(F.col("verdict_state")), "is_ai": F.when(split, False).otherwise(F.col("is_ai")),
    })


def attribution(p: Column) -> Column:
    """Softmax over generator families, as an array in the order of ``FAMILIES``."""
    logits = [lit(a) + lit(b) * p for a, b in FAMILY_WEIGHTS]
    powers = [F.exp(z - F.greatest(*logits)) for z in logits]
    norm = powers[0] + powers[1] + powers[2] + powers[3]
    return F.array(*[x / norm for x in powers])


def top_family(p: Column) -> Column:
    """(family, probability); the first family wins ties."""
    shares = attribution(p)
    at = F.array_position(shares, F.array_max(shares)).cast("int")
    return F.struct(F.element_at(F.array(*map(F.lit, FAMILIES)), at).alias("family"), F.element_at(shares, at).alias("probability"))


def average(members: Column) -> Column:
    return mean(members)


def stacked(members: Column, intercept: float, weights: tuple[float, ...]) -> Column:
    """A fitted meta-learner's logistic of the member probabilities."""
    z = lit(intercept)
    for i, w in enumerate(weights, 1):
        z = z + lit(w) * F.element_at(members, i)
    return logistic(z)


def raw_score(members: Column, meta: Column | None) -> Column:
    return average(members) if meta is None else F.coalesce(meta, average(members))


def tta_average(variants: DataFrame, key: str = "id") -> DataFrame:
    """One row per image from its variants: the mean raw score, the members of variant 0."""
    return variants.groupBy(key).agg(
        clip(F.avg("raw"), 0.0, 1.0).alias("p"), F.count("*").alias("variants"), F.min_by("members", "variant").alias("members")
    )


def ui_verdict(state: Column, agree: Column) -> Column:
    """What a reader is shown: low agreement overrides the state."""
    return (
        F.when(agree < 0.5, "Uncertain").when(state == "ai", "AI Generated").when(state == "authentic", "Authentic Image").otherwise("Uncertain")
    )


def verdict_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("verdict_state").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


def contributions(values: DataFrame, key: str, probe: int | None = 24, keep: int | None = 10) -> DataFrame:
    """Rows (key, feature, value, delta) -> the ``keep`` largest deltas among the ``probe`` largest values, by delta; all of them where these are None."""
    large = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    strong = Window.partitionBy(key).orderBy(F.abs("delta").desc(), "feature")
    signed = Window.partitionBy(key).orderBy(F.desc("delta"), "feature")
    probed = values if probe is None else values.withColumn("place", F.row_number().over(large)).where(F.col("place") <= probe)
    kept = probed if keep is None else probed.withColumn("place", F.row_number().over(strong)).where(F.col("place") <= keep)
    return kept.withColumn("place", F.row_number().over(signed))
