"""Weak supervision: fusing detector and user labels, noise rules, quality, accuracy over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.functions.numeric import clip, lit
from glintframe.operators import scan

#: Fixed values.
EMA_NEW, EMA_START = 0.1, 0.5
AI_FAMILIES = ("Diffusion", "GAN", "Transformer")
NOISE = {
    "disagree": ("Strong disagreement between high-confidence detector and user", 0.8),
    "high": ("High CDCS (AI-like) conflicts with Real label", 0.7),
    "low": ("Low CDCS (Real-like) conflicts with AI label", 0.6),
}


def fuse(df: DataFrame) -> DataFrame:
    """Adds fused_model, fused_confidence, detector_weight and user_weight.

    Columns: model, confidence (0-1), calibration, cdcs; user_model, user_confidence (0-100) and
    user_accuracy, null without a label.  An accuracy of 0 counts as unknown, 0.5.
    """
    d = F.col("calibration") * F.when(F.col("confidence") > 0.9, 1.2).otherwise(1.0) * F.when(F.col("cdcs") > 0.7, 1.15).otherwise(1.0) * lit(0.7)
    accuracy = F.coalesce(F.nullif(F.col("user_accuracy"), lit(0.0)), lit(EMA_START))
    u = F.col("user_confidence") / 100 * accuracy * lit(0.3)
    nd, nu = d / (d + u), u / (d + u)
    ds, us = F.col("confidence") * nd, F.col("user_confidence") / 100 * nu
    together = F.when(F.col("model") == F.col("user_model"), F.least((ds + us) * lit(1.1), lit(1.0))).otherwise(ds + us)
    alone = F.col("user_model").isNull()
    return df.withColumns({
        "fused_model": F.when(alone | (us <= ds), F.col("model")).otherwise(F.col("user_model")), "fused_confidence": F.when(alone, F.col("confidence")).otherwise(together),
        "detector_weight": F.when(alone, lit(1.0)).otherwise(nd), "user_weight": F.when(alone, lit(0.0)).otherwise(nu),
    })


def noise(df: DataFrame) -> DataFrame:
    """Adds noisy, noise_reason and noise_confidence; the first rule that fits decides."""
    none = F.col("user_model").isNull()
    disagree = (F.col("model") != F.col("user_model")) & (F.col("confidence") > 0.85) & (F.col("user_confidence") > 85)
    high = (F.col("cdcs") > 0.8) & (F.col("user_family") == "Real")
    low = (F.col("cdcs") < 0.3) & F.col("user_family").isin(*AI_FAMILIES)
    rule = F.when(none, None).when(disagree, "disagree").when(high, "high").when(low, "low")
    reason, sure = F.when(none, "No user label"), F.when(none, lit(0.0))
    for name, (text, confidence) in NOISE.items():
        reason, sure = reason.when(rule == name, text), sure.when(rule == name, lit(confidence))
    return df.withColumns({"noisy": rule.isNotNull(), "noise_reason": reason.otherwise("Signals are consistent"), "noise_confidence": sure.otherwise(lit(0.0))})


def quality(df: DataFrame) -> DataFrame:
    """Adds ``quality`` from the columns of ``fuse`` and ``noise``."""
    part = lambda cond, x: F.when(cond, lit(x)).otherwise(lit(0.0))
    total = (
        lit(0.5) + part(F.col("confidence") > 0.9, 0.2) + part(F.col("user_confidence") > 85, 0.15) + part(F.col("model") == F.col("user_model"), 0.2)
        + part((F.col("cdcs") > 0.8) | (F.col("cdcs") < 0.2), 0.15) - F.when(F.col("noisy"), lit(0.3) * F.col("noise_confidence")).otherwise(lit(0.0))
        - part(F.col("fused_confidence") < 0.6, 0.2)
    )
    return df.withColumn("quality", clip(total, 0.0, 1.0))


def user_accuracy(df: DataFrame, user: str, order: str, hit: Column) -> DataFrame:
    """Moving accuracy of each user, and counters.

    Labels of one user at the same ``order`` count in the order of their hits' hashes.  A user's labels are cut into pieces of bounded size,
    each one affine map of the average.
    """
    rows = df.select(F.col(user).alias("user"), F.col(order).alias("order"), hit.cast("int").alias("hit"))
    moved = scan.moving_average(rows, ["user"], F.col("order"), F.col("hit"), F.col("hit"), EMA_NEW, EMA_START)
    return moved.select("user", F.col("n").alias("labels"), F.col("total").cast("long").alias("hits"), F.col("average").alias("accuracy"))


def leaderboard(users: DataFrame, least: int = 10, n: int = 10) -> DataFrame:
    """The most accurate users with ``least`` labels or more."""
    return users.where(F.col("labels") >= least).orderBy(F.desc("accuracy"), "user").limit(n)


def contributors(users: DataFrame, n: int = 10) -> DataFrame:
    return users.orderBy(F.desc("labels"), "user").limit(n)


def submit(signals: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Fused signals with their quality, and success or the error of each: a vector of the wrong length costs its own row alone."""
    rows = quality(noise(fuse(signals)))
    error = F.when(F.col(vector).isNull() | (F.size(vector) != dimension), F.format_string("Invalid embedding dimension: expected %d", F.lit(dimension)))
    done = rows.withColumns({"success": error.isNull(), "error": error})
    return done.withColumn("quality", F.when(F.col("success"), F.col("quality")))
