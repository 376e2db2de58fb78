"""Fitting, calibrating and judging the score ensemble with pyspark.ml.

Four members score a feature vector: a forest, boosted trees, a logistic regression, and a
kernel machine as random Fourier features of the Gaussian kernel under a logistic regression.
Rows stay distributed; only fitted models and per-fold figures reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glintframe.functions.numeric import clip, lit, logistic, total
from glintframe.operators import evaluation as E
from glintframe.operators.manifest import folds
from glintframe.operators.verdict import contributions as strongest_contributions
from glintframe.session import stored

#: Members in the order of their columns; prefixes of feature names and their families.
MEMBERS = ("rf", "svm", "lr", "gb")
FEATURE_FAMILIES = {
    "fft_": "fft", "dct_": "dct", "wavelet_": "wavelet", "noise_": "noise", "texture_": "texture", "chroma_": "chroma", "hos_": "hos", "jpeg_": "jpeg",
    "prnu_": "prnu", "freqtex_": "freq_texture",
}
#: Logits are taken of probabilities this far from 0 and 1; a map is saturated if this share of it is at 0 and 1.
LOGIT_EDGE, SATURATED, AT_END = 1e-7, 0.95, 1e-6


@dataclass(frozen=True)
class Config:
    """Sizes of the members; ``waves`` is the number of random Fourier features."""

    trees: int = 300
    tree_depth: int = 24
    boosts: int = 200
    boost_depth: int = 4
    boost_rate: float = 0.05
    svm_c: float = 4.0
    waves: int = 256
    iterations: int = 2000
    seed: int = 42


@dataclass
class Ensemble:
    forest: object
    boosted: object
    linear: object
    kernel: object
    waves: np.ndarray
    phases: np.ndarray
    features: list[str] = field(default_factory=list)

    def members(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """``df`` with ``members``: the four fake probabilities of its vector."""
        out = df.withColumn("ml__x", array_to_vector(vector)).withColumn("ml__w", array_to_vector(lifted(self.waves, self.phases)(vector)))
        for name, model, column in (("rf", self.forest, "ml__x"), ("gb", self.boosted, "ml__x"), ("lr", self.linear, "ml__x"), ("svm", self.kernel, "ml__w")):
            model = model.copy()
            model.setFeaturesCol(column).setProbabilityCol(f"ml__{name}").setRawPredictionCol(f"ml__raw_{name}").setPredictionCol(f"ml__hit_{name}")
            out = model.transform(out)
        members = F.array(*[vector_to_array(F.col(f"ml__{name}"))[1] for name in MEMBERS])
        return out.select(*df.columns, members.alias("members"))


def lifted(waves: np.ndarray, phases: np.ndarray):
    """Random Fourier features of an array column."""
    scale = math.sqrt(2.0 / len(phases))

    @pandas_udf("array<double>")
    def lift(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            rows = np.stack([np.asarray(v, np.float64) for v in x]) if len(x) else np.zeros((0, waves.shape[0]))
            yield pd.Series(list(scale * np.cos(rows @ waves + phases)), dtype=object)

    return lift


def fit(df: DataFrame, config: Config | None = None, vector: str = "features", label: str = "y") -> Ensemble:
    """The four members, fitted to rows with an array column and a label; both labels must be there."""
    config = config or Config()
    size, classes, n = df.agg(F.max(F.size(vector)), F.count_distinct(label), F.count("*")).first()
    if classes != 2:
        raise ValueError("an ensemble needs rows of exactly two classes")
    spread = df.select(F.explode(vector).alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
    random = np.random.default_rng(config.seed)
    waves, phases = random.normal(0.0, math.sqrt(2.0 / (size * spread)), (size, config.waves)), random.uniform(0.0, 2 * math.pi, config.waves)
    rows = df.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"), array_to_vector(lifted(waves, phases)(vector)).alias("lifted"))
    rows = rows.persist()
    makers = [
        RandomForestClassifier(numTrees=config.trees, maxDepth=config.tree_depth, seed=config.seed),
        GBTClassifier(maxIter=config.boosts, maxDepth=config.boost_depth, stepSize=config.boost_rate, seed=config.seed),
        LogisticRegression(maxIter=config.iterations, regParam=1.0 / n, standardization=False),
        LogisticRegression(maxIter=config.iterations, regParam=1.0 / (config.svm_c * n), standardization=False, featuresCol="lifted"),
    ]
    try:
        rows.count()  # the rows are made once, before the fits that share them
        fitted = at_once(df.sparkSession, [lambda maker=maker: maker.fit(rows) for maker in makers])
    finally:
        rows.unpersist()
    return Ensemble(*fitted, waves, phases)


def at_once(spark: SparkSession, works: list[Callable[[], Any]]) -> list[Any]:
    """What each of ``works`` returns, in their order.  They run beside each other: a fit is a long row of short jobs that leave cores idle."""
    with ThreadPoolExecutor(len(works)) as pool:
        return [found.result() for found in [pool.submit(inheritable_thread_target(spark)(work)) for work in works]]


def average(members: Column) -> Column:
    return total(members) / F.size(members)


def out_of_fold(df: DataFrame, config: Config | None = None, key: str = "id", vector: str = "features", label: str = "y", k: int = 5) -> DataFrame:
    """``df`` with fold, members and p (their mean), each row scored by an ensemble that hasn't seen its fold.

    Rows are written before the fits, which read them many times, and scores after them: what ``df`` is made of is computed once.
    """
    dealt = stored(folds(df, label, key, k), "dealt")
    parts = [fit(dealt.where(F.col("fold") != n), config, vector, label).members(dealt.where(F.col("fold") == n), vector) for n in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out.withColumn("p", average(F.col("members"))), "out-of-fold")


def fold_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: unweighted means of the folds' figures, the calibration error of all rows together."""
    by_fold = E.binary_metrics(scored, threshold, ["fold"]).select("fold", "accuracy", "precision", "recall", "f1")
    auc = E.roc_auc_by(scored.withColumn("fold", F.col("fold").cast("string")), "fold")
    both = by_fold.withColumn("fold", F.col("fold").cast("string")).join(auc, "fold")
    means = both.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])
    counts = scored.agg(F.sum(F.col("y").cast("long")).alias("n_fake"), F.sum(1 - F.col("y").cast("long")).alias("n_real"))
    return means.crossJoin(E.calibration_error(scored)).crossJoin(counts)  # one row each


def leave_one_out(df: DataFrame, config: Config | None = None, by: str = "generator", vector: str = "features", label: str = "y") -> DataFrame:
    """(generator, n, accuracy, roc_auc) of each generator, scored by an ensemble fitted to the others; without rows where fewer than two can be held out.

    A model is fitted for each generator: their names are read to the driver, as many as there are fits.
    """
    named = stored(df.select(F.coalesce(F.col(by), F.lit("unknown")).alias(by), label, vector), "named")  # each fit reads it
    names = sorted(r[0] for r in named.select(by).distinct().collect())
    out = []
    for name in names if len(names) > 1 else []:
        rest = named.where(F.col(by) != name)
        if rest.select(label).distinct().count() != 2:
            continue
        scored = fit(rest, config, vector, label).members(named.where(F.col(by) == name), vector)
        out.append(scored.select(by, F.col(label).alias("y"), average(F.col("members")).alias("p")))
    if not out:
        return df.sparkSession.createDataFrame([], f"{by} string, n long, accuracy double, roc_auc double")
    scored = out[0]
    for part in out[1:]:
        scored = scored.unionByName(part)
    scored = stored(scored, "held-out")
    return E.binary_metrics(scored, 0.5, [by]).select(by, "n", "accuracy").join(E.roc_auc_by(scored, by), by)


@dataclass
class Meta:
    """A logistic regression on the four members; without weights it isn't fitted."""

    intercept: float = 0.0
    weights: tuple[float, ...] = ()

    def score(self, members: Column) -> Column:
        z = lit(self.intercept)
        for i, w in enumerate(self.weights):
            z = z + lit(w) * members[i]
        return logistic(z) if self.weights else F.lit(None).cast("double")


def fit_meta(oof: DataFrame, label: str = "y") -> Meta:
    n = oof.count()
    model = LogisticRegression(regParam=1.0 / max(n, 1), standardization=False, maxIter=200)
    found = model.fit(oof.select(array_to_vector("members").alias("features"), F.col(label).cast("double").alias("label")))
    return Meta(found.intercept, tuple(found.coefficients.toArray().tolist()))


@dataclass
class Calibrator:
    """A monotone map of scores: steps of an isotonic fit, or the mean of logistic maps of the logit."""

    method: str
    boundaries: tuple[float, ...] = ()
    values: tuple[float, ...] = ()
    lines: tuple[tuple[float, float], ...] = ()

    def apply(self, p: Column) -> Column:
        if self.method == "isotonic":
            return _interpolated(p, self.boundaries, self.values)
        z = logit(p)
        return sum((logistic(lit(a) + lit(b) * z) for a, b in self.lines), lit(0.0)) / lit(len(self.lines))


def logit(p: Column) -> Column:
    q = clip(p, LOGIT_EDGE, 1 - LOGIT_EDGE)
    return F.log(q / (lit(1.0) - q))


def _interpolated(p: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Linear between the steps' ends, level beyond them."""
    points = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in zip(xs, ys)])
    below = F.element_at(F.filter(points, lambda s: s["x"] <= p), -1)
    above = F.element_at(F.filter(points, lambda s: s["x"] >= p), 1)
    share = F.when(above["x"] > below["x"], (p - below["x"]) / (above["x"] - below["x"])).otherwise(lit(0.0))
    return F.when(p <= xs[0], lit(ys[0])).when(p >= xs[-1], lit(ys[-1])).otherwise(below["y"] + share * (above["y"] - below["y"]))


def calibrate(df: DataFrame, p: str = "p", label: str = "y", method: str = "isotonic", key: str = "id") -> Calibrator:
    """An isotonic fit; a logistic one if asked for, if 95 % of the isotonic scores are 0 or 1, or if there is one class only.

    The isotonic fit is made of the counts at distinct scores.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"method must be isotonic or sigmoid, not {method}")
    if method == "isotonic" and df.select(label).distinct().count() == 2:
        counts = df.groupBy(F.col(p).alias("x")).agg(F.avg(label).alias("label"), F.count("*").cast("double").alias("n"))
        model = IsotonicRegression(weightCol="n").fit(counts.select(array_to_vector(F.array("x")).alias("features"), "label", "n"))
        found = Calibrator("isotonic", tuple(model.boundaries.toArray().tolist()), tuple(model.predictions.toArray().tolist()))
        mapped = model.transform(counts.select(array_to_vector(F.array("x")).alias("features"), "n"))
        ends = mapped.agg(F.sum(F.when((F.col("prediction") <= AT_END) | (F.col("prediction") >= 1 - AT_END), F.col("n")).otherwise(0.0)) / F.sum("n")).first()[0]
        if ends < SATURATED:
            return found
    return _sigmoid(df, p, label, key)


def _sigmoid(df: DataFrame, p: str, label: str, key: str) -> Calibrator:
    """Logistic maps of the logit, of three folds: a base on two of them, the map of its decisions on the third."""
    rows = folds(df.select(key, F.col(p).alias("p"), F.col(label).cast("double").alias("label")), "label", key, 3)
    rows = rows.withColumn("z", logit(F.col("p")))
    lines = []
    for n in range(3):
        base = LogisticRegression(regParam=1.0 / max(1, rows.where(F.col("fold") != n).count()), standardization=False)
        base = base.fit(rows.where(F.col("fold") != n).select(array_to_vector(F.array("z")).alias("features"), "label"))
        slope, start = float(base.coefficients[0]), float(base.intercept)
        held = rows.where(F.col("fold") == n).select(array_to_vector(F.array(lit(start) + lit(slope) * F.col("z"))).alias("features"), "label")
        top = LogisticRegression(standardization=False).fit(held)
        a, b = float(top.intercept), float(top.coefficients[0])
        lines.append((a + b * start, b * slope))
    return Calibrator("sigmoid", lines=tuple(lines))


def family_weights(df: DataFrame, p: str, family: str, families: int, rounds: int = 800, rate: float = 0.15, steps: int = 10_000) -> list[tuple[float, float]] | None:
    """Intercept and slope of each family's logistic head by gradient steps; None if a family has no rows.

    The steps run on counts at scores rounded to 1 / ``steps``: families x (steps + 1) numbers at most reach the driver.
    """
    at = F.round(F.col(p) * steps).cast("int")
    cells = df.groupBy(at.alias("at"), F.col(family).alias("family")).agg(F.count("*").alias("n")).toPandas()
    if set(range(families)) - set(cells["family"]):
        return None
    x, n = cells["at"].to_numpy(np.float64) / steps, cells["n"].to_numpy(np.float64)
    out = []
    for own in range(families):
        y, w = (cells["family"].to_numpy() == own).astype(np.float64), np.zeros(2)
        for _ in range(rounds):
            gap = (1.0 / (1.0 + np.exp(-(w[0] + w[1] * x))) - y) * n / n.sum()
            w -= rate * np.array([gap.sum(), (gap * x).sum()])
        out.append((float(w[0]), float(w[1])))
    return out


def family_columns(names: list[str]) -> dict[str, list[int]]:
    """Places of the features of each family, by the first prefix that fits."""
    out: dict[str, list[int]] = {}
    for at, name in enumerate(names):
        family = next((f for prefix, f in FEATURE_FAMILIES.items() if name.startswith(prefix)), None)
        if family:
            out.setdefault(family, []).append(at)
    return out


def ablation(df: DataFrame, names: list[str], config: Config | None = None, vector: str = "features", label: str = "y", least: float = 0.002) -> DataFrame:
    """(family, n_features, roc_auc, contributes) of ensembles that see one family's columns alone, judged on their own rows."""
    out = []
    df = stored(df.select(vector, label), "ablated")  # each fit reads it
    for family, places in family_columns(names).items():
        own = df.withColumn("ml__own", F.array(*[F.col(vector)[i] for i in places]))
        scored = fit(own, config, "ml__own", label).members(own, "ml__own").select(F.col(label).alias("y"), average(F.col("members")).alias("p"))
        out.append(E.roc_auc(stored(scored, "own-scores")).select(F.lit(family).alias("family"), F.lit(len(places)).alias("n_features"), "roc_auc"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.withColumn("contributes", F.col("roc_auc") >= least)


def top_features(df: DataFrame, k: int, vector: str = "features", label: str = "y", bins: int = 16) -> DataFrame:
    """(feature, mutual_information, place) of the ``k`` features that say most about the label, in equal-width bins.  Fit it to training rows only."""
    long = df.select(F.posexplode(vector).alias("feature", "x"), F.col(label).alias("y"))
    edges = long.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    edges = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "high")))).alias("edges"))  # a row with an entry for each feature
    own = F.col("edges")[F.col("feature")]
    at = F.when(own["high"] > own["low"], F.least(F.floor((F.col("x") - own["low"]) / (own["high"] - own["low"]) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    cells = long.crossJoin(F.broadcast(edges)).groupBy("feature", at.alias("bin"), "y").agg(F.count("*").alias("n"))
    by = Window.partitionBy("feature")  # bins x labels rows each
    parts = cells.withColumns({"t": F.sum("n").over(by), "a": F.sum("n").over(Window.partitionBy("feature", "bin")), "b": F.sum("n").over(Window.partitionBy("feature", "y"))})
    info = parts.groupBy("feature").agg(F.greatest(lit(0.0), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b"))))).alias("mutual_information"))
    place = F.row_number().over(Window.orderBy(F.desc("mutual_information"), "feature"))  # a row for each feature
    return info.withColumn("place", place).where(F.col("place") <= k)


def contributions(ensemble: Ensemble, df: DataFrame, key: str, vector: str = "features", probe: int | None = 24, keep: int | None = 10) -> DataFrame:
    """(key, feature, value, delta, place): what each of a row's ``probe`` largest features adds to its score, the ``keep`` strongest of them; all where these are None.

    A feature's part is the score less that of the row with this feature set to 0; every such row is scored.
    """
    base = ensemble.members(df.select(key, vector), vector).select(key, vector, average(F.col("members")).alias("ml__base"))
    # The largest features of a row, the first of equal ones first: sorted within the row, so nothing is shuffled.
    sized = F.transform(vector, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("back"), x.alias("value")))
    large = sized if probe is None else F.slice(F.sort_array(sized, asc=False), 1, probe)
    each = base.select(key, vector, "ml__base", F.explode(large).alias("ml__one"))
    each = each.select(key, vector, "ml__base", (-F.col("ml__one.back")).alias("feature"), F.col("ml__one.value").alias("value"))
    without = each.withColumn("ml__without", F.transform(vector, lambda x, i: F.when(i == F.col("feature"), lit(0.0)).otherwise(x)))
    scored = ensemble.members(without, "ml__without")
    deltas = scored.select(key, "feature", "value", (F.col("ml__base") - average(F.col("members"))).alias("delta"))
    return strongest_contributions(deltas, key, probe, keep)


@dataclass
class Trained:
    ensemble: Ensemble
    meta: Meta
    calibrator: Calibrator
    metrics: DataFrame
    holdouts: DataFrame

    def score(self, df: DataFrame, vector: str = "features", broken: Column | None = None) -> DataFrame:
        """``df`` with members, p (calibrated), status and error: a row without a usable vector is an error row, the others go on."""
        size = self.ensemble.waves.shape[0]
        error = F.when(F.col(vector).isNull(), "no features").when(F.size(vector) != size, "wrong number of features")
        error = F.coalesce(broken, error) if broken is not None else error
        safe = F.when(error.isNull(), F.col(vector)).otherwise(F.array_repeat(lit(0.0), size))
        scored = self.ensemble.members(df.withColumns({"error": error, "ml__safe": safe}), "ml__safe")
        raw = F.coalesce(self.meta.score(F.col("members")), average(F.col("members")))
        ok = F.col("error").isNull()
        scored = scored.withColumns({"p": F.when(ok, clip(self.calibrator.apply(raw), 0.0, 1.0)), "status": F.when(ok, "done").otherwise("error")})
        return scored.withColumn("members", F.when(ok, F.col("members"))).drop("ml__safe")


def train(df: DataFrame, config: Config | None = None, key: str = "id", vector: str = "features", label: str = "y", by: str | None = "generator", method: str = "isotonic", k: int = 5) -> Trained:
    """The whole run: out-of-fold scores, the meta-learner and the calibrator on these, the final ensemble on all rows, each generator (``by``, if any) held out once."""
    df = stored(df, "training")
    oof = out_of_fold(df, config, key, vector, label, k)
    meta = fit_meta(oof, label)
    raw = oof.withColumn("raw", F.coalesce(meta.score(F.col("members")), F.col("p")))
    calibrator = calibrate(raw, "raw", label, method, key)
    holdouts = df.sparkSession.createDataFrame([], "generator string, n long, accuracy double, roc_auc double") if by is None else leave_one_out(df, config, by, vector, label)
    return Trained(fit(df, config, vector, label), meta, calibrator, fold_metrics(oof.withColumn("y", F.col(label))), holdouts)


def save(trained: Trained, spark: SparkSession, path: str) -> None:
    """Everything that scoring needs, in Spark's own formats: no pickles."""
    e = trained.ensemble
    for name, model in (("rf", e.forest), ("gb", e.boosted), ("lr", e.linear), ("svm", e.kernel)):
        model.write().overwrite().save(f"{path}/{name}")
    c = trained.calibrator
    rest = {
        "waves": e.waves.tolist(), "phases": e.phases.tolist(), "intercept": trained.meta.intercept, "weights": trained.meta.weights,
        "method": c.method, "boundaries": c.boundaries, "values": c.values, "lines": c.lines,
    }
    spark.createDataFrame([(json.dumps(rest),)], "body string").coalesce(1).write.mode("overwrite").text(f"{path}/rest")
    trained.metrics.write.mode("overwrite").json(f"{path}/metrics")
    trained.holdouts.write.mode("overwrite").json(f"{path}/holdouts")


def load(spark: SparkSession, path: str) -> Trained:
    rest = json.loads(spark.read.text(f"{path}/rest", wholetext=True).first()[0])
    ensemble = Ensemble(
        RandomForestClassificationModel.load(f"{path}/rf"), GBTClassificationModel.load(f"{path}/gb"), LogisticRegressionModel.load(f"{path}/lr"),
        LogisticRegressionModel.load(f"{path}/svm"), np.array(rest["waves"]), np.array(rest["phases"]),
    )
    calibrator = Calibrator(rest["method"], tuple(rest["boundaries"]), tuple(rest["values"]), tuple(tuple(x) for x in rest["lines"]))
    holdouts = spark.read.schema("generator string, n long, accuracy double, roc_auc double").json(f"{path}/holdouts")
    return Trained(ensemble, Meta(rest["intercept"], tuple(rest["weights"])), calibrator, spark.read.json(f"{path}/metrics"), holdouts)
