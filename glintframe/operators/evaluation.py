"""Classifier evaluation as aggregations: curves, calibration, slices, gates, drift.

Curves need prefix sums over all scores in order.  They are taken over distinct scores, after
the rows of a score were counted; where these may still be many, ``prefix_counts`` sorts by
range, sums each range, and adds what lies in the ranges before: no task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions.numeric import clip, lit, ratio
from glintframe.operators import scan
from glintframe.session import stored

#: Metric -> (more is better, allowed change for the worse).
DRIFT = {"accuracy": (True, 0.02), "f1": (True, 0.02), "roc_auc": (True, 0.01), "ece": (False, 0.05), "fpr_at_threshold": (False, 0.01)}
LATENCY_FACTOR = 1.5
PARTS = 64


def outcome_sums(pred: Column, y: Column | None = None) -> list[Column]:
    hit, real = pred.cast("int"), (F.col("y") if y is None else y).cast("int")
    return [
        F.sum(hit * real).alias("tp"), F.sum(hit * (1 - real)).alias("fp"), F.sum((1 - hit) * real).alias("fn"), F.sum((1 - hit) * (1 - real)).alias("tn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "specificity": ratio(tn, tn + fp),
    })


def binary_metrics(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    return rates(df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *outcome_sums(F.col("p") >= threshold)))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    pred = (F.col("p") >= threshold).cast("int")
    return df.groupBy("y", pred.alias("pred")).agg(F.count("*").alias("n"))


def state_rollup(df: DataFrame, threshold: float) -> DataFrame:
    """Outcomes by state and, with a null state, in total: one pass."""
    return rates(df.rollup("state").agg(F.count("*").alias("n"), *outcome_sums(F.col("p") >= threshold)))


def score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return df.groupBy("p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def prefix_counts(counts: DataFrame, parts: int = PARTS) -> DataFrame:
    """``counts`` with tp and fp, the positives and negatives at or above each score, and pos_next and neg_next of the next lower score."""
    ranged = counts.repartitionByRange(parts, F.desc("p")).withColumn("part", F.spark_partition_id())
    top = F.max_by(F.struct("pos", "neg"), "p")
    sums = ranged.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), top.alias("top"))
    order = Window.orderBy("part")  # as many rows as parts
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("part").alias("own"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("pos_before"), F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("neg_before"),
        F.lead("top").over(order).alias("follows"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("p"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto), "next": F.lead(F.struct("pos", "neg")).over(inside)})
    joined = summed.join(F.broadcast(base), F.col("part") == F.col("own"))  # ``parts`` rows
    return joined.select(
        "p", "pos", "neg", (F.col("tp") + F.col("pos_before")).alias("tp"), (F.col("fp") + F.col("neg_before")).alias("fp"),
        F.coalesce(F.col("next.pos"), F.col("follows.pos")).alias("pos_next"), F.coalesce(F.col("next.neg"), F.col("follows.neg")).alias("neg_next"),
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return prefix_counts(counts).crossJoin(F.broadcast(totals))  # one row


def roc_curve(df: DataFrame) -> DataFrame:
    """The corners of the curve, from (0, 0) at an infinite threshold on: scores between which it runs straight are left out."""
    full = _with_totals(score_counts(df))
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    bends = first | F.col("pos_next").isNull() | (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    points = full.where(bends).select(F.col("p").alias("threshold"), ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))
    return points.unionByName(df.sparkSession.sql("SELECT double('inf') AS threshold, 0D AS fpr, 0D AS tpr"))


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score, and the end point (1, 0) without a threshold."""
    full = _with_totals(score_counts(df))
    points = full.select(F.col("p").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))
    return points.unionByName(df.sparkSession.sql("SELECT double(NULL) AS threshold, 1D AS precision, 0D AS recall"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney with ties counted half; 0.5 if a class is missing."""
    full = _with_totals(score_counts(df))
    # Each positive beats the negatives below it: all less those at or above, and half of its ties.
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    pairs = F.max("all_pos") * F.max("all_neg")
    return full.agg(ratio(wins, pairs, 0.5).alias("roc_auc"))


def fpr_threshold(df: DataFrame, target: float) -> DataFrame:
    """The smallest score with a false-positive rate up to ``target``, 0.5 at most; without negatives the lowest score."""
    full = _with_totals(score_counts(df))
    fits = F.when((F.col("all_neg") == 0) | (ratio(F.col("fp"), F.col("all_neg")) <= target), F.col("p"))
    return full.agg(F.min(fits).alias("unclamped"), F.least(F.coalesce(F.min(fits), lit(0.5)), lit(0.5)).alias("threshold"))


def threshold_descending(df: DataFrame, target: float) -> DataFrame:
    """Walks scores downwards until the rate exceeds ``target``: the last score before."""
    full = _with_totals(score_counts(df))
    return full.agg(F.min(F.when(ratio(F.col("fp"), F.col("all_neg")) <= target, F.col("p"))).alias("threshold"))


def calibration_bins(df: DataFrame, bins: int, closed: bool) -> DataFrame:
    """Bins [lo, hi); p = 1 belongs to the last one only if ``closed``, else to none."""
    at = F.floor(F.col("p") * bins)
    binned = df.withColumn("bin", F.least(at, F.lit(bins - 1)) if closed else at)
    grouped = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    return grouped if closed else grouped.where(F.col("bin") < bins)


def calibration_error(df: DataFrame, bins: int = 15, closed: bool = False) -> DataFrame:
    """Expected calibration error over all rows, those in no bin included in the count."""
    gaps = calibration_bins(df, bins, closed).agg(F.sum(F.abs(F.col("mean_p") - F.col("mean_y")) * F.col("n")).alias("gap"))
    return df.agg(F.count("*").alias("n")).crossJoin(gaps).select("n", ratio(F.coalesce("gap", lit(0.0)), F.col("n")).alias("ece"))  # one row each


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("brier"))


def temperature_scaled(p: Column, ece: Column) -> Column:
    """The logit divided by 1 + 2 ece; 0 and 1 stay."""
    return F.when((p <= 0) | (p >= 1), p).otherwise(lit(1.0) / (lit(1.0) + F.exp(-F.log(p / (lit(1.0) - p)) / (lit(1.0) + lit(2.0) * ece))))


def resolution_bucket(width: Column, height: Column) -> Column:
    least = F.least(width, height)
    return F.when(least < 512, "small").when(least >= 1024, "large").otherwise("medium")


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """Interpolated median, 95th and 99th percentile."""
    return exact_percentiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def holdout_gate(df: DataFrame, threshold: float, most_fpr: float = 0.02, least_recall: float = 0.8) -> DataFrame:
    return binary_metrics(df, threshold).select("n", "fpr", "recall", ((F.col("fpr") <= most_fpr) & (F.col("recall") >= least_recall)).alias("passed"))


def drift(history: DataFrame, order: str) -> DataFrame:
    """The last two entries of ``history`` compared, one row per metric both have: whether it got worse than allowed."""
    last = history.orderBy(F.desc(order)).limit(2).withColumn("place", F.row_number().over(Window.orderBy(F.desc(order))))  # two rows
    metrics = [*DRIFT, "latency_p95"]
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = last.selectExpr("place", f"stack({len(metrics)}, {pairs}) as (metric, value)")
    both = long.groupBy("metric").agg(F.max(F.when(F.col("place") == 2, F.col("value"))).alias("base"), F.max(F.when(F.col("place") == 1, F.col("value"))).alias("current"))
    delta, worse = F.col("current") - F.col("base"), F.lit(False)
    for metric, (up, allowed) in DRIFT.items():
        worse = F.when(F.col("metric") == metric, delta < -allowed if up else delta > allowed).otherwise(worse)
    worse = F.when(F.col("metric") == "latency_p95", (F.col("base") > 0) & (F.col("current") > F.col("base") * LATENCY_FACTOR)).otherwise(worse)
    return both.where("base is not null and current is not null").select("metric", "base", "current", worse.alias("regressed"))


def meta_gate(df: DataFrame, meta: str, avg: str, margin: float = 0.005) -> DataFrame:
    """Whether the meta-learner's AUC beats the average's by ``margin``."""
    a = roc_auc(df.withColumn("p", F.col(meta))).withColumnRenamed("roc_auc", "meta_auc")
    b = roc_auc(df.withColumn("p", F.col(avg))).withColumnRenamed("roc_auc", "average_auc")
    return a.crossJoin(b).withColumn("keep_meta", F.col("meta_auc") >= F.col("average_auc") + margin)  # one row each


def mutual_information(df: DataFrame, feature: str, bins: int = 16) -> DataFrame:
    """Between a feature in equal-width bins and the label, in nats."""
    edges = df.agg(F.min(feature).alias("low"), F.max(feature).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(feature) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    cells = df.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin"), "y").agg(F.count("*").alias("n"))  # one row
    n, x, y = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.partitionBy("bin")), F.sum("n").over(Window.partitionBy("y"))
    parts = cells.select((F.col("n") / n * F.log(F.col("n") * n / (x * y))).alias("part"))  # bins x 2 rows
    return parts.agg(clip(F.sum("part"), 0.0, float("inf")).alias("mutual_information"))


def long_metrics(df: DataFrame, part: str, key: Column, metrics: list[str]) -> DataFrame:
    """A wide row for each key as rows (part, key, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), F.inline(pairs))


def evaluation_report(df: DataFrame, target: float, latencies: DataFrame) -> DataFrame:
    """One evaluation as rows (part, key, metric, value): threshold at the target error rate, rates, AUC, calibration, slices, latencies.

    df: y, p, generator, width, height.  latencies: one column.  The rows are read once, into counts for
    each score and slice; all else is made of these counts.
    """
    bucket = resolution_bucket(F.col("width"), F.col("height"))
    cells = df.groupBy("p", F.coalesce(F.col("generator"), F.lit("unknown")).alias("generator"), bucket.alias("bucket"))
    cells = cells.agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    full = _with_totals(cells.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    fits = F.when((F.col("all_neg") == 0) | (ratio(F.col("fp"), F.col("all_neg")) <= target), F.col("p"))
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    curve = full.agg(F.least(F.coalesce(F.min(fits), lit(0.5)), lit(0.5)).alias("threshold"), ratio(wins, F.max("all_pos") * F.max("all_neg"), 0.5).alias("roc_auc"))
    hit = (F.col("p") >= F.col("threshold")).cast("long")
    outcomes = [F.sum(hit * F.col("pos")).alias("tp"), F.sum(hit * F.col("neg")).alias("fp"), F.sum((1 - hit) * F.col("pos")).alias("fn"), F.sum((1 - hit) * F.col("neg")).alias("tn")]
    judged = cells.crossJoin(F.broadcast(curve))  # one row
    sets = judged.groupingSets([[], [F.col("generator")], [F.col("bucket")]], F.col("generator"), F.col("bucket"))
    sets = rates(sets.agg(F.grouping_id().alias("level"), F.sum(F.col("pos") + F.col("neg")).alias("n"), *outcomes))
    ece_of = F.sum(F.col("pos") + F.col("neg"))
    bins = cells.groupBy(F.floor(F.col("p") * 15).alias("bin")).agg(ece_of.alias("n"), F.sum(F.col("p") * (F.col("pos") + F.col("neg"))).alias("mass"), F.sum("pos").alias("pos"))
    gap = F.sum(F.when(F.col("bin") < 15, F.abs(F.col("mass") - F.col("pos"))))
    calibration = bins.agg(ratio(F.coalesce(gap, lit(0.0)), F.sum("n")).alias("ece"))
    whole = ["n", "accuracy", "precision", "recall", "f1", "fpr", "tp", "fp", "fn", "tn"]
    parts = [
        long_metrics(sets.where("level = 3"), "overall", F.lit(""), whole),
        long_metrics(curve, "overall", F.lit(""), ["threshold", "roc_auc"]),
        long_metrics(calibration, "overall", F.lit(""), ["ece"]),
        long_metrics(sets.where("level = 1"), "generator", F.col("generator"), ["n", "accuracy", "f1"]),
        long_metrics(sets.where("level = 2"), "resolution", F.col("bucket"), ["n", "accuracy", "f1"]),
        long_metrics(latency_percentiles(latencies, latencies.columns[0]), "latency", F.lit(""), ["p50", "p95", "p99"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).unionByName(parts[5])


def calibration_report(df: DataFrame, before: str, after: str, bins: int = 15) -> DataFrame:
    """ECE and Brier score of two scores of the same rows, in one pass."""
    both = df.select("y", F.inline(F.array(F.struct(F.lit("before").alias("stage"), F.col(before).alias("p")), F.struct(F.lit("after").alias("stage"), F.col(after).alias("p")))))
    cells = both.groupBy("stage", F.floor(F.col("p") * bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("a"), F.avg("y").alias("h"), F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("loss")
    )
    gap = F.sum(F.when(F.col("bin") < bins, F.abs(F.col("a") - F.col("h")) * F.col("n")))
    return cells.groupBy("stage").agg(ratio(F.coalesce(gap, lit(0.0)), F.sum("n")).alias("ece"), ratio(F.sum("loss"), F.sum("n")).alias("brier"))


def worst_holdout(runs: DataFrame) -> DataFrame:
    """Of leave-one-out runs (generator, roc_auc) the worst, least name first; a null name is "unknown"."""
    name = F.coalesce(F.col("generator"), F.lit("unknown"))
    return runs.agg(F.min(F.struct(F.col("roc_auc"), name.alias("generator"))).alias("worst")).select("worst.generator", "worst.roc_auc")


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """Linearly interpolated percentiles: values are ranked by range, so that no task or aggregate holds them all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ``parts`` rows
    base = F.broadcast(sums.select(F.col("part").alias("own"), before.alias("before"), F.sum("all").over(Window.partitionBy()).alias("total")))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("upto", upto).join(base, F.col("part") == F.col("own"))
    last = F.col("before") + F.col("upto")  # ranks from last - n to last - 1
    found = []
    for name, share in shares.items():
        at = lit(share) * (F.col("total") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.max(F.when((rank >= last - F.col("n")) & (rank < last), F.col("v"))).alias(f"{name}_{end}"))
        found.append(F.max(at - F.floor(at)).alias(f"{name}_part"))
    ends = ranked.agg(*found)
    return ends.select(*[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares])


def roc_auc_by(df: DataFrame, key: str) -> DataFrame:
    """AUC of each key; 0.5 where a class is missing.  The distinct scores of a key are summed in pieces of bounded size."""
    counts = df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key), "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counts = stored(counts, "score-counts")
    upto = scan.carried(counts, [key], F.col("p"), F.col("p"), {"upto": F.col("neg")})
    wins = upto.select(key, "pos", "neg", (F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("wins"))
    return wins.groupBy(key).agg(ratio(F.sum("wins"), F.sum("pos") * F.sum("neg"), 0.5).alias("roc_auc"))


def kind_by_prefix(name: Column, proxies: tuple[str, ...]) -> Column:
    """``proxy`` for names that begin with one of these, else ``genuine``."""
    hit = F.lit(False)
    for prefix in proxies:
        hit = hit | name.startswith(prefix)
    return F.when(hit, "proxy").otherwise("genuine")
