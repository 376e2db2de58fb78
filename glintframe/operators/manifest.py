"""Manifests of labelled files: classify, validate, deduplicate, split, exclude."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
FAKE_HINTS = ("fake", "synthetic", "generated", "sd", "sdxl", "vqgan", "midjourney", "flux", "gan")
#: Looked for in this order in a path part.
GENERATORS = ("sdxl", "sd15", "sd1.5", "sd", "vqgan", "midjourney", "flux", "gan", "cifake")
REAL_LABELS, FAKE_LABELS = ("real", "0", "authentic", "camera"), ("ai", "fake", "1", "generated-ai")
REQUIRED = ("image_path", "label")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def path_label(path: Column) -> Column:
    """1 if any part of the path contains a hint of generated images."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda t: t != "")
    return F.exists(parts, lambda t: reduce(or_, [t.contains(h) for h in FAKE_HINTS])).cast("int")


def path_generator(path: Column) -> Column:
    """The first generator that the last part to name one contains; cifake wins over all."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda t: t != "")

    def named(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for g in reversed(GENERATORS):
            out = F.when(t.contains(g), g).otherwise(out)
        return out

    names = F.filter(F.transform(parts, named), lambda g: g.isNotNull())
    last = F.when(F.size(names) > 0, F.element_at(names, -1)).otherwise("unknown")
    return F.when(F.array_join(parts, " ").contains("cifake"), "cifake").otherwise(last)


def normal_label(label: Column) -> Column:
    """0 or 1 from words or numbers; null for others."""
    word = F.lower(F.trim(label))
    return F.when(word.isin(*REAL_LABELS), 0).when(word.isin(*FAKE_LABELS), 1).otherwise(word.try_cast("double").cast("int"))


def parse_ai(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return (
        F.when(word == "", F.lit(None).cast("boolean")).when(word.isin("1", "true", "yes", "ai"), True).when(word.isin("0", "false", "no", "real"), False)
        .otherwise(word.try_cast("double").cast("int") != 0)
    )


def validate(df: DataFrame) -> DataFrame:
    """A manifest with rows that lack path or label dropped; raises unless its labels are exactly 0 and 1."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"manifest lacks {missing}")
    clean = df.dropna(subset=list(REQUIRED)).withColumn("label", F.col("label").cast("int"))
    labels = {r["label"] for r in clean.select("label").distinct().limit(3).collect()}
    if labels != {0, 1}:
        raise ValueError(f"labels must be 0 and 1, found {sorted(labels)}")
    return clean


def fallback(*columns: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns])


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first; combined before the shuffle."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("row"))
    return first.select(key, "row.*").select(*df.columns)


def upsert_keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, at the place of the first."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("row"), F.min(order).alias("position"))
    return last.select(key, "row.*", "position")


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``split`` by stratum: max(1, floor(share n)) rows to val, as many to test, the rest to train.

    The order within a stratum is a hash of the key.
    """
    # The exact sizes need ranks; these are taken by hash range, so no stratum is sorted whole.
    bucket = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(256))
    rows = df.withColumns({"split__hash": F.xxhash64(key, F.lit(seed)), "split__bucket": bucket})
    sums = rows.groupBy(*strata, "split__bucket").agg(F.count("*").alias("split__n"))
    order = Window.partitionBy(*strata).orderBy("split__bucket")
    base = sums.select(
        *strata, "split__bucket",
        (F.sum("split__n").over(order) - F.col("split__n")).alias("split__before"), F.sum("split__n").over(Window.partitionBy(*strata)).alias("split__total"),
    )
    inside = Window.partitionBy(*strata, "split__bucket").orderBy("split__hash", key)
    ranked = rows.withColumn("split__rank", F.row_number().over(inside)).join(base, [*strata, "split__bucket"])
    place = F.col("split__rank") + F.col("split__before")
    part = F.greatest(F.lit(1), F.floor(F.col("split__total") * share))
    split = F.when(place <= part, "val").when(place <= part * 2, "test").otherwise("train")
    return ranked.select(*df.columns, split.alias("split"))


def union_manifests(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def exclude(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Rows of ``train`` whose path the holdout lacks."""
    return train.join(holdout.select(normal_path(F.col(key)).alias("held")).distinct(), normal_path(F.col(key)) == F.col("held"), "left_anti")


def overlap(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return train.join(holdout.select(F.col(key).alias("held")).distinct(), F.col(key) == F.col("held"), "left_semi")


def hamming_pairs(hashes: DataFrame, key: str, value: str, distance: int = 4, bits: int = 64) -> DataFrame:
    """Pairs (a, b), a < b, whose hashes differ in up to ``distance`` bits: they share one of distance + 1 segments."""
    parts = distance + 1
    edges = [bits * i // parts for i in range(parts + 1)]
    segments = [
        F.struct(F.lit(i).alias("place"), F.shiftrightunsigned(F.col(value), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    cut = hashes.select(F.col(key).alias("id"), F.col(value).alias("hash"), F.explode(F.array(*segments)).alias("segment"))
    a, b = cut.select(F.col("id").alias("a"), F.col("hash").alias("hash_a"), "segment"), cut.select(F.col("id").alias("b"), F.col("hash").alias("hash_b"), "segment")
    apart = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    near = a.join(b, "segment").where((F.col("a") < F.col("b")) & (apart <= distance))
    return near.select("a", "b", apart.alias("distance")).distinct()


def greedy_keep(ids: DataFrame, pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Rows in ``order``, each kept unless near a row kept before: the exact greedy result, by rounds.

    A round keeps rows that have no undecided earlier neighbour, then drops their later neighbours; it decides one row
    at least, so the rounds end with the last edge.
    """
    spark = ids.sparkSession
    rank = ids.select(F.col(key).alias("id"), F.col(order).alias("at"))
    at = lambda c: rank.select(F.col("id").alias(c), F.col("at").alias(f"at_{c}"))
    both = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b")
    first = F.struct("at_a", "a") < F.struct(F.col("at_b").alias("at_a"), F.col("b").alias("a"))
    edges = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")).checkpoint()
    dropped = spark.createDataFrame([], edges.select(F.col("late").alias("id")).schema)
    while not edges.isEmpty():
        waiting = edges.select(F.col("late").alias("early")).distinct()
        keepers = edges.select("early").distinct().join(waiting, "early", "left_anti")
        gone = edges.join(keepers, "early", "left_semi").select(F.col("late").alias("id")).distinct().checkpoint()
        dropped = dropped.unionByName(gone).checkpoint()
        edges = edges.join(gone.withColumnRenamed("id", "early"), "early", "left_anti").join(gone.withColumnRenamed("id", "late"), "late", "left_anti")
        edges = edges.select("early", "late").checkpoint()
    return ids.join(dropped.select(F.col("id").alias("dropped")), F.col(key) == F.col("dropped"), "left_anti")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` by hash within each label: about equal sizes, no sort."""
    return df.withColumn("fold", F.pmod(F.xxhash64(label, key, F.lit(seed)), F.lit(k)).cast("int"))


def path_stem(path: Column) -> Column:
    """The file's name without its last ending."""
    name = F.element_at(F.split(normal_path(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def path_parent(path: Column) -> Column:
    """The name of the folder that the file lies in, empty without one."""
    parts = F.split(normal_path(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
