"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document with quality weight q gets the exponential key -ln(u)/q, u a keyed hash of its
id; a source's documents sorted by that key are a weighted sample without replacement,
whatever prefix is cut.  A source takes floor(target / size) complete epochs, then the
prefix of its order that fills the rest of its budget.

No source is ever sorted in one task.  Sizes are summed by (source, key range) first; the
prefix sums of these ranges show in which range the budget ends, and only the documents of
that range (about one in ``ranges``) are sorted.  Ranges follow the distribution of the keys: that of
exponentials at the weights that there are, counted by powers of two.

Defined cases: a null text has size 0; a null source is a source, the last one; a null id
hashes as the empty string; a null, negative or NaN quality counts as 1; documents of quality 0 come
last, in random order; rows with equal key and id are taken or left together; an empty table gives an
empty result.  Columns of the input named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written
from .placed import place

HASH_BITS = 52
#: Least weight above 0, and a number that no key reaches at it: -ln(2 ** -52) is below 37.
LEAST_WEIGHT, BEYOND = 2.0**-20, 2.0**26
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Words of a text: each becomes one mark, what is left is measured; null counts 0."""
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x"), r"[\x20\x09-\x0D]++", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def weight(quality: Column) -> Column:
    return F.when(quality.isNull() | F.isnan(quality) | (quality < 0), F.lit(1.0)).otherwise(quality.cast("double"))


def exponential_key(doc_id: Column, quality: Column, seed: str) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    whole = F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")
    u = (whole + 1).cast("double") / F.lit(float(2**HASH_BITS))
    q = weight(quality)
    # Weights below the least one count as it, and keys of weight 0 begin beyond the greatest of the others.
    return F.when(q == 0, F.lit(BEYOND) - F.log(u)).otherwise(-F.log(u) / F.greatest(q, F.lit(LEAST_WEIGHT)))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code-point order take ``weights`` in turn.  The targets share ``share`` times
    all sizes by weight; one above ``most`` times its source's size stops there and the
    excess goes to the others: a water level, found from prefix sums over the sources in the
    order in which they fill up.  One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("full_at", "rank")
    everyone = Window.partitionBy()
    total = F.sum("source_size").over(everyone) * float(share)
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (total - before) / open_weight)
    water = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everyone)
    target = F.coalesce(F.least("cap", water * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def plan_mix(slim: DataFrame, at: Column, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Where each source's order is cut: one row per source, from slim rows (id, source, size, key) in ranges ``at``."""
    ranged = slim.groupBy("source", at.alias("span")).agg(F.sum("size").alias("words"))
    ranged = written(ranged, "mix-ranges")
    goal = targets(ranged.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = written(goal, "mix-targets")

    order = Window.partitionBy("source").orderBy("span")
    upto = ranged.withColumn("upto", F.sum("words").over(order)).withColumnRenamed("source", "ranged_source")
    edge = upto.join(goal, F.col("ranged_source").eqNullSafe(F.col("source")))
    edge = edge.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    edge = written(edge.select("source", "rest", F.col("span").alias("edge"), (F.col("upto") - F.col("words")).alias("base")), "mix-edges")

    near = slim.select(F.col("source").alias("slim_source"), "id", "size", "key", at.alias("span"))
    near = near.join(edge, F.col("slim_source").eqNullSafe(F.col("source")) & (F.col("span") == F.col("edge")))
    near = near.groupBy("source", "rest", "base", "key", "id").agg(F.sum("size").alias("size"))
    through = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("through", through).where(F.col("through") - F.col("size") / 2 <= F.col("rest"))
    last = near.groupBy("source").agg(F.max(F.struct("key", "id")).alias("last"))

    cut = edge.select(F.col("source").alias("edge_source"), "edge").join(
        last.withColumnRenamed("source", "last_source"), F.col("edge_source").eqNullSafe(F.col("last_source")), "left"
    )
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return written(plan.select("source", "source_size", "target", "epochs", "edge", "last"), "mix-plan")


def key_ranges(slim: DataFrame, ranges: int) -> Callable[[Column], Column]:
    """The range of a key, such that ranges hold about equally many rows; keys of weight 0 have ranges of their own."""
    exponent = F.floor(F.log2(F.greatest(F.least("quality", F.lit(2.0**40)), F.lit(LEAST_WEIGHT)))).cast("int")
    counts = slim.where("quality > 0").groupBy(exponent.alias("e")).agg(F.count("*").alias("n")).collect()  # 61 rows at most
    total = sum(r["n"] for r in counts)
    last = F.lit(ranges - 1)

    def at(key: Column) -> Column:
        passed = sum((F.lit(r["n"] / total) * F.exp(-key * float(1.5 * 2.0 ** r["e"])) for r in sorted(counts)), F.lit(0.0))
        beyond = ranges + F.least(F.floor((F.lit(1.0) - F.exp(F.lit(BEYOND) - key)) * ranges), last)
        return F.when(key >= BEYOND, beyond).otherwise(F.least(F.floor((F.lit(1.0) - passed) * ranges), last)).cast("int")

    return at


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    quality: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    ranges: int = 4096,
) -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and taken (units the mix takes, repeats counted).

    size: units of a document, by default the words of ``text``.  quality: sampling weight.
    weights: by source in code-point order, in turn.  share: all targets together, times all
    sizes.  most: bound of a target, times its source's size; no document is taken more than
    that often, rounded up.
    """
    size = word_count(F.col("text")) if size is None else size
    quality = F.lit(1.0) if quality is None else quality
    key = exponential_key(F.col(id_col), quality, seed)
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), weight(quality).alias("quality"))
    slim = written(slim, "mix-slim")
    at = key_ranges(slim, ranges)
    plan = plan_mix(slim, at(F.col("key")), weights, share, most)
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    sized_as, key_as, *named = fresh(docs, "mix__size", "mix__key", *[f"mix__{c}_" for c in plan.columns])
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip(plan.columns, named)])
    plan_source, source_size, target, epochs, edge, last = map(F.col, named)
    sized = docs.select("*", size.alias(sized_as), key.alias(key_as))
    both = sized.join(plan, F.col(source_col).eqNullSafe(plan_source), "left")
    span, here = at(F.col(key_as)), F.struct(F.col(key_as).alias("key"), F.col(id_col).alias("id"))
    times = epochs + F.coalesce(((span < edge) | ((span == edge) & (here <= last))).cast("long"), F.lit(0))
    return both.select(
        *kept,
        F.col(sized_as).alias("size"),
        source_size.alias("source_size"),
        target.alias("target"),
        (F.col(sized_as) * times).alias("taken"),
        times.alias("times"),
    )


def mixture(
    docs: DataFrame, weigh: Callable[[DataFrame], tuple[DataFrame, Column]], *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", most: float = 2.0, **how,
) -> DataFrame:
    """The rows of a mix as it is read: each of ``docs`` as often as it is taken.

    weigh: of slim rows (row, id, source, words), gives these rows with more columns, and the column that is their sampling weight.
    Texts are read twice and copied once; the mix itself is made of the slim rows.
    """
    placed = place(docs, "mix-placed")
    slim = placed.df.select(F.col(placed.row).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("words"))
    slim, quality = weigh(slim)
    slim = written(slim.select("row", "id", "source", "words", quality.alias("quality")), "mix-weighed")
    mixed = mix(slim, id_col="id", source_col="source", size=F.col("words"), quality=F.col("quality"), most=most, **how)
    times = written(mixed.select("row", "times"), "mix-times")
    out, marks = placed.marked(*[times.where(F.col("times") >= n).select("row") for n in range(1, ceil(most) + 1)])
    times_as, copy_as = fresh(out, "mix__times", "mix__copy")
    out = out.withColumn(times_as, sum((m.cast("int") for m in marks), F.lit(0))).where(F.col(times_as) > 0)
    return out.withColumn(copy_as, F.explode(F.sequence(F.lit(1), F.col(times_as)))).select(*docs.columns)
