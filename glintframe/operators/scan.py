"""Scans within keys, where a key may hold any share of the rows.

A key's rows in order are cut into pieces of bounded size; a window never spans more than a piece, and what a piece adds to
those after it (a count, a sum, an affine map) is carried over by a table with a row for each piece of a
large key.  The cuts are quantiles that Spark sketches: they only even out the pieces, results don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one window takes, and how many large keys and cuts there may be at most, whatever the size of the table.
PIECE_ROWS, MOST_PIECES = 100_000, 10_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one near it that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(left: list[Column], right: list[Column]) -> Column:
    """All equal; null equals null."""
    both = F.lit(True)
    for a, b in zip(left, right):
        both = both & a.eqNullSafe(b)
    return both


def number(df: DataFrame, order: Column) -> Column:
    """``order`` as a number that grows with it; null comes first."""
    kind = df.select(order).schema[0].dataType.typeName()
    if kind == "date":
        order = F.unix_date(order)
    elif kind == "timestamp_ntz":  # a day may have no such hour in the session's zone
        order = F.unix_date(order.cast("date")) * 86_400 + F.hour(order) * 3600 + F.minute(order) * 60 + F.extract(F.lit("SECOND"), order)
    return F.coalesce(order.cast("double"), F.lit(float("-inf")))


def cut(df: DataFrame, keys: list[str], order: Column, tie: Column, piece: str, most: int = PIECE_ROWS) -> DataFrame:
    """``df`` with ``piece``: within a key rows of a piece come before those of the next, by ``order`` (a number, date or time, null first), ties by a hash of ``tie``.

    Keys of up to ``most`` rows are one piece.  Large keys are few (at most ``MOST_PIECES``, for which ``most`` grows with the table), so are
    their cuts: both tables are broadcast within that bound.  A value of ``order`` that many rows share is cut by the hash.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"cut__{k}") for k in keys]).agg(F.count("*").alias("cut__n"))
    total = df.count()
    most = max(most, -(-total // MOST_PIECES))
    value = number(df, order)
    names = [F.col(f"cut__{k}") for k in keys]
    large = F.broadcast(sizes.where(F.col("cut__n") > most))  # at most MOST_PIECES rows
    here = same([F.col(k) for k in keys], names)
    # So many quantiles that each piece has about ``most`` rows.
    parts = F.ceil(F.col("cut__n") / most).cast("int")
    own = df.select(*[F.col(k) for k in keys], value.alias("cut__v")).join(large, here).groupBy(*names, "cut__n")
    marks = own.agg(F.percentile_approx("cut__v", [i / 1024 for i in range(1, 1024)], 10_000).alias("cut__marks"))
    step = F.greatest(F.lit(1), F.floor(F.lit(1024) / parts)).cast("int")
    marks = marks.select(*names, F.filter("cut__marks", lambda x, i: (i + 1) % step == 0).alias("cut__marks"))
    joined = df.join(F.broadcast(marks), here, "left")  # at most 2 * MOST_PIECES cuts in all
    below = F.size(F.filter("cut__marks", lambda x: x < value))
    ties = F.size(F.filter("cut__marks", lambda x: x == value))
    at = below + F.when(ties > 1, F.floor(place(tie) * (ties + 1)).cast("int")).otherwise(0)
    return joined.withColumn(piece, F.when(F.col("cut__marks").isNull(), 0).otherwise(at)).drop(*[f"cut__{k}" for k in keys], "cut__marks")


def place(tie: Column) -> Column:
    """A hash between 0 and 1 that orders ties."""
    return F.shiftrightunsigned(F.xxhash64(tie), 11) / F.lit(float(2**53))


def carried(df: DataFrame, keys: list[str], order: Column, tie: Column, sums: dict[str, Column], most: int = PIECE_ROWS, descending: bool = False) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows of its key up to and including this one (``descending``: from this one on)."""
    piece, own_key = fresh(df, "scan__piece"), "scan__own"
    rows = cut(df, keys, order, tie, piece, most)
    value = number(df, order)
    totals = rows.groupBy(*[F.col(k).alias(f"{own_key}_{k}") for k in keys], F.col(piece).alias(f"{own_key}_piece")).agg(*[F.sum(c).alias(f"scan__{name}") for name, c in sums.items()])
    own = [f"{own_key}_{k}" for k in keys]
    by = Window.partitionBy(*own).orderBy(F.desc(f"{own_key}_piece") if descending else F.asc(f"{own_key}_piece"))  # a row for each piece of a key
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*own, f"{own_key}_piece", *[F.sum(f"scan__{n}").over(before).alias(f"scan__{n}") for n in sums], F.row_number().over(by).alias("scan__at"))
    carry = carry.where("scan__at > 1").drop("scan__at")  # pieces of large keys alone: bounded as the cuts are
    inside = [value, place(tie), tie]
    order_by = [c.desc() for c in inside] if descending else [c.asc() for c in inside]
    window = Window.partitionBy(*keys, piece).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"scan_{name}": F.sum(c).over(window) for name, c in sums.items()})
    joined = summed.join(F.broadcast(carry), same([F.col(k) for k in keys], [F.col(c) for c in own]) & (F.col(piece) == F.col(f"{own_key}_piece")), "left")
    done = joined.withColumns({name: F.col(f"scan_{name}") + F.coalesce(F.col(f"scan__{name}"), F.lit(0)) for name in sums})
    return done.drop(piece, f"{own_key}_piece", *own, *[f"scan_{n}" for n in sums], *[f"scan__{n}" for n in sums])


def ranked(df: DataFrame, keys: list[str], order: Column, tie: Column, name: str, most: int = PIECE_ROWS, descending: bool = False) -> DataFrame:
    """``df`` with the place of each row within its key, counted from 1."""
    return carried(df, keys, order, tie, {name: F.lit(1).cast("long")}, most, descending)


def moving_average(df: DataFrame, keys: list[str], order: Column, tie: Column, value: Column, share: float, start: float, most: int = PIECE_ROWS) -> DataFrame:
    """(keys, n, total, average): for each key the end of a <- share * value + (1 - share) * a over its rows in order, from ``start``.

    Each row is an affine map of the average; the maps of a piece are one, by how many rows of the piece come after each, and the pieces' maps
    are composed by how many rows come after each piece.
    """
    piece = fresh(df, "scan__piece")
    rows = cut(df.withColumn(fresh(df, "scan__x"), value.cast("double")), keys, order, tie, piece, most)
    x = fresh(df, "scan__x")
    keep = F.lit(1.0 - share)
    by_order = [c.desc() for c in (number(df, order), place(tie), tie)]
    later = F.row_number().over(Window.partitionBy(*keys, piece).orderBy(*by_order)) - 1
    maps = rows.withColumn("scan__later", later).groupBy(*keys, piece).agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(F.lit(share) * F.pow(keep, F.col("scan__later")) * F.col(x)).alias("scan__moved")
    )
    after = Window.partitionBy(*keys).orderBy(F.desc(piece)).rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a key
    maps = maps.withColumn("scan__after", F.coalesce(F.sum("n").over(after), F.lit(0)))
    done = maps.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("scan__moved") * F.pow(keep, F.col("scan__after"))).alias("scan__moved"))
    return done.select(*keys, "n", "total", (F.col("scan__moved") + F.lit(start) * F.pow(keep, F.col("n"))).alias("average"))


