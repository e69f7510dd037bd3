"""Small column functions that many operators share: rounding rules, ramps, quantile rules, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): how grades and cell numbers are rounded. Half-even rounding, as for rasters, is ``F.bround``."""
    return F.floor(x + F.lit(0.5))


def r4(x: Column) -> Column:
    """Four decimals, by ``half_up``: a form in which two engines agree bit by bit."""
    return half_up(x * F.lit(1e4)) / F.lit(1e4)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ramp(v: Column, start: Column | float, end: Column | float) -> Column:
    """0 at ``start``, 1 at ``end``, linear between and flat beyond."""
    start, end = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    return clamp01((v - start) / (end - start))


def finite(x: Column) -> Column:
    """NaN and infinities as null, so that they never win a maximum or an order."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def value_at_rank(rows: DataFrame, key: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``key``, ``n`` and, for each name in ``ranks``, the value at that 0-based index (a function of n) of the ascending
    values of a group.

    Equal values are counted first, so that a group is a running sum over its distinct values, sorted and spilled by the
    window, and never an array.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_k"))
    own = Window.partitionBy(*key)
    run = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"_to": F.sum("_k").over(run), "_n": F.sum("_k").over(own)})
    at = [F.min(F.when(F.col("_to") > rank(F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy(*key).agg(F.first("_n").alias("n"), *at)


def medians(rows: DataFrame, key: list[str], value: str, buckets: int = 1024, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, m, n``: the exact median (the mean of the two middle values where n is even) of each group's values that are not
    null, also without a key.

    The range of a group is counted in ``buckets``; only the values of the one or two buckets that hold the middle are
    ranked. So a group with most of the rows is counts from every task, and what is sorted is a small part of it.

    With ``save``, what is known of groups is written before rows meet it. Its size is then known when the join is planned,
    and where groups are few no row is shuffled for it; else Spark has sent all rows by key before it sees how few they are.
    """
    save = save or (lambda df: df)
    known = rows.select(*key, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    join = lambda a, b: a.join(b, key) if key else a.join(F.broadcast(b))  # noqa: E731  without a key, one row
    ends = save(known.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n")))
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    placed = join(known, ends).withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.coalesce(share, F.lit(0.0)) * buckets)).cast("int"))
    counts = placed.groupBy(*key, "_b").agg(F.count("*").alias("_k"), F.first("n").alias("n"))
    upto = F.sum("_k").over(Window.partitionBy(*key).orderBy("_b"))  # of ``buckets`` rows at most
    counts = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_k"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_upto"))
    middle = save(counts.filter(holds(low) | holds(high)).groupBy(*key).agg(F.min("_b").alias("_from"), F.max("_b").alias("_to"), F.min("_before").alias("_start"), F.first("n").alias("_n")))
    near = join(placed.drop("_lo", "_hi", "n"), middle).filter((F.col("_b") == F.col("_from")) | (F.col("_b") == F.col("_to")))
    several = near.groupBy(*key, "_v").agg(F.count("*").alias("_k"), F.first("_start").alias("_start"), F.first("_n").alias("n"))
    run = F.col("_start") + F.sum("_k").over(Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = several.withColumn("_run", run)
    first = lambda rank: F.min(F.when(F.col("_run") > rank, F.col("_v")))
    return ranked.groupBy(*key).agg(((first(low) + first(high)) / 2).alias("m"), F.first("n").alias("n"))


def nth_value(values: Column, index: Column) -> Column:
    """The value at a 0-based index of the ascending values of a group."""
    return F.element_at(F.array_sort(values), index.cast("int") + 1)


def lower_rank(values: Column, p: float) -> Column:
    """The value at index floor(p (n - 1))."""
    return nth_value(values, F.floor(F.lit(p) * (F.size(values) - 1)))


def upper_median(values: Column) -> Column:
    """The value at index n // 2."""
    return nth_value(values, F.floor(F.size(values) / 2))


def share_rank(values: Column, p: float) -> Column:
    """The value at index floor(n p)."""
    return nth_value(values, F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def pmod(x: Column, m: float) -> Column:
    return F.pmod(x, F.lit(float(m)))


def angle_between(a: Column, b: Column | float) -> Column:
    """a - b in degrees, wrapped to [-180, 180)."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return pmod(a - b + F.lit(180.0), 360.0) - F.lit(180.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def lookup_curve(points: Column, x: Column) -> Column:
    """Piecewise linear through ``array<struct<d, f>>`` sorted by d; the end values hold beyond the ends."""
    n = F.size(points)
    inside = F.filter(
        F.sequence(F.lit(1), n - 1),
        lambda i: (F.element_at(points, i)["d"] <= x) & (x <= F.element_at(points, i + 1)["d"]),
    )
    i = F.element_at(inside, 1)
    a, b = F.element_at(points, i), F.element_at(points, i + 1)
    between = a["f"] + (b["f"] - a["f"]) * (x - a["d"]) / (b["d"] - a["d"])
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(x <= first["d"], first["f"]).when(x >= last["d"], last["f"]).otherwise(between)


def argmax_class(values: Column) -> Column:
    """Index of the first maximum; null where all are zero (unknown)."""
    top = F.array_max(values)
    return F.when(top > 0, F.array_position(values, top) - 1)
