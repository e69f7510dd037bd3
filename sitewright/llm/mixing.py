"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

A source's schedule gives its weight at training times from 0 to 1, linear between its points. The integral of the
schedule is the share of the source's demand met by a time; its inverse turns the running count of the source's words
into the training position of each document. Documents are then range-sorted by position.

Running counts are made in two steps: each source's documents are dealt into ``parts`` hash parts, the totals of the
parts are accumulated, and documents are accumulated within a part. A source with most of the rows is thus no single
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"

#: For production, in turn by source as the weights are: one source falls away, one rises from nothing, one peaks midway.
SCHEDULES = (
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)),
    ((0.0, 0.0), (0.25, 0.5), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 2.0), (1.0, 0.5)),
)


def shares(sources: DataFrame, total: Column, cap: Column) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``: ``total`` shared by weight, none above its ``cap``.

    Excess over a cap is reshared by weight among the others until none is above. Sources fill up in the order of cap
    over weight, so the result is the level at which the not yet full ones take the rest. Works on one row per source.
    """
    w = Window.orderBy("ratio", "ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("fits", F.col("level") <= F.col("ratio"))
        .withColumn("water", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    full = F.col("water").isNull() | (F.col("ratio") < F.col("water"))
    return levels.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")))


def schedule_position(share: Column, points: Column) -> Column:
    """The time at which a schedule has met ``share`` (0 to 1) of its demand: the inverse of its integral.

    ``points`` is an array of ``struct<t double, w double>`` by rising t from 0 to 1. Within a segment the integral is a
    parabola, solved exactly. A schedule that is zero throughout spreads evenly.
    """
    n = F.size(points)
    pieces = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.element_at(points, i).t.alias("t0"),
            F.element_at(points, i).w.alias("w0"),
            (F.element_at(points, i + 1).t - F.element_at(points, i).t).alias("dt"),
            F.element_at(points, i + 1).w.alias("w1"),
            ((F.element_at(points, i).w + F.element_at(points, i + 1).w) / 2 * (F.element_at(points, i + 1).t - F.element_at(points, i).t)).alias("area"),
        ),
    )
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p.area)

    def step(state, p):
        inside = state.found.isNull() & ((state.left <= p.area) | (p.t0 + p.dt >= 1.0)) & (p.area > 0)
        slope = (p.w1 - p.w0) / p.dt
        left = F.least(state.left, p.area)
        root = F.sqrt(F.greatest(p.w0 * p.w0 + 2 * slope * left, F.lit(0.0)))
        at = p.t0 + F.coalesce(F.try_divide(2 * left, p.w0 + root), F.lit(0.0))  # 0/0 where a schedule starts at weight 0
        return F.struct((state.left - p.area).alias("left"), F.when(inside, at).otherwise(state.found).alias("found"))

    start = F.struct((share * whole).alias("left"), F.lit(None).cast("double").alias("found"))
    found = F.aggregate(pieces, start, step, lambda s: s.found)
    return F.when(whole <= 0, share).otherwise(F.coalesce(found, F.lit(1.0)))


def assign(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share_of_all: float = 1.5,
    most: int = 2,
    schedules: dict[str, list[tuple[float, float]]] | tuple[tuple[tuple[float, float], ...], ...] | None = None,
    parts: int = 1024,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document with what the mix takes of it and where.

    Columns: ``doc_id, size, source_size, target, taken, positions`` (the training positions of its copies, 0 to 1) and
    those named in ``keep``. Size counts runs of characters other than ASCII space and tab to carriage return; a null
    text has none. Sources by code point, null last, have ``weights`` in turn and share ``share_of_all`` times all
    words; a target stops at ``most`` times its source. Documents of a source are taken whole, in an order fixed by
    ``seed``, again from the start after the last, while the middle of the next lies before the target. Documents of no
    words are never taken. Rows that repeat count each. An empty table gives no rows. ``schedules`` gives
    weights over time, by the source's name or, like ``weights``, in turn; without one a weight is even. Other columns of ``docs`` play no part.
    """
    names = {f"kept_{i}": c for i, c in enumerate(keep)}
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("key"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
        *[F.col(c).alias(k) for k, c in names.items()],
    ).withColumn("part", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int") % parts)
    sized = written(base.drop(*names), "sized")
    part_sums = written(sized.groupBy("source", "key", "part").agg(F.sum("size").alias("part_size")), "parts")
    by_source = part_sums.groupBy("source", "key").agg(F.sum("part_size").alias("source_size"))
    ranked = by_source.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")))
    everything = F.sum("source_size").over(Window.partitionBy())
    targets = shares(ranked.withColumn("total", everything * F.lit(share_of_all)), F.col("total"), F.col("source_size") * most)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = part_sums.drop("source").withColumn("before_part", F.coalesce(F.sum("part_size").over(before), F.lit(0).cast("long")))
    ahead = ahead.join(targets.select("key", "ord", "source_size", "target"), "key").drop("part_size")
    # whole texts, if kept, are read again rather than written twice
    within = Window.partitionBy("key", "part").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (base if names else sized).withColumn("before_doc", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    placed = placed.join(ahead, ["key", "part"])
    middle = F.col("before_part") + F.col("before_doc") + F.col("size") / 2
    rounds = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: (F.col("size") > 0) & (middle + k * F.col("source_size") < F.col("target")))
    even = [(0.0, 1.0), (1.0, 1.0)]
    points = lambda p: F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in p])
    plan = points(even)
    if isinstance(schedules, dict):
        for source, p in schedules.items():
            plan = F.when(F.col("source").eqNullSafe(F.lit(source)), points(p)).otherwise(plan)
    elif schedules:
        plan = F.element_at(F.array(*map(points, schedules)), ((F.col("ord") - 1) % len(schedules) + 1).cast("int"))
    share = lambda k: F.least((middle + k * F.col("source_size")) / F.col("target"), F.lit(1.0))
    placed = placed.withColumn("rounds", rounds).withColumn("plan", plan)
    placed = placed.withColumn("positions", F.transform("rounds", lambda k: schedule_position(share(k), F.col("plan"))))
    copies = F.size(F.filter("positions", lambda p: p.isNotNull()))
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        "positions",
        *[F.col(k).alias(c) for k, c in names.items()],
    )


def curriculum(docs: DataFrame, keep: tuple[str, ...], **how) -> DataFrame:
    """A row per copy that the mix takes, with ``keep`` and ``position``, range-sorted by position.

    Kept columns travel with the parts, so there are as many of those (a power of 2, up to 65,536) as give each about
    50,000 rows.
    """
    parts = 1 << min(16, max(10, (docs.count() // 50_000).bit_length()))
    taken = assign(docs, keep=tuple(c for c in keep if c != "doc_id"), **{"parts": parts} | how)
    return taken.withColumn("position", F.explode("positions")).select(*keep, "position").orderBy("position", "doc_id")


def by_position(assigned: DataFrame) -> DataFrame:
    """The rows of ``assign`` with ``position`` and ``position_again``, those of their first and second copy (to nine
    digits, null where there is none), range-sorted by the first; documents that are not taken come last."""
    nth = lambda n: F.round(F.try_element_at("positions", F.lit(n)), 9)
    placed = assigned.withColumn("position", nth(1)).withColumn("position_again", nth(2)).drop("positions")
    return placed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
