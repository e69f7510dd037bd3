"""Operators on point clouds: cell statistics by the six quantile rules, thinning, fliers, pruning, visibility, lifting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import medians, value_at_rank

#: The value at index n // 2, as ``m``.
UPPER_MEDIAN = {"m": lambda n: F.floor(n / 2)}


def cell(x: str | Column, size: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / F.lit(size)).cast("long")


def in_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})


def cell_means(points: DataFrame, size: float) -> DataFrame:
    return in_cells(points, size).groupBy("cx", "cy").agg(F.avg("z").alias("mean"), F.count("*").alias("n"))


def surface_heights(points: DataFrame, size: float, least: int = 4) -> DataFrame:
    """The value at index floor(0.8 (n-1)) of each cell with at least ``least`` points."""
    heights = value_at_rank(in_cells(points, size), ["cx", "cy"], "z", {"height": lambda n: F.floor(F.lit(0.8) * (n - 1))})
    return heights.filter(F.col("n") >= least).select("cx", "cy", "height", "n")


def ground_misfit(points: DataFrame, size: float = 1.0, least: int = 20) -> DataFrame:
    """16th, 50th and 84th percentile (linear) of the upper medians of cells with enough points."""
    medians = value_at_rank(in_cells(points, size), ["cx", "cy"], "z", UPPER_MEDIAN).filter(F.col("n") >= least)
    p = F.percentile("m", F.array(*[F.lit(q) for q in (0.16, 0.5, 0.84)]))
    return medians.agg(p.alias("p"), F.count("*").alias("cells")).select(
        F.col("p")[0].alias("p16"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p84"), "cells"
    )


def weighted_ground(points: DataFrame, size: float, share: float = 0.3, tie: tuple[str, ...] = ()) -> DataFrame:
    """Per cell the first height whose running weight reaches ``share`` of the cell's weight."""
    own = Window.partitionBy("cx", "cy")
    run = own.orderBy("z", "w", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = in_cells(points, size).withColumns({"run": F.sum("w").over(run), "total": F.sum("w").over(own)}).filter(F.col("run") >= share * F.col("total"))
    return reached.groupBy("cx", "cy").agg(F.min("z").alias("ground"))


def roughness(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Points with the population deviation of z in their cell."""
    own = Window.partitionBy("cx", "cy")
    return in_cells(points, size).withColumn("roughness", F.stddev_pop("z").over(own))


def without_fliers(points: DataFrame, size: Column, tolerance: Column, least: int = 4) -> DataFrame:
    """Points within ``tolerance`` of the upper median of their cell; cells with fewer than ``least`` points keep all."""
    keyed = points.withColumns({"_size": size, "_tol": tolerance}).withColumns({"cx": F.floor(F.col("x") / F.col("_size")), "cy": F.floor(F.col("y") / F.col("_size"))})
    key = ["_size", "cx", "cy"]
    medians = value_at_rank(keyed, key, "z", UPPER_MEDIAN).select(*key, F.when(F.col("n") >= least, F.col("m")).alias("_m"))
    near = keyed.join(medians, key)
    return near.filter(F.col("_m").isNull() | (F.abs(F.col("z") - F.col("_m")) <= F.col("_tol"))).drop("_size", "_tol", "cx", "cy", "_m")


def first_per_voxel(points: DataFrame, size: Column, order: list[str]) -> DataFrame:
    """One point, the first by ``order``, of each voxel; the voxel may grow with range."""
    keyed = points.withColumn("_size", size).withColumns({f"_{a}": F.floor(F.col(a) / F.col("_size")) for a in "xyz"})
    first = Window.partitionBy("_size", "_x", "_y", "_z").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_size", "_x", "_y", "_z")


def named_predicates(rows: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every test, one row with how many pass each). A null test counts as failed."""
    marked = rows.withColumns({f"_{k}": F.coalesce(t, F.lit(False)) for k, t in tests.items()})
    report = marked.agg(*[F.sum(F.col(f"_{k}").cast("long")).alias(k) for k in tests], F.count("*").alias("rows"))
    every = F.lit(True)
    for k in tests:
        every = every & F.col(f"_{k}")
    return marked.filter(every).drop(*[f"_{k}" for k in tests]), report


def without_blurred(points: DataFrame, close: Column, share: float) -> DataFrame:
    """Points that are not close, and close ones with at least a share of the close ones' median z."""
    middle = medians(points.filter(close), [], "z").select(F.col("m").alias("_m"))
    middle = points.sparkSession.range(1).join(middle, how="left").select("_m")  # one row, null where nothing is close
    return points.join(F.broadcast(middle)).filter(~close | (F.col("z") >= share * F.col("_m"))).drop("_m")  # one row


def running_weight(points: DataFrame, key: list[str], order: list[str], weight: Column) -> DataFrame:
    """Points with ``run``: the weight so far in their cell, by ``order``."""
    return points.withColumn("run", F.sum(weight).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def path_lengths(points: DataFrame, key: list[str], order: list[str], axes: tuple[str, ...] = ("x", "y"), ends: DataFrame | None = None) -> DataFrame:
    """``key, points, length``: steps between neighbours by ``order``, summed, in as many dimensions as there are ``axes``.

    ``ends(key, from_x, .., to_x, ..)``, a row a path, has the exact places that stand for its first and its last point; of
    a path of one point, the last. Where a path has no row, or a place no number, its own point counts.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    if ends is not None:
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        points = points.withColumns({"_first": first, "_last": last}).join(ends, key, "left")
        put = lambda a: F.when(F.col("_last"), F.coalesce(f"to_{a}", a)).when(F.col("_first"), F.coalesce(f"from_{a}", a)).otherwise(F.col(a))
        points = points.select(*key, *order, *[put(a).alias(f"_{a}") for a in axes])
        axes = tuple(f"_{a}" for a in axes)
    d = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes), F.lit(0.0)))
    return points.withColumn("_d", d).groupBy(*key).agg(F.count("*").alias("points"), F.sum("_d").alias("length"))


def correlation(rows: DataFrame, key: list[Column], a: str, b: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))


def median_colour(rows: DataFrame, key: list[Column], channels: dict[str, str]) -> DataFrame:
    """The median of each channel, separately. Keys are not null."""
    named = rows.select(*key, *channels.values())
    names = named.columns[: len(key)]
    out = None
    for name, c in channels.items():
        own = medians(named, names, c).select(*names, F.col("m").alias(name))
        out = own if out is None else out.join(own, names, "full")
    return out


def scaled_to_range(rows: DataFrame, key: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows with ``share``, the value between those at two ranks of its series as 0 to 1; 0.5 where they are equal."""
    from ..functions.maths import clamp01

    rank = lambda p: lambda n: F.least(F.floor(n * F.lit(p)), n - F.lit(1))
    ends = value_at_rank(rows, key, value, {"_lo": rank(low), "_hi": rank(high)}).drop("n")
    share = F.when(F.col("_hi") > F.col("_lo"), clamp01((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(0.5)
    return rows.join(ends, key).withColumn("share", share).drop("_lo", "_hi")


def rotated(points: DataFrame, r: list[list[float]]) -> DataFrame:
    """``points(.., x, y, z, quat)`` turned by a rotation: places, and orientations (w, x, y, z, scaled to unit length).

    Where they have ``rest``, the first band of a colour's harmonics, it turns as well: three numbers a channel, which
    weigh -y, z and -x of the direction one looks in; nine in all, or none. More bands are an error.
    """
    from .frames import turned

    xyz = {a: sum((F.lit(float(r[i][j])) * F.col("xyz"[j]) for j in range(3)), F.lit(0.0)) for i, a in enumerate("xyz")}
    out = points.withColumns({**xyz, "quat": turned(r, F.col("quat"))})
    if "rest" not in points.columns:
        return out
    # a channel's weights as a vector, turned, and as weights again
    sign, axis = (-1.0, 1.0, -1.0), (1, 2, 0)
    place = {a: k for k, a in enumerate(axis)}
    weights = [F.lit(float(sign[k] * r[axis[k]][j] * sign[place[j]])) * F.col("rest")[3 * c + place[j]].cast("double") for c in range(3) for k in range(3) for j in range(3)]
    made = F.array(*[weights[n] + weights[n + 1] + weights[n + 2] for n in range(0, 27, 3)])
    size = F.size("rest")
    return out.withColumn("rest", F.when(size == 9, made).when(size == 0, F.col("rest").cast("array<double>")).otherwise(F.raise_error(F.lit("only the first band of harmonics can be turned")).cast("array<double>")))


def multi_view_mean(views: DataFrame, values: list[str], weight: Column, by_own_sum: bool) -> DataFrame:
    """``idx`` with weighted means over views, the weight and the number of views.

    Class shares are divided by their own sum (``by_own_sum``), other vectors by the weight.
    """
    sums = views.withColumn("_w", weight).groupBy("idx").agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values], F.sum("_w").alias("weight"), F.count("*").alias("views"))
    total = F.lit(0.0)
    for v in values:
        total = total + F.col(v)
    by = total if by_own_sum else F.col("weight")
    return sums.select("idx", *[F.when(by > 0, F.col(v) / by).otherwise(0.0).alias(v) for v in values], "weight", "views")


def projected(points: DataFrame, images: DataFrame) -> DataFrame:
    """Every point in every image: ``u, v, depth`` in pixels and metres, null closer than 0.05 m. Images are few: the number
    of images is checked against a bound before they are broadcast."""
    if images.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 images: project them by groups")
    return in_camera(points.join(F.broadcast(images)))


def in_camera(both: DataFrame) -> DataFrame:
    """``u, v, depth`` of rows that hold a point and an image."""
    pc = [sum((F.col("r")[3 * i + j] * F.col("xyz"[j]) for j in range(3)), F.col("t")[i]) for i in range(3)]
    out = both.withColumns({"_px": pc[0], "_py": pc[1], "depth": pc[2]})
    seen = F.col("depth") > 0.05
    return out.withColumns({"u": F.when(seen, F.col("fx") * F.col("_px") / F.col("depth") + F.col("cx")), "v": F.when(seen, F.col("fy") * F.col("_py") / F.col("depth") + F.col("cy"))}).drop("_px", "_py")


def in_reach(points: DataFrame, images: DataFrame, far: float) -> DataFrame:
    """Pairs of a point and an image that may see it no further than ``far``: an equi-join on ground tiles.

    What an image sees at depths up to ``far`` lies in a circle around the camera, of ``far`` times the slant of its
    corner; the image goes to the tiles of ``far`` metres that the circle's square meets.
    """
    centre = [-(F.col("r")[j] * F.col("t")[0] + F.col("r")[3 + j] * F.col("t")[1] + F.col("r")[6 + j] * F.col("t")[2]) for j in (0, 1)]
    side = lambda c, size, f: F.greatest(F.abs(c), F.abs(size - c)) / f
    wide, high = side(F.col("cx"), F.col("width"), F.col("fx")), side(F.col("cy"), F.col("height"), F.col("fy"))
    reach = far * F.sqrt(1 + wide * wide + high * high)
    tiles = lambda c: F.sequence(F.floor((c - reach) / far), F.floor((c + reach) / far))
    dealt = images.withColumn("_tx", F.explode(tiles(centre[0]))).withColumn("_ty", F.explode(tiles(centre[1])))
    placed = points.withColumns({"_tx": F.floor(F.col("x") / far), "_ty": F.floor(F.col("y") / far)})
    return placed.join(dealt, ["_tx", "_ty"]).drop("_tx", "_ty")


def visible(points: DataFrame, images: DataFrame, cell_px: int = 4, far: float = 30.0, border: float = 2.0, slack: float = 1.08, solid: float = 0.3) -> DataFrame:
    """Points in frame that no nearer solid point hides.

    A solid point stamps a square of its depth on the image's cells; a cell keeps the least. Stamps are reduced to a
    minimum per (image, cell) before the join back.
    """
    seen = in_camera(in_reach(points, images, far)).filter("depth > 0.05").filter((F.col("depth") <= far) & (F.col("u") >= border) & (F.col("v") >= border) & (F.col("u") < F.col("width") - border) & (F.col("v") < F.col("height") - border))
    seen = seen.withColumns({"gx": F.floor(F.col("u") / cell_px).cast("int"), "gy": F.floor(F.col("v") / cell_px).cast("int")})
    reach = F.least(F.greatest(F.ceil(F.col("fx") * F.least(F.col("radius"), F.lit(0.1)) / F.col("depth") / cell_px), F.lit(1)), F.lit(4)).cast("int")
    stamps = seen.filter(F.col("opacity") >= solid).withColumn("_k", reach)
    stamps = stamps.withColumn("_x", F.explode(F.sequence(F.col("gx") - F.col("_k"), F.col("gx") + F.col("_k")))).withColumn("_y", F.explode(F.sequence(F.col("gy") - F.col("_k"), F.col("gy") + F.col("_k"))))
    nearest = stamps.groupBy("image_id", F.col("_x").alias("gx"), F.col("_y").alias("gy")).agg(F.min("depth").alias("front"))
    return seen.join(nearest, ["image_id", "gx", "gy"], "left").filter(F.col("front").isNull() | (F.col("depth") / slack <= F.col("front")))


def prune_to_fixed_point(cells: DataFrame, threshold: Column, save) -> DataFrame:
    """Drop cells whose 3 x 3 mean of ``kept`` is under ``threshold``, again until none drops.

    ``cells(cx, cy, kept, ...)``; ``save(df)`` writes a round and reads it back, so that lineage stays short.
    """
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    now = save(cells.filter("kept > 0").withColumn("_limit", threshold))
    while True:
        sent = now.select("cx", "cy", "kept", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around])).alias("o"))
        means = sent.groupBy((F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy")).agg((F.sum("kept") / 9).alias("_mean"))
        left = save(now.join(means, ["cx", "cy"]).filter("_mean >= _limit").drop("_mean"))
        if left.count() == now.count():
            return left.drop("_limit")
        now = left
