"""Operators on grids of cells keyed by ``row, col`` (row 0 in the north): registration, sampling, windows, pooling.

A neighbourhood is a re-keying: every cell is sent to the cells whose window holds it, then aggregated by cell. Only a
cell and its offset move, so a grid of any size is spread by (row, col), and partial sums are combined before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import half_up, medians


def cells(spark: SparkSession, rows: int, cols: int, cell_m: float) -> DataFrame:
    """``row, col, x, y`` of cell centres around the origin, x to the east and y to the north."""
    i = F.col("id")
    return spark.range(rows * cols).select(
        F.floor(i / cols).cast("int").alias("row"),
        (i % cols).cast("int").alias("col"),
        ((i % cols) - (cols - 1) / 2.0).cast("double").__mul__(F.lit(cell_m)).alias("x"),
        (F.lit((rows - 1) / 2.0) - F.floor(i / cols)).cast("double").__mul__(F.lit(cell_m)).alias("y"),
    )


def difference(axis: str, other: str, value: str, step: float) -> Column:
    """Central difference along an axis, one-sided at the edges."""
    w = Window.partitionBy(other).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return (
        F.when(before.isNull(), (after - F.col(value)) / step).when(after.isNull(), (F.col(value) - before) / step).otherwise((after - before) / (2 * step))
    )


def slope(grid: DataFrame, cell_x: float, cell_y: float, value: str = "z") -> DataFrame:
    """``grid`` with ``dzdx, dzdy`` (y to the north) and ``slope_deg``. Each pass is windowed by row, then by column."""
    out = grid.withColumn("dzdx", difference("col", "row", value, cell_x)).withColumn("dzdy", -difference("row", "col", value, cell_y))
    return out.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("dzdx") ** 2 + F.col("dzdy") ** 2))))


def corner_cell(x: Column, y: Column, width: float, height: float, rows: int, cols: int) -> tuple[Column, Column]:
    """Row and column of the nearest node of a corner-aligned heightfield."""
    return half_up((F.lit(height / 2) - y) / height * (rows - 1)).cast("int"), half_up((x + width / 2) / width * (cols - 1)).cast("int")


def area_cell(x: Column, y: Column, width: float, height: float, rows: int, cols: int) -> tuple[Column, Column]:
    """Row and column of the raster cell whose area holds a point; the far edges belong to the last cells."""
    row = F.least(F.lit(rows - 1), F.floor((F.lit(height / 2) - y) / height * rows).cast("int"))
    return row, F.least(F.lit(cols - 1), F.floor((x + width / 2) / width * cols).cast("int"))


def sample_nearest(points: DataFrame, grid: DataFrame, row: Column, col: Column, value: str = "z", to: str = "sample") -> DataFrame:
    """Points with the value of the cell that ``row, col`` name; null outside or without data."""
    right = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(to))
    return points.withColumns({"_r": row, "_c": col}).join(right, (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), "left").drop("_r", "_c", "_row", "_col")


def sample_bilinear(points: DataFrame, key: list[str], grid: DataFrame, fr: Column, fc: Column, rows: int, cols: int, edges: str = "clamp", value: str = "z") -> DataFrame:
    """``key`` and ``sample``: the four cells around fractional ``fr, fc``, weighted.

    ``edges``: clamp moves points to the edge; null gives none outside (with a slack of 1e-3 of a cell); renormalise, as
    null, weighs only cells with data. Without renormalising, a cell without data makes the sample null.
    """
    slack = 1e-3
    lo = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    df = points.withColumns({"_fr": fr.cast("double"), "_fc": fc.cast("double")})
    outside = (F.col("_fr") < -slack) | (F.col("_fr") > rows - 1 + slack) | (F.col("_fc") < -slack) | (F.col("_fc") > cols - 1 + slack)
    df = df.withColumn("_out", F.lit(False) if edges == "clamp" else outside).withColumns({"_fr": lo(F.col("_fr"), rows), "_fc": lo(F.col("_fc"), cols)})
    df = df.withColumns({"_r0": F.least(F.floor("_fr").cast("int"), F.lit(max(0, rows - 2))), "_c0": F.least(F.floor("_fc").cast("int"), F.lit(max(0, cols - 2)))})
    tr, tc = F.col("_fr") - F.col("_r0"), F.col("_fc") - F.col("_c0")
    corner = lambda a, b: F.struct((F.col("_r0") + a).alias("r"), (F.col("_c0") + b).alias("c"), ((tr if a else 1 - tr) * (tc if b else 1 - tc)).alias("w"))
    four = df.select(*key, "_out", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k"))
    right = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias("_v"))
    hit = four.join(right, (F.col("k.r") == F.col("_row")) & (F.col("k.c") == F.col("_col")), "left")
    weight = F.when(F.col("_v").isNotNull(), F.col("k.w"))
    total = hit.groupBy(*key).agg(F.sum(F.col("k.w") * F.col("_v")).alias("s"), F.sum(weight).alias("w"), F.sum(F.when(F.col("_v").isNull(), F.col("k.w"))).alias("gap"), F.max("_out").alias("_out"))
    known = (F.col("w") > 0) & ~F.col("_out")
    if edges != "renormalise":
        known = known & ~(F.coalesce("gap", F.lit(0.0)) > 0)
    return total.select(*key, F.when(known, F.col("s") / F.col("w")).alias("sample"))


def neighbours(grid: DataFrame, reach: int, value: str, rows: int, cols: int, reflect: bool = False) -> DataFrame:
    """``row, col, v, dr, dc``: each cell's value at every cell that has it within ``reach``.

    With ``reflect``, cells beyond an edge mirror those within (the edge cell counts twice), else they are missing.
    """
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    out = grid.select("row", "col", F.col(value).alias("v"), offsets.alias("o"))
    if not reflect:
        out = out.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "v", "o.dr", "o.dc")
        return out.filter((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    # the other way about: ask for the mirrored cell
    mirror = lambda i, n: F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)
    asked = grid.select("row", "col", offsets.alias("o")).select("row", "col", mirror(F.col("row") + F.col("o.dr"), rows).alias("_r"), mirror(F.col("col") + F.col("o.dc"), cols).alias("_c"), "o.dr", "o.dc")
    right = grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("v"))
    return asked.join(right, ["_r", "_c"]).select("row", "col", "v", "dr", "dc")


def window_stats(grid: DataFrame, rows: int, cols: int, value: str = "z", reach: int = 1) -> DataFrame:
    """``row, col, max, min, mean`` over the square window; beyond the edges -inf, +inf and 0 stand."""
    size = float((2 * reach + 1) ** 2)
    near = neighbours(grid, reach, value, rows, cols).groupBy("row", "col")
    return near.agg(F.max("v").alias("max"), F.min("v").alias("min"), (F.sum("v") / size).alias("mean"))


def window_median(grid: DataFrame, rows: int, cols: int, value: str = "z", reach: int = 7) -> DataFrame:
    """``row, col, median`` of the square window, where missing cells and those beyond the edges count as 0."""
    size = (2 * reach + 1) ** 2
    near = neighbours(grid, reach, value, rows, cols).groupBy("row", "col").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    zeros, middle = size - F.size("vs"), size // 2
    negative = F.size(F.filter("vs", lambda v: v < 0))
    at = F.lit(middle)
    return near.select(
        "row", "col",
        F.when(at < negative, F.try_element_at("vs", (at + 1).cast("int"))).when(at < negative + zeros, F.lit(0.0)).otherwise(F.try_element_at("vs", (at - zeros + 1).cast("int"))).alias("median"),
    )


def fill_from_neighbours(grid: DataFrame, rows: int, cols: int, least: int, reach: int, value: str = "z") -> DataFrame:
    """One pass: an empty cell with at least ``least`` measured cells in its window, edges mirrored, gets their mean."""
    near = neighbours(grid, reach, value, rows, cols, reflect=True).groupBy("row", "col").agg(F.count("v").alias("n"), F.avg("v").alias("m"))
    return grid.join(near, ["row", "col"], "left").withColumn(value, F.coalesce(F.col(value), F.when(F.col("n") >= least, F.col("m")))).drop("n", "m")


def bridge_holes(grid: DataFrame, rows: int, cols: int, passes: int = 2) -> DataFrame:
    for _ in range(passes):
        grid = fill_from_neighbours(grid, rows, cols, least=5, reach=1)
    return grid


def box_fill(grid: DataFrame, rows: int, cols: int, passes: int = 2) -> DataFrame:
    for _ in range(passes):
        grid = fill_from_neighbours(grid, rows, cols, least=12, reach=3)
    return grid


def close_and_smooth(grid: DataFrame, rows: int, cols: int, sigma: float = 0.6, value: str = "z") -> DataFrame:
    """Grey closing over 3 x 3 and a Gaussian of ``sigma`` cells (reach 2, mirrored); empty cells take the minimum meanwhile
    and stay empty in the result."""
    import math

    low = grid.agg(F.min(value).alias("_low"))
    filled = grid.join(F.broadcast(low)).withColumn("_empty", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), F.col("_low"))).drop("_low")  # one row
    high = neighbours(filled, 1, value, rows, cols, reflect=True).groupBy("row", "col").agg(F.max("v").alias("h"))
    closed = neighbours(high, 1, "h", rows, cols, reflect=True).groupBy("row", "col").agg(F.min("v").alias("c"))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-2, 3)]
    weights = F.array(*[F.lit(k / sum(kernel)) for k in kernel])
    w = F.element_at(weights, F.col("dr") + 3) * F.element_at(weights, F.col("dc") + 3)
    smooth = neighbours(closed, 2, "c", rows, cols, reflect=True).groupBy("row", "col").agg(F.sum(F.col("v") * w).alias("s"))
    return filled.join(smooth, ["row", "col"]).withColumn(value, F.when(~F.col("_empty"), F.col("s"))).drop("_empty", "s")


def max_pool(grid: DataFrame, rows: int, cols: int, factor: int, value: str) -> DataFrame:
    """``node_row, node_col, steepest``: the greatest value within half a factor of every ``factor``-th cell."""
    half = factor // 2
    last_r, last_c = (rows - 1) // factor, (cols - 1) // factor
    span = lambda c, last: F.sequence(F.greatest(F.ceil((F.col(c) - half) / factor), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + half) / factor), F.lit(last)).cast("int"))
    holds = grid.filter((F.ceil((F.col("row") - half) / factor) <= F.least(F.floor((F.col("row") + half) / factor), F.lit(last_r))) & (F.ceil((F.col("col") - half) / factor) <= F.least(F.floor((F.col("col") + half) / factor), F.lit(last_c))))
    sent = holds.withColumn("node_row", F.explode(span("row", last_r))).withColumn("node_col", F.explode(span("col", last_c)))
    return sent.groupBy("node_row", "node_col").agg(F.max(value).alias("steepest"))


def mean_pool(grid: DataFrame, factor: int, value: str = "z") -> DataFrame:
    return grid.groupBy(F.floor(F.col("row") / factor).cast("int").alias("block_row"), F.floor(F.col("col") / factor).cast("int").alias("block_col")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def rover_grid(grid: DataFrame, rows: int, cols: int, factor: int, limit_deg: float = 30.0) -> DataFrame:
    """Every ``factor``-th node with its height, the steepest fine slope around it and whether a rover passes."""
    steep = max_pool(grid, rows, cols, factor, "slope_deg")
    nodes = grid.filter((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).select((F.col("row") / factor).cast("int").alias("node_row"), (F.col("col") / factor).cast("int").alias("node_col"), F.col("z").alias("height"))
    return nodes.join(steep, ["node_row", "node_col"]).withColumn("passable", F.col("steepest") <= limit_deg)


def quantised(value: Column, low: float, high: float, bits: int) -> Column:
    """A raster value as stored: half-even on 2^bits - 1 steps; null where out of range or missing."""
    top = float(2**bits - 1)
    return F.when((value >= low) & (value <= high), F.bround((value - low) / (high - low) * top).cast("int"))


def dequantised(stored: Column, low: float, high: float, bits: int) -> Column:
    return F.lit(low) + stored / float(2**bits - 1) * (high - low)


def coverage(cells: DataFrame, value: str = "value") -> DataFrame:
    """One row, ``low, high, coverage_pct``: the range of the valid cells, and how many of all cells are valid."""
    valid = F.col(value).isNotNull() & ~F.isnan(value)
    good = F.when(valid, F.col(value))
    return cells.agg(F.min(good).alias("low"), F.max(good).alias("high"), F.avg(F.when(valid, 100.0).otherwise(0.0)).alias("coverage_pct"))


def raster_with_alpha(cells: DataFrame, bits: int = 16, value: str = "value") -> DataFrame:
    """``row, col, px, alpha, low, high``: values over the range of the valid cells in ``bits``, and whether a cell is valid.

    A cell without data has px 0 and alpha 0; a valid one the greatest alpha. The range is one row, joined to all cells.
    """
    top = 2**bits - 1
    valid = F.col(value).isNotNull() & ~F.isnan(value)
    ends = coverage(cells, value).select("low", "high")
    share = F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    px = F.when(valid, F.bround(share * float(top)).cast("int")).otherwise(0)
    return cells.join(F.broadcast(ends)).select("row", "col", px.alias("px"), F.when(valid, top).otherwise(0).alias("alpha"), "low", "high")  # one row


def surface_pixel(value: Column, low: float, high: float) -> Column:
    """A surface's stored sample: 0 is no data, 1 to 65535 run from ``low`` to ``high``."""
    return F.coalesce(1 + F.bround((value - low) / (high - low) * 65534.0).cast("int"), F.lit(0))


def heightmap(cells: DataFrame, origin_z: float, value: str = "z") -> DataFrame:
    """``row, col, px, low, high``: heights above an origin in 16 bits over their own range; missing ones are the lowest."""
    above = fill_no_data(cells, value).withColumn("_h", F.col(value) - origin_z)
    ends = above.agg(F.min("_h").alias("low"), F.max("_h").alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.col("_h") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return above.join(F.broadcast(ends)).select("row", "col", F.bround(share * 65535.0).cast("int").alias("px"), "low", "high")  # one row


def shading(dzdx: Column, dzdy: Column, sun_x: float, sun_y: float, sun_z: float) -> Column:
    """Cosine of the angle between the ground's normal and the sun."""
    return (F.lit(sun_z) - dzdx * sun_x - dzdy * sun_y) / F.sqrt(dzdx * dzdx + dzdy * dzdy + 1.0)


def sharpness(pixels: DataFrame, step: int = 4) -> DataFrame:
    """``image_id, sharpness``: the variance of the Laplacian of every ``step``-th pixel of every ``step``-th line."""
    few = pixels.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    sides = few.withColumn("_a", F.lag("value").over(along) + F.lead("value").over(along))
    both = sides.withColumn("_l", F.col("_a") + F.lag("value").over(down) + F.lead("value").over(down) - 4 * F.col("value"))
    return both.groupBy("image_id").agg(F.var_pop("_l").alias("sharpness"))


def edge_strength(pixels: DataFrame, factor: int = 4) -> DataFrame:
    """``image_id, detail``: the median size of the Laplacian of each image, made smaller by means of ``factor`` x ``factor``
    pixels. Beyond an edge the image is mirrored about its outermost line."""
    small = pixels.groupBy("image_id", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")

    def sides(w):
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        alone = F.col("value")  # an image of one line
        return F.coalesce(before, after, alone) + F.coalesce(after, before, alone)

    strength = small.withColumn("_a", sides(along)).withColumn("_l", F.abs(F.col("_a") + sides(down) - 4 * F.col("value")))
    return medians(strength, ["image_id"], "_l").select("image_id", F.col("m").alias("detail"))


def box_means(cells: DataFrame, key: list[str], reach: int, values: dict[str, Column]) -> DataFrame:
    """Cells with the mean of each value over the square window of ``reach``, cut at the edges: sums along rows, then along
    columns, so that a cell is read twice and not once for each cell of its window."""
    along = Window.partitionBy(*key, "row").orderBy("col").rangeBetween(-reach, reach)
    down = Window.partitionBy(*key, "col").orderBy("row").rangeBetween(-reach, reach)
    out = cells.withColumns({f"_{n}": v for n, v in values.items()})
    out = out.withColumns({f"_s{n}": F.sum(f"_{n}").over(along) for n in values} | {f"_k{n}": F.count(f"_{n}").over(along) for n in values})
    out = out.withColumns({n: F.sum(f"_s{n}").over(down) / F.sum(f"_k{n}").over(down) for n in values})
    return out.drop(*[f"_{a}{n}" for a in ("", "s", "k") for n in values])


def local_contrast(pixels: DataFrame, reach: int = 32) -> DataFrame:
    """``pixels(image_id, row, col, value)`` with ``contrast``, the deviation of the values in the window around each."""
    v = F.col("value").cast("double")
    both = box_means(pixels, ["image_id"], reach, {"_mean": v, "_square": v * v})
    return both.withColumn("contrast", F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))).drop("_mean", "_square")


def in_focus(pixels: DataFrame, save, cell_px: int, reach: int = 32, share: float = 0.35, spread: int = 2) -> DataFrame:
    """``image_id, row, col, good`` of cells of ``cell_px`` pixels: not in a blur that comes in from the image's edge.

    A cell is blurred where its mean ``local_contrast`` is under a ``share`` of the image's median; blurs grow by ``spread``
    cells on all sides. Of their pieces those that touch an edge are out; a smooth patch within the image stays. Image ids
    are whole numbers from 0.
    """
    from .graph import pieces

    place = [F.floor(F.col(c) / cell_px).cast("int").alias(c) for c in ("row", "col")]
    cells = save(local_contrast(pixels, reach).groupBy("image_id", *place).agg(F.avg("contrast").alias("contrast")))
    size = save(cells.groupBy("image_id").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols")))
    middle = medians(cells, ["image_id"], "contrast").select("image_id", "m")
    low = cells.join(middle, "image_id").filter(F.col("contrast") < share * F.col("m"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-spread, spread + 1) for b in range(-spread, spread + 1)]))
    grown = low.select("image_id", "row", "col", near.alias("d")).select("image_id", (F.col("row") + F.col("d.a")).alias("row"), (F.col("col") + F.col("d.b")).alias("col")).distinct()
    blurred = save(grown.join(cells.select("image_id", "row", "col"), ["image_id", "row", "col"]))
    tall = (size.agg(F.max("_rows")).first()[0] or 0) + 3  # images one below the other, apart
    named = pieces(blurred.select((F.col("row") + F.col("image_id") * tall).alias("row"), "col"), save)
    named = save(named.select(F.floor(F.col("row") / tall).cast("int").alias("image_id"), (F.col("row") % tall).cast("int").alias("row"), "col", "piece"))
    on_edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("_rows")) | (F.col("col") == F.col("_cols"))
    out = named.join(size, "image_id").filter(on_edge).select("piece").distinct()
    gone = named.join(out, "piece", "left_semi").select("image_id", "row", "col", F.lit(False).alias("good"))
    return cells.select("image_id", "row", "col").join(gone, ["image_id", "row", "col"], "left").withColumn("good", F.coalesce("good", F.lit(True)))


def texture(pixels: DataFrame, fine: int = 1, coarse: int = 8) -> DataFrame:
    """``pixels`` with ``texture``: a fine mean less a coarse one, which leaves pebbles and takes the light away."""
    v = F.col("value").cast("double")
    near = box_means(pixels, ["image_id"], fine, {"_near": v})
    return box_means(near, ["image_id"], coarse, {"_far": v}).withColumn("texture", F.col("_near") - F.col("_far")).drop("_near", "_far")


def _largest(good) -> tuple[int, int, int, int, int]:
    """(area, row0, row1, col0, col1) of the largest rectangle of a mask; of equals the first by its lower right corner."""
    import numpy as np

    height, best = np.zeros(good.shape[1] + 2, int), (0, 0, 0, 0, 0)
    for r in range(len(good)):
        height[1:-1] = np.where(good[r], height[1:-1] + 1, 0)
        # for each column, how far its height reaches to either side
        left, right = np.zeros(len(height), int), np.full(len(height), len(height) - 1)
        for c in range(1, len(height) - 1):
            k = c - 1
            while k > 0 and height[k] >= height[c]:
                k = left[k]
            left[c] = k
        for c in range(len(height) - 2, 0, -1):
            k = c + 1
            while k < len(height) - 1 and height[k] >= height[c]:
                k = right[k]
            right[c] = k
        area = height * (right - left - 1)
        c = int(area.argmax())
        if area[c] > best[0]:
            best = (int(area[c]), r + 1 - int(height[c]), r + 1, int(left[c]), int(right[c]) - 1)
    return best


def _by_frame(cells: DataFrame, of, columns: str) -> DataFrame:
    """Rows of ``of(mask)`` for each frame; a frame's mask, whose size its camera bounds, is one group."""
    import numpy as np
    import pandas as pd

    names = ["frame_id", *[c.split()[0] for c in columns.split(", ")]]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        good = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), bool)
        good[pdf["row"], pdf["col"]] = pdf["good"].fillna(False).astype(bool)
        return pd.DataFrame([(pdf["frame_id"].iloc[0], *x) for x in of(good)], columns=names)

    return cells.groupBy("frame_id").applyInPandas(find, f"frame_id {cells.schema['frame_id'].dataType.simpleString()}, {columns}")


def largest_rectangles(cells: DataFrame) -> DataFrame:
    """``frame_id, row0, row1, col0, col1``: the largest rectangle of good cells of each frame (ends beyond; of equals the
    first by its lower right corner)."""
    return _by_frame(cells, lambda good: [_largest(good)[1:]], "row0 int, row1 int, col0 int, col1 int")


def rectangle_cover(cells: DataFrame, cell_px: int, most: int = 5, least_px: int = 240) -> DataFrame:
    """``frame_id, n, x0, y0, x1, y1``: pixel boxes (ends beyond) that cover a frame's good cells, the largest first.

    Each is the largest rectangle of what the ones before have left; at most ``most``, and none from the first on whose
    shorter side is under ``least_px``. ``cells(frame_id, row, col, good)`` are ``cell_px`` pixels wide.
    """

    def cover(good) -> list[tuple[int, int, int, int, int]]:
        out = []
        while len(out) < most:
            _, r0, r1, c0, c1 = _largest(good)
            if min(r1 - r0, c1 - c0) * cell_px < least_px:
                break
            out.append((len(out), c0 * cell_px, r0 * cell_px, c1 * cell_px, r1 * cell_px))
            good[r0:r1, c0:c1] = False
        return out

    return _by_frame(cells, cover, "n int, x0 int, y0 int, x1 int, y1 int")


def fill_no_data(grid: DataFrame, value: str = "z", no_data: float = -1e6) -> DataFrame:
    """Missing and impossible values become the least valid one of the grid."""
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > no_data), F.col(value))
    low = grid.agg(F.min(good).alias("_low"))
    return grid.join(F.broadcast(low)).withColumn(value, F.coalesce(good, F.col("_low"))).drop("_low")  # one row
