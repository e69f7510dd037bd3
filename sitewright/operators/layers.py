"""Raster and layer pieces: colours, one-hot classes, masks, painting order, boxes of regions, fallbacks, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clamp01, half_up

# The stops of a value's colour, and of a grade's.
RAMP_RGB = ((13, 54, 107), (57, 135, 229), (205, 226, 251))
GRADE_RGB = ((215, 48, 31), (254, 224, 139), (26, 152, 80))


def ramp_rgb(t: Column, stops: tuple[tuple[int, int, int], ...] = RAMP_RGB) -> Column:
    """``array<int>`` of red, green and blue at 0 to 1 over evenly spaced stops, rounded half up."""
    scaled = clamp01(t) * (len(stops) - 1)
    low = F.least(F.floor(scaled).cast("int"), F.lit(len(stops) - 2))
    table = F.array(*[F.array(*[F.lit(float(c)) for c in s]) for s in stops])
    a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: half_up(F.get(a, c) + (F.get(b, c) - F.get(a, c)) * (scaled - low)).cast("int"))


def grade_rgb(grade: Column) -> Column:
    return ramp_rgb(grade / F.lit(100.0), GRADE_RGB)


def z_score_rgb(z: Column, z_min: float) -> Column:
    """Red at the threshold to yellow at 3, cut to whole numbers."""
    green = F.floor(clamp01((z - z_min) / max(3.0 - z_min, 1e-6)) * 255).cast("int")
    return F.array(F.lit(255), green, F.lit(0))


def byte_of(x: Column) -> Column:
    """0 to 255, cut to a whole number."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))).cast("int")


def tinted(grey: Column, rgb: tuple[float, float, float], reference: Column) -> Column:
    """A grey level as a tint: the reference level becomes the colour."""
    return F.array(*[byte_of(grey / F.greatest(reference, F.lit(1e-6)) * F.lit(float(c))) for c in rgb])


def one_hot(cells: DataFrame, key: list[str], classes: DataFrame) -> DataFrame:
    """``key, name, value``: for each class of ``classes(value, name)`` that some cell has, a 1 where the cell is of it and
    a 0 where it is of another. Cells without a class have none."""
    mapped = cells.filter(F.col("class").isNotNull())
    named = mapped.join(F.broadcast(classes.withColumnRenamed("value", "class")), "class", "left")  # a class dictionary
    names = F.collect_set("name")
    here = named.agg(F.array_sort(names).alias("names"))  # as many as the dictionary has
    return named.join(F.broadcast(here)).select(*key, F.col("name").alias("_own"), F.explode("names").alias("name")).select(
        *key, "name", F.coalesce(F.col("_own") == F.col("name"), F.lit(False)).cast("int").alias("value")
    )


def class_percent(hot: DataFrame) -> DataFrame:
    """``name, percent`` of the mapped cells in each class of ``one_hot``."""
    return hot.groupBy("name").agg((100 * F.avg("value")).alias("percent"))


def ground_mask(cells: DataFrame, key: list[str]) -> DataFrame:
    """``key, good`` from ``cells(key, ground, small, hardware)``: ground, or a small hole in it, and not hardware."""
    return cells.select(*key, (F.coalesce("ground", F.lit(False)) | F.coalesce("small", F.lit(False))).__and__(~F.coalesce("hardware", F.lit(False))).alias("good"))


def uncovered(cells: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Cells that no mask covers."""
    return cells.join(masks.select(*key).distinct(), key, "left_anti")


def painted(masks: DataFrame, key: list[str], region: str, by: Column, largest_first: bool = True) -> DataFrame:
    """``key, region`` of the region that shows at each cell: painted from large to small, so the smallest by ``by`` is on
    top (or the largest, if not ``largest_first``). Of equals the smallest id shows."""
    order = F.struct((-by if largest_first else by).alias("_by"), (-F.col(region)).alias("_id"))
    return masks.groupBy(*key).agg(F.max_by(region, order).alias(region))


def region_boxes(masks: DataFrame, region: str) -> DataFrame:
    """``region, row0, row1, col0, col1, side, area``: the box of each region (ends beyond), the side of the square that
    holds it, and its cells."""
    ends = masks.groupBy(region).agg(F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"), F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"), F.count("*").alias("area"))
    return ends.withColumn("side", F.greatest(F.col("row1") - F.col("row0"), F.col("col1") - F.col("col0")))


def masked_crops(pixels: DataFrame, masks: DataFrame, region: str) -> DataFrame:
    """``region, row, col, value``: each region alone on black, in the square that holds its box, the box in its middle.

    ``pixels(image_id, row, col, value)``, ``masks(region, image_id, row, col)``. A square's cells, which an image bounds, are
    rows; those of the region have the pixel under them, others 0.
    """
    boxes = region_boxes(masks, region)
    top, left = F.floor((F.col("side") - F.col("row1") + F.col("row0")) / 2), F.floor((F.col("side") - F.col("col1") + F.col("col0")) / 2)
    placed = boxes.select(region, "side", (F.col("row0") - top).cast("int").alias("_r"), (F.col("col0") - left).cast("int").alias("_c"))
    every = placed.withColumn("row", F.explode(F.expr("sequence(0, side - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, side - 1)")))
    own = masks.join(pixels, ["image_id", "row", "col"]).join(placed, region)
    own = own.select(region, (F.col("row") - F.col("_r")).alias("row"), (F.col("col") - F.col("_c")).alias("col"), "value")
    return every.select(region, "row", "col").join(own, [region, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def on_mask(seen: DataFrame, mask: DataFrame, cell_px: int) -> DataFrame:
    """Rows of ``seen(image_id, u, v)`` whose cell of ``cell_px`` pixels is in ``mask(image_id, gx, gy)``."""
    cell = {"gx": F.floor(F.col("u") / cell_px).cast("int"), "gy": F.floor(F.col("v") / cell_px).cast("int")}
    return seen.withColumns(cell).join(mask.select("image_id", "gx", "gy"), ["image_id", "gx", "gy"], "left_semi").drop("gx", "gy")


def first_source(key: list[str], *sources: DataFrame, value: str = "z") -> DataFrame:
    """``key, value, source``: the first source with a value at each key, numbered from 0: one aggregate over all."""
    rows = None
    for n, s in enumerate(sources):
        one = s.filter(F.col(value).isNotNull()).select(*key, value, F.lit(n).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy(*key).agg(F.min_by(F.struct(value, "source"), "source").alias("_r"))
    return best.select(*key, F.col(f"_r.{value}").alias(value), "_r.source")


def why_unavailable(has_layers: Column, own_cloud: Column, ordered: Column, records: Column, points: Column) -> Column:
    """Why a scene's layers don't fit its cloud, or null where they do; the first reason counts."""
    return (
        F.when(~F.coalesce(has_layers, F.lit(False)), "no layers").when(~F.coalesce(own_cloud, F.lit(False)), "another cloud")
        .when(~F.coalesce(ordered, F.lit(False)), "not in layer order")
        .when(~records.eqNullSafe(points), F.concat(F.coalesce(records.cast("string"), F.lit("?")), F.lit(" records for "), F.coalesce(points.cast("string"), F.lit("?")), F.lit(" points")))
    )
