"""Scans and sinks of text and table formats, all by Spark's readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import quantised
from ..operators.tables import replaced

#: A scene's manifest: pointers to its parts; absent parts are null.
MANIFEST = (
    "scene_id string, name string, body string, origin struct<lon: double, lat: double, height_m: double>, "
    "terrain struct<file: string, size_m: double, z_min: double, z_max: double>, sources array<struct<name: string, url: string>>"
)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def raw_images(spark: SparkSession, path: str) -> DataFrame:
    """Image records, one JSON file each: ``image_id, sol, model`` and ``camera``, the camera model's vectors as numbers.

    A model is "(x,y,z);(x,y,z);..."; a malformed one gives null.
    """
    raw = spark.read.schema("imageid string, sol int, camera struct<camera_model_component_list: string>").option("multiLine", True).json(path)
    model = F.col("camera.camera_model_component_list")
    vectors = F.transform(F.split(model, ";"), lambda v: F.transform(F.split(F.regexp_replace(v, r"[()\s]", ""), ","), lambda x: x.try_cast("double")))
    good = F.forall(vectors, lambda v: F.forall(v, lambda x: x.isNotNull()))
    return raw.select(F.col("imageid").alias("image_id"), "sol", model.alias("model"), F.when(good, vectors).alias("camera"))


def class_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``value, name`` of a CSV file with quoted commas."""
    return spark.read.schema("value int, name string").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def posed_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, q, t, camera_id, name`` of a text file whose records are two lines: the pose, then observations.

    A pose line has ten fields, the last a file name; an observation line has numbers only, so lines tell themselves apart
    and need no order.
    """
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#")).select(p.alias("p"))
    poses = lines.filter((F.size("p") == 10) & F.col("p")[9].rlike("[A-Za-z]"))
    number = lambda a, n: F.transform(F.slice("p", a, n), lambda x: x.cast("double"))
    return poses.select(F.col("p")[0].cast("long").alias("image_id"), number(2, 4).alias("q"), number(6, 3).alias("t"), F.col("p")[8].cast("long").alias("camera_id"), F.col("p")[9].alias("name"))


def pose_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, width, height, fx, fy, cx, cy`` of a text file of pinhole cameras, one a line."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(p.alias("p")).filter(F.size("p") >= 8)
    number = [F.col("p")[i + 4].cast("double").alias(n) for i, n in enumerate(("fx", "fy", "cx", "cy"))]
    return lines.select(F.col("p")[0].cast("long").alias("camera_id"), F.col("p")[2].cast("int").alias("width"), F.col("p")[3].cast("int").alias("height"), *number)


def sparse_points(spark: SparkSession, path: str) -> DataFrame:
    """``pid, x, y, z, rgb`` of a text file of points, one a line."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(p.alias("p")).filter(F.size("p") >= 7)
    rgb = F.transform(F.slice("p", 5, 3), lambda x: x.cast("int"))
    return lines.select(F.col("p")[0].cast("long").alias("pid"), *[F.col("p")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")], rgb.alias("rgb"))


def last_row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``file, first``: for each Parquet file the index of the first row of its last row group. Only footers are read, in
    tasks."""
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            out = []
            for name in pdf["file"]:
                store, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                    out.append((name, sum(meta.row_group(i).num_rows for i in range(meta.num_row_groups - 1))))
            yield pd.DataFrame(out, columns=["file", "first"])

    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    return files.mapInPandas(read, "file string, first long")


def split_by_row_group(spark: SparkSession, path: str, columns: list[str], label: str, held_out: bool) -> DataFrame:
    """Projected rows with a label that is not empty: those of the last row group of each file are held out."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.filter(F.col(label).isNotNull() & (F.length(label) > 0))
    ends = last_row_groups(spark, path).withColumnsRenamed({"file": "_file", "first": "_first"})
    late = F.col("_row") >= F.col("_first")
    return rows.join(ends, "_file").filter(late if held_out else ~late).select(*columns)


def training_rows(spark: SparkSession, path: str, columns: list[str], label: str, holdout: float, seed: int, held_out: bool) -> DataFrame:
    """Projected parquet rows with a label that is not empty; a share, by hash, is held out."""
    rows = spark.read.parquet(path).select(*columns).filter(F.col(label).isNotNull() & (F.length(label) > 0))
    draw = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < int(holdout * 1_000_000)
    return rows.filter(draw if held_out else ~draw)


def clusters(spark: SparkSession, path: str, encoder: str) -> DataFrame:
    """``cluster_id, latent, size`` of a cluster file; another encoder than ``encoder`` is an error."""
    raw = spark.read.schema("encoder string, clusters array<struct<id: int, latent: array<float>, size: long>>").option("multiLine", True).json(path)
    checked = raw.withColumn("_ok", F.assert_true(F.col("encoder") == encoder, F.lit("the clusters were made by another encoder"))).filter(F.col("_ok").isNull())
    return checked.select(F.explode("clusters").alias("c")).select(F.col("c.id").alias("cluster_id"), "c.latent", "c.size")


def prepared_answer(answers: DataFrame, text: Column) -> DataFrame:
    """The prepared rows for a text, in any case and without blanks around."""
    return answers.filter(F.lower(F.trim("text")) == F.lower(F.trim(text)))


def write_raster(cells: DataFrame, name: str, low: float, high: float, bits: int, path: str) -> None:
    """Store ``cells(row, col, value)`` as steps of a range; the raster of that name is replaced, others stay.

    A value out of range or not finite fails the job.
    """
    stored = quantised(F.col("value"), low, high, bits)
    bad = F.col("value").isNotNull() & stored.isNull()
    checked = F.when(bad | F.isnan("value"), F.raise_error(F.concat(F.lit(f"{name}: out of range: "), F.col("value").cast("string"))).cast("int")).otherwise(stored)
    out = cells.select("row", "col", checked.alias("px"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(bits).alias("bits"), F.lit(name).alias("name"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


def read_raster(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``row, col, value``; only the raster's own partition is read."""
    px = spark.read.parquet(path).filter(F.col("name") == name)
    return px.select("row", "col", (F.col("low") + F.col("px") / (F.pow(F.lit(2.0), F.col("bits")) - 1) * (F.col("high") - F.col("low"))).alias("value"))


def upsert_manifest(spark: SparkSession, old_path: str, new: DataFrame, key: str, new_path: str) -> None:
    """Write the old rows whose key is not new, and the new ones, as the next version."""
    replaced(spark.read.parquet(old_path), new, key).write.mode("overwrite").parquet(new_path)


def patched(layers: DataFrame, column: str, values: DataFrame, count: int | None = None) -> DataFrame:
    """``layers`` with one column from ``values(idx, <column>)``; rows without a value get null. Doing it again changes nothing.

    With ``count``, the number of records that the layers' description states, what does not fit is refused: layers that
    have another number, values of two kinds for a record, and values for records beyond the last.
    """
    if count is not None:
        own = layers.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("last")).first()
        if own.n != count or own.d != count or own.last not in (None, count - 1):
            raise ValueError(f"the layers have {own.n} records where {count} are stated")
        given = values.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("last")).first()
        if given.n != given.d:
            raise ValueError(f"{given.n - given.d} records have more than one value")
        if given.last is not None and given.last >= count:
            raise ValueError(f"a value points past the last of {count} records")
    return layers.drop(column).join(values.select("idx", column), "idx", "left").select(*layers.columns)


def refuse_overlap(fields: list[dict], name: str, offset: int, size: int) -> None:
    """An error where a field of a layer's description, but the one of that name, takes some of ``size`` bytes at ``offset``."""
    from .binary import record_width

    for f in fields:
        if f["name"] != name and f["offset"] < offset + size and offset < f["offset"] + record_width(f["type"]):
            raise ValueError(f"field {f['name']} overlaps bytes {offset} to {offset + size - 1}")


#: The whole of a scene's manifest: its terrain, and the parts that it may have, by their paths under the scene's folder.
BUNDLE = (
    "scene_id string, name string, body string, "
    "terrain struct<file: string, size_m: array<double>, resolution_m: double, z_min_m: double, z_max_m: double, texture: string>, "
    "splat_surface struct<file: string, z_min_m: double, z_max_m: double>, pins string, rasters string, layers string, shielding string"
)
PINS = "id string, name string, position_site array<double>, kind string, summary string, measurements array<struct<label: string, value: string, source_url: string>>, sample struct<name: string, number: int>, source_urls array<string>"
RASTERS = "name string, file string, bits int, min double, max double, unit string, source string, resolution string, estimate boolean, coverage_pct double"
SHIELDING = "series array<struct<name: string, points: array<struct<depth_m: double, factor: double, areal: double>>>>"
LAYERS = "count long, record_bytes int, fields array<struct<name: string, type: string, offset: int>>"


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame | str | None]:
    """A scene's parts by name, each a table that is read when it is used: ``manifest``, ``terrain`` (row, col, z), and
    ``surface``, ``pins``, ``rasters`` (with ``path``, where the file is), ``shielding`` (series, depth_m, factor, areal),
    ``layers`` (records) and ``texture`` (a path).

    The manifest is read first, one row. It must name a terrain; other parts that it does not name are empty (pins,
    rasters) or None. A part that it names and that is not there is an error.
    """
    from .binary import height_grid, surface_grid
    from .ranges import layer_records

    listed = spark.read.schema(BUNDLE).option("multiLine", True).json(f"{path}/scene.json")
    m = listed.first()
    if m is None or m.terrain is None or not m.terrain.file:
        raise ValueError(f"{path} names no terrain")
    at = lambda part: f"{path}/{part}"
    beside = lambda part, file: f"{path}/{part.rpartition('/')[0]}/{file}" if "/" in part else f"{path}/{file}"
    table = lambda part, kind: spark.read.schema(kind).option("multiLine", True).json(at(part)) if part else None
    rasters, shielding, layers = table(m.rasters, RASTERS), table(m.shielding, SHIELDING), table(m.layers, LAYERS)
    out: dict[str, DataFrame | str | None] = {"manifest": listed, "terrain": height_grid(spark, at(m.terrain.file), m.terrain.z_min_m, m.terrain.z_max_m)}
    out["texture"] = at(m.terrain.texture) if m.terrain.texture else None
    out["surface"] = surface_grid(spark, at(m.splat_surface.file), m.splat_surface.z_min_m, m.splat_surface.z_max_m) if m.splat_surface else None
    out["pins"] = table(m.pins, PINS) if m.pins else spark.createDataFrame([], PINS)
    folder = beside(m.rasters, "") if m.rasters else ""
    out["rasters"] = (rasters if rasters is not None else spark.createDataFrame([], RASTERS)).withColumn("path", F.concat(F.lit(folder), "file"))
    if shielding is not None:
        each = shielding.select(F.explode("series").alias("s")).select(F.col("s.name").alias("series"), F.explode("s.points").alias("p"))
        shielding = each.select("series", "p.depth_m", "p.factor", "p.areal")
    out["shielding"] = shielding
    out["layers"] = None
    if layers is not None:
        told = layers.first()
        out["layers"] = layer_records(spark, beside(m.layers, "layers.bin"), told.record_bytes, told["count"], [f.asDict() for f in told.fields])
    return out
