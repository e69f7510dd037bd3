"""Queries that write given tables in the formats of scenes, and read them back."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.maths import r4 as rounded
from ..operators import cloud, frames, grid, layers, text
from ..operators.saving import own_folder, saved
from ..sources import binary, committed, ranges
from .registry import POINTS, TERRAIN, points, query, r4, terrain


def _folder(t, name: str) -> str:
    return f"{own_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


#: Fields of a record of 20 bytes.
FIELDS = [
    {"name": "quantity", "type": "f32", "offset": 0}, {"name": "supplier", "type": "u16", "offset": 4}, {"name": "days", "type": "u8x2", "offset": 6},
    {"name": "line", "type": "u32", "offset": 8}, {"name": "order_key", "type": "u32", "offset": 12},
]


@query("src05_layer_parts", "SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS FLOAT) AS quantity, CASE WHEN l_suppkey % 11 > 0 THEN l_suppkey % 65535 END AS supplier, [CAST(l_orderkey % 31 AS BIGINT), CAST(l_orderkey % 7 AS BIGINT)] AS days FROM lineitem")
def _(spark, t):
    rows = t.lineitem.selectExpr("monotonically_increasing_id() AS idx", "float(l_quantity) AS quantity", "if(l_suppkey % 11 > 0, l_suppkey % 65535, null) AS supplier", "array(l_orderkey % 31, l_orderkey % 7) AS days", "l_linenumber AS line", "l_orderkey AS order_key")
    path = _folder(t, "layers")
    committed.write_layers(binary.layer_chunks(rows, FIELDS, 20), path)
    return committed.layer_parts(spark, path, 20, FIELDS).select("order_key", "line", "quantity", "supplier", "days")


@query("snk12_committed_files", "SELECT page_id, coalesce(strlen(html), 0) AS bytes, sha256(coalesce(html, '')) AS sha256, url AS about FROM pages")
def _(spark, t):
    path = _folder(t, "pages")
    rows = t.pages.select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("data"), F.col("url").alias("about"))
    committed.write_files(rows, path)
    committed.write_files(rows, path)  # again: nothing is missing
    got = committed.contents(spark, path)
    page = F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("page_id")
    return got.select(page, F.length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"), "about")


@query("src16_array_rows", "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
def _(spark, t):
    path = _folder(t, "arrays")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(batches):
            data = io.BytesIO()
            np.savez(data, vec_id=pdf["vec_id"].to_numpy(np.int64), embedding=np.array(pdf["embedding"].tolist(), np.float32))
            yield pd.DataFrame({"name": [f"vectors-{pdf['vec_id'].iloc[0]}-{n}.npz"], "data": [data.getvalue()]})

    committed.write_files(t.embeddings.select("vec_id", "embedding").mapInPandas(archive, "name string, data binary"), path)
    files = [f"{path}/{r.file}" for r in committed.committed(spark, path).select("file").collect()]
    rows = ranges.array_rows(spark, files, ["vec_id", "embedding"])
    ids = rows.filter("member = 'vec_id'").select("path", "i", F.col("v")[0].cast("long").alias("vec_id"))
    return rows.filter("member = 'embedding'").join(ids, ["path", "i"]).select("vec_id", "v")


ALPHA = f"SELECT row, col, CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE z END AS value FROM ({TERRAIN})"


@query("snk02_raster_with_alpha", f"""WITH c AS ({ALPHA}), e AS (SELECT min(value) AS low, max(value) AS high FROM c)
SELECT row, col, CASE WHEN value IS NULL THEN 0 ELSE CAST(round_even((value - low) / (high - low) * 65535e0, 0) AS INT) END AS px, CASE WHEN value IS NULL THEN 0 ELSE 65535 END AS alpha, {r4('low')} AS low, {r4('high')} AS high FROM c, e""")
def _(spark, t):
    cells = terrain(t).selectExpr("row", "col", "CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE z END AS value")
    return grid.raster_with_alpha(cells).select("row", "col", "px", "alpha", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))


@query("win08_exact_path", f"""WITH p AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, (l_partkey % 97) * 125e-3 AS x, (l_suppkey % 89) * 125e-3 AS y, l_quantity / 1e1 AS z FROM lineitem),
o AS (SELECT o_orderkey AS ok, o_custkey % 50 * 1e-1 AS fx, o_orderkey % 40 * 1e-1 AS fy, o_totalprice / 1e5 AS tz FROM orders WHERE o_orderkey % 3 > 0),
n AS (SELECT *, row_number() OVER w AS a, count(*) OVER (PARTITION BY ok) AS c FROM p LEFT JOIN o USING (ok) WINDOW w AS (PARTITION BY ok ORDER BY ln, pk, sk)),
e AS (SELECT ok, a, CASE WHEN a = c THEN x WHEN a = 1 THEN coalesce(fx, x) ELSE x END AS x, CASE WHEN a = c THEN y WHEN a = 1 THEN coalesce(fy, y) ELSE y END AS y, CASE WHEN a = c THEN coalesce(tz, z) ELSE z END AS z FROM n),
d AS (SELECT ok, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM e WINDOW w AS (PARTITION BY ok ORDER BY a))
SELECT ok, count(*) AS points, {r4('sum(d)')} AS length FROM d GROUP BY 1""")
def _(spark, t):
    p = t.lineitem.selectExpr("l_orderkey AS ok", "l_linenumber", "l_partkey", "l_suppkey", "(l_partkey % 97) * 125e-3 AS x", "(l_suppkey % 89) * 125e-3 AS y", "l_quantity / 1e1 AS z")
    ends = t.orders.filter("o_orderkey % 3 > 0").selectExpr("o_orderkey AS ok", "o_custkey % 50 * 1e-1 AS from_x", "o_orderkey % 40 * 1e-1 AS from_y", "double(null) AS from_z", "double(null) AS to_x", "double(null) AS to_y", "o_totalprice / 1e5 AS to_z")
    return cloud.path_lengths(p, ["ok"], ["l_linenumber", "l_partkey", "l_suppkey"], ("x", "y", "z"), ends).withColumn("length", rounded(F.col("length")))


@query("prj08_harmonics", f"SELECT ok, ln, count(*) AS n, {r4('min(z)')} AS r0, {r4('min(w)')} AS r1, {r4('min(-x)')} AS r2, {r4('min(2e0 * z)')} AS g0 FROM ({POINTS}) GROUP BY 1, 2")
def _(spark, t):
    # weights of -y, z, -x; a quarter turn about z takes x to y and y to -x
    rest = F.array(F.col("x"), F.col("w"), F.col("z"), F.lit(0.0), F.lit(0.0), 2 * F.col("z"), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    p = points(t).withColumns({"quat": F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), "rest": rest})
    turned = cloud.rotated(p, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    at = lambda i: rounded(F.min(F.col("rest")[i]))
    return turned.groupBy("ok", "ln").agg(F.count("*").alias("n"), at(0).alias("r0"), at(1).alias("r1"), at(2).alias("r2"), at(3).alias("g0"))


@query("prj32_edge_strength", f"""WITH p AS (SELECT k AS image_id, row // 4 AS row, col // 4 AS col, avg(z * (k + 1)) AS v FROM ({TERRAIN}), (SELECT range AS k FROM range(3)) GROUP BY 1, 2, 3),
a AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS m, lag(v) OVER c AS t, lead(v) OVER c AS b FROM p WINDOW r AS (PARTITION BY image_id, row ORDER BY col), c AS (PARTITION BY image_id, col ORDER BY row))
SELECT image_id, {r4('median(abs(coalesce(l, m) + coalesce(m, l) + coalesce(t, b) + coalesce(b, t) - 4 * v))')} AS detail FROM a GROUP BY 1""")
def _(spark, t):
    p = terrain(t).withColumn("image_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("image_id", "row", "col", (F.col("z") * (F.col("image_id") + 1)).alias("value"))
    return grid.edge_strength(p).select(F.col("image_id").cast("long").alias("image_id"), rounded(F.col("detail")).alias("detail"))


@query("txt05_detail_lines", """SELECT c_custkey AS scene_id, 1 AS a, 1 AS b, 0 AS c, CASE WHEN c_custkey % 3 > 0 THEN 'A Gaussian splat of the ground near the rover, built from rover photos (' || format('{:,}', c_custkey * 1234567) || ' Gaussians).' ELSE 'No Gaussian splat in this scene.' END AS line FROM customer
UNION ALL SELECT c_custkey, 1, 2, 0, 'Data in this scene: ' || coalesce(nullif(concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'per-Gaussian splat layers' END, CASE WHEN c_custkey % 5 = 0 THEN 'orbital raster layers' END, CASE WHEN c_custkey % 7 = 0 THEN 'radiation shielding estimates' END), ''), 'terrain only') || '.' FROM customer
UNION ALL SELECT o_custkey, 3, o_orderkey, 1, '  Sample: ' || o_orderpriority || ' (no. ' || o_orderkey || ').' FROM orders
UNION ALL SELECT o_custkey, 3, 1152921504606846977, 0, 'Rover route to ' || o_orderpriority || ': driving, ' || CAST(floor(o_totalprice / 100 + 5e-1) AS BIGINT) || ' m long, steepest slope ' || printf('%.1f', CAST(o_orderkey % 60 AS DOUBLE)) || ' degrees.' FROM orders
UNION ALL SELECT s_suppkey, 4, 1152921504606846978 + s_nationkey, 0, 'Terrain layer "' || s_name || '" (' || CASE WHEN s_suppkey % 4 = 0 THEN 'no unit' ELSE 'm' END || '; survey, 20 m' || CASE WHEN s_suppkey % 2 = 0 THEN '; an estimate' ELSE '' END || ')' || CASE WHEN s_suppkey % 3 = 0 THEN ': of height' ELSE '' END FROM supplier
UNION ALL SELECT s_suppkey, 5, -1, 0, CASE WHEN s_suppkey % 2 = 0 THEN 'The user''s module being placed now: solar field at (' || s_suppkey || ', ' || (s_nationkey - 5) || ') m.' ELSE 'The user is not placing a module right now.' END FROM supplier""")
def _(spark, t):
    return text.scene_details(
        splats=t.customer.selectExpr("c_custkey AS scene_id", "if(c_custkey % 3 > 0, c_custkey * 1234567, null) AS count"),
        data=t.customer.selectExpr("c_custkey AS scene_id", "c_custkey % 2 = 0 AS layers", "c_custkey % 5 = 0 AS rasters", "c_custkey % 7 = 0 AS shielding"),
        samples=t.orders.selectExpr("o_custkey AS scene_id", "o_orderkey AS pos", "o_orderpriority AS name", "o_orderkey AS number"),
        routes=t.orders.selectExpr("o_custkey AS scene_id", "o_orderpriority AS label", "'driving' AS status", "o_totalprice / 100 AS length_m", "CAST(o_orderkey % 60 AS DOUBLE) AS max_slope"),
        rasters=t.supplier.selectExpr("s_suppkey AS scene_id", "s_nationkey AS pos", "s_name AS name", "if(s_suppkey % 4 = 0, '', 'm') AS unit", "'survey' AS source", "'20 m' AS resolution", "s_suppkey % 2 = 0 AS estimate", "if(s_suppkey % 3 = 0, 'of height', null) AS description"),
        placing=t.supplier.selectExpr("s_suppkey AS scene_id", "if(s_suppkey % 2 = 0, 'solar_field', null) AS kind", "CAST(s_suppkey AS DOUBLE) AS x", "CAST(s_nationkey - 5 AS DOUBLE) AS y", "CAST(null AS STRING) AS score"),
    )


@query("prj34_masked_crops", f"""WITH m AS (SELECT (row // 13) * 5 + col // 13 AS region, row, col, z FROM ({TERRAIN}) WHERE (row * 3 + col) % 4 <> 0),
b AS (SELECT region, min(row) AS r, min(col) AS c, max(row) + 1 - min(row) AS h, max(col) + 1 - min(col) AS w FROM m GROUP BY 1),
s AS (SELECT *, greatest(h, w) AS n FROM b), e AS (SELECT region, u.range AS row, v.range AS col, u.range + r - (n - h) // 2 AS y, v.range + c - (n - w) // 2 AS x FROM s, range(13) u, range(13) v WHERE u.range < n AND v.range < n)
SELECT e.region, CAST(e.row AS INT) AS row, CAST(e.col AS INT) AS col, {r4('coalesce(m.z, 0e0)')} AS value FROM e LEFT JOIN m ON m.region = e.region AND m.row = e.y AND m.col = e.x""")
def _(spark, t):
    cells = terrain(t)
    masks = cells.filter("(row * 3 + col) % 4 <> 0").selectExpr("(row DIV 13) * 5 + col DIV 13 AS region", "0 AS image_id", "row", "col")
    made = layers.masked_crops(cells.selectExpr("0 AS image_id", "row", "col", "z AS value"), masks, "region")
    return made.withColumn("value", rounded(F.col("value")))


@query("win12_in_focus", f"""WITH RECURSIVE g AS (SELECT k AS image_id, row, col, z + k * sin(row * 1e0) AS v FROM ({TERRAIN}), (SELECT range AS k FROM range(2))),
m AS (SELECT a.image_id, a.row, a.col, avg(b.v) AS m, avg(b.v * b.v) AS q FROM g a JOIN g b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT image_id, row // 4 AS row, col // 4 AS col, avg(sqrt(greatest(q - m * m, 0e0))) AS c FROM m GROUP BY 1, 2, 3),
d AS (SELECT image_id, median(c) AS d FROM c GROUP BY 1), l AS (SELECT c.* FROM c JOIN d USING (image_id) WHERE c.c < 8e-1 * d.d),
b AS MATERIALIZED (SELECT DISTINCT c.image_id, c.row, c.col FROM c JOIN l ON l.image_id = c.image_id AND abs(l.row - c.row) <= 1 AND abs(l.col - c.col) <= 1),
r(image_id, row, col) AS (SELECT image_id, row, col FROM b WHERE row IN (0, 15) OR col IN (0, 15) UNION SELECT b.image_id, b.row, b.col FROM r JOIN b ON b.image_id = r.image_id AND abs(b.row - r.row) <= 1 AND abs(b.col - r.col) <= 1)
SELECT CAST(c.image_id AS INT) AS image_id, CAST(c.row AS INT) AS row, CAST(c.col AS INT) AS col, r.row IS NULL AS good FROM c LEFT JOIN r ON r.image_id = c.image_id AND r.row = c.row AND r.col = c.col""")
def _(spark, t):
    p = terrain(t).withColumn("image_id", F.explode(F.sequence(F.lit(0), F.lit(1)))).selectExpr("image_id", "row", "col", "z + image_id * sin(row * 1e0) AS value")
    return grid.in_focus(p, saved, 4, reach=3, share=0.8, spread=1)


@query("prj35_undistorted", f"""WITH g AS (SELECT k AS frame_id, row, col, z AS v FROM ({TERRAIN}), (SELECT range AS k FROM range(3))),
p AS (SELECT *, (col - 3e1) / 8e1 AS x, (row - 3e1) / 8e1 AS y FROM g), q AS (SELECT *, 1 + 2e-2 * frame_id * (x * x + y * y) + 1e-2 * frame_id * pow(x * x + y * y, 2) AS m FROM p),
u AS (SELECT frame_id, row, col, 8e1 * x * m + 3e1 AS u, 8e1 * y * m + 3e1 AS w FROM q),
k AS (SELECT u.frame_id, u.row, u.col, (CASE a WHEN 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) * (CASE b WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS wt, floor(w) + a AS r, floor(u) + b AS c FROM u, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
s AS (SELECT k.frame_id, k.row, k.col, sum(wt * g.v) AS s, sum(CASE WHEN g.v IS NULL THEN wt ELSE 0e0 END) AS gap FROM k LEFT JOIN g ON g.frame_id = k.frame_id AND g.row = k.r AND g.col = k.c GROUP BY 1, 2, 3)
SELECT CAST(frame_id AS INT) AS frame_id, row, col, {r4('CASE WHEN gap < 1e-9 THEN s END')} AS value FROM s""")
def _(spark, t):
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame_id")
    pixels = terrain(t).select(k, "row", "col", F.col("z").alias("value"))
    lens = ("array(0e0, 0e0, 0e0) AS c", "array(0e0, 0e0, 1e0) AS a", "array(8e1, 0e0, 3e1) AS h", "array(0e0, 8e1, 3e1) AS v", "array(0e0, 0e0, 1e0) AS o", "array(0e0, 2e-2 * frame_id, 1e-2 * frame_id) AS k", "CAST(NULL AS ARRAY<DOUBLE>) AS e", "CAST(NULL AS DOUBLE) AS linearity")
    cameras = spark.range(1).select(k).selectExpr("frame_id", *lens)
    return frames.undistorted(pixels, cameras, 61, 61).withColumn("value", rounded(F.col("value")))


@query("win13_cover")
def _(spark, t):
    cells = grid.slope(terrain(t), 8.0, 8.0).selectExpr("0 AS frame_id", "row", "col", "slope_deg <= 12 AS good")
    return grid.rectangle_cover(cells, 24)
