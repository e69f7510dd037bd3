"""Queries of grid, raster and cloud operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r4 as rounded
from ..functions.maths import value_at_rank
from ..operators import cloud, graph, grid, registration
from ..operators.saving import saved
from .registry import CELL, N, POINTS, TERRAIN, points, query, r4, terrain

CELLS = "floor(x / 1e0) AS cx, floor(y / 1e0) AS cy"
AS_LONG = "CAST(floor(x / 1e0) AS BIGINT) AS cx, CAST(floor(y / 1e0) AS BIGINT) AS cy"

# --- point clouds -----------------------------------------------------------------------------------------------------


@query("agg04_cell_mean", f"SELECT {AS_LONG}, {r4('avg(z)')} AS mean, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2")
def _(spark, t):
    return cloud.cell_means(points(t), 1.0).withColumn("mean", rounded(F.col("mean")))


@query("agg05_roughness", f"""SELECT cx, cy, count(*) AS n, {r4('max(r)')} AS roughness FROM (
  SELECT {AS_LONG}, stddev_pop(z) OVER (PARTITION BY floor(x / 1e0), floor(y / 1e0)) AS r FROM ({POINTS})) GROUP BY 1, 2""")
def _(spark, t):
    rough = cloud.roughness(points(t), 1.0)
    return rough.groupBy("cx", "cy").agg(F.count("*").alias("n"), rounded(F.max("roughness")).alias("roughness"))


@query("agg06_ground_misfit", f"""WITH m AS (SELECT list_sort(list(z))[count(*) // 2 + 1] AS m FROM ({POINTS}) GROUP BY floor(x / 2e0), floor(y / 2e0) HAVING count(*) >= 20)
SELECT {r4('quantile_cont(m, 16e-2)')} AS p16, {r4('quantile_cont(m, 5e-1)')} AS p50, {r4('quantile_cont(m, 84e-2)')} AS p84, count(*) AS cells FROM m""")
def _(spark, t):
    m = cloud.ground_misfit(points(t), 2.0)
    return m.select(*[rounded(F.col(c)).alias(c) for c in ("p16", "p50", "p84")], "cells")


@query("agg07_surface_height", f"SELECT {AS_LONG}, list_sort(list(z))[CAST(floor(8e-1 * (count(*) - 1)) AS INT) + 1] AS height, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2 HAVING count(*) >= 4")
def _(spark, t):
    return cloud.surface_heights(points(t), 1.0)


@query("agg08_weighted_ground", f"""SELECT cx, cy, min(z) AS ground FROM (SELECT *, sum(w) OVER (PARTITION BY cx, cy ORDER BY z, w, ok, ln ROWS UNBOUNDED PRECEDING) AS run,
  sum(w) OVER (PARTITION BY cx, cy) AS total FROM (SELECT *, {AS_LONG} FROM (SELECT ok, ln, x, y, z, CAST(w * 5e1 AS BIGINT) AS w FROM ({POINTS})))) WHERE run >= 3e-1 * total GROUP BY 1, 2""")
def _(spark, t):
    return cloud.weighted_ground(points(t).withColumn("w", F.floor(F.col("w") * 50 + 0.5)), 1.0, tie=("ok", "ln"))


@query("agg09_without_fliers", f"""WITH p AS (SELECT *, 1e0 + floor(x / 4e0) AS s, 3e-1 + 3e-2 * x AS tol FROM ({POINTS})),
k AS (SELECT *, floor(x / s) AS cx, floor(y / s) AS cy FROM p),
m AS (SELECT s, cx, cy, CASE WHEN count(*) >= 4 THEN list_sort(list(z))[count(*) // 2 + 1] END AS m FROM k GROUP BY 1, 2, 3)
SELECT ok, ln, count(*) AS n, {r4('sum(z)')} AS z FROM k JOIN m USING (s, cx, cy) WHERE m IS NULL OR abs(z - m) <= tol GROUP BY 1, 2""")
def _(spark, t):
    kept = cloud.without_fliers(points(t), 1.0 + F.floor(F.col("x") / 4.0).cast("double"), 0.3 + 0.03 * F.col("x"))
    return kept.groupBy("ok", "ln").agg(F.count("*").alias("n"), rounded(F.sum("z")).alias("z"))


VOXEL = "floor(x / s), floor(y / s), floor(z / s)"


@query("agg10_voxel_thin", f"""SELECT ok, ln, x, y, z, w FROM (SELECT *, row_number() OVER (PARTITION BY s, {VOXEL} ORDER BY ok, ln, x, y, z, w) AS n
  FROM (SELECT *, 5e-1 + floor(x / 6e0) AS s FROM ({POINTS}))) WHERE n = 1""")
def _(spark, t):
    return cloud.first_per_voxel(points(t), 0.5 + F.floor(F.col("x") / 6.0).cast("double"), ["ok", "ln", "x", "y", "z", "w"])


@query("agg11_cell_counts", f"SELECT {AS_LONG}, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2 HAVING count(*) >= 3")
def _(spark, t):
    return cloud.in_cells(points(t), 1.0).groupBy("cx", "cy").agg(F.count("*").alias("n")).filter("n >= 3")


@query("agg32_colour_range", f"""WITH c AS (SELECT ok % 50 AS series, list_sort(list(z)) AS zs FROM ({POINTS}) GROUP BY 1),
e AS (SELECT series, zs[CAST(least(floor(len(zs) * 2e-2), len(zs) - 1) AS INT) + 1] AS lo, zs[CAST(least(floor(len(zs) * 98e-2), len(zs) - 1) AS INT) + 1] AS hi FROM c)
SELECT ok, ln, count(*) AS n, {r4('sum(CASE WHEN hi > lo THEN least(1e0, greatest(0e0, (z - lo) / (hi - lo))) ELSE 5e-1 END)')} AS v
FROM ({POINTS}) JOIN e ON series = ok % 50 GROUP BY 1, 2""")
def _(spark, t):
    scaled = cloud.scaled_to_range(points(t).withColumn("series", F.col("ok") % 50), ["series"], "z")
    return scaled.groupBy("ok", "ln").agg(F.count("*").alias("n"), rounded(F.sum("share")).alias("v"))


TESTS = {"solid": "w >= 5e-2", "small": "z <= 8e0", "near": "(x - 6e0) * (x - 6e0) + (y - 6e0) * (y - 6e0) <= 3e1"}


@query("flt04_named_predicates", "SELECT " + ", ".join(f"CAST(count(*) FILTER ({v}) AS BIGINT) AS {k}" for k, v in TESTS.items()) + f", count(*) AS rows FROM ({POINTS})")
def _(spark, t):
    return cloud.named_predicates(points(t), {k: F.expr(v) for k, v in TESTS.items()})[1]


@query("flt04_kept_rows", f"SELECT ok, ln, x, y, z, w FROM ({POINTS}) WHERE {' AND '.join(f'({v})' for v in TESTS.values())}")
def _(spark, t):
    return cloud.named_predicates(points(t), {k: F.expr(v) for k, v in TESTS.items()})[0]


VIEWS = "SELECT ok % 1000 AS idx, x AS a, y AS b, 1e0 / (greatest(z, 1e0) * greatest(z, 1e0)) AS wt FROM ({})".format(POINTS)


@query("agg15_class_shares", f"SELECT idx, {r4('sum(a * wt) / (sum(a * wt) + sum(b * wt))')} AS a, {r4('sum(b * wt) / (sum(a * wt) + sum(b * wt))')} AS b, {r4('sum(wt)')} AS weight, count(*) AS views FROM ({VIEWS}) GROUP BY 1 HAVING sum(a * wt) + sum(b * wt) > 0")
def _(spark, t):
    v = points(t).selectExpr("ok % 1000 AS idx", "x AS a", "y AS b", "greatest(z, 1e0) AS depth")
    m = cloud.multi_view_mean(v, ["a", "b"], 1.0 / (F.col("depth") * F.col("depth")), by_own_sum=True).filter("a + b > 0")
    return m.select("idx", *[rounded(F.col(c)).alias(c) for c in ("a", "b", "weight")], "views")


@query("agg15_latent_mean", f"SELECT idx, {r4('sum(a * wt) / sum(wt)')} AS a, {r4('sum(b * wt) / sum(wt)')} AS b, count(*) AS views FROM ({VIEWS}) GROUP BY 1")
def _(spark, t):
    v = points(t).selectExpr("ok % 1000 AS idx", "x AS a", "y AS b", "greatest(z, 1e0) AS depth")
    m = cloud.multi_view_mean(v, ["a", "b"], 1.0 / (F.col("depth") * F.col("depth")), by_own_sum=False)
    return m.select("idx", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"), "views")


@query("flt14_blurred", f"""WITH k AS (SELECT ok, ln, x, y, z, median(z) FILTER (x < 3e0) OVER () AS m FROM ({POINTS})) SELECT ok, ln, x, y, z FROM k WHERE NOT (x < 3e0) OR z >= 35e-2 * m""")
def _(spark, t):
    return cloud.without_blurred(points(t).select("ok", "ln", "x", "y", "z"), F.col("x") < 3, 0.35)


@query("agg18_correlation", f"SELECT ok % 20 AS series, {r4('corr(z, w)')} AS r, count(*) AS n FROM ({POINTS}) GROUP BY 1")
def _(spark, t):
    return cloud.correlation(points(t), [(F.col("ok") % 20).alias("series")], "z", "w").withColumn("r", rounded(F.col("r")))


@query("agg20_median_colour", f"SELECT ok % 20 AS series, {r4('median(x)')} AS red, {r4('median(y)')} AS green, {r4('median(z)')} AS blue FROM ({POINTS}) WHERE w >= 5e-1 GROUP BY 1")
def _(spark, t):
    got = cloud.median_colour(points(t).filter("w >= 0.5D"), [(F.col("ok") % 20).alias("series")], {"red": "x", "green": "y", "blue": "z"})
    return got.select("series", *[rounded(F.col(c)).alias(c) for c in ("red", "green", "blue")])


@query("agg28_clipped_misfit", f"SELECT {r4('avg(least(abs(z - m), 2e-1))')} AS misfit, count(*) AS n FROM (SELECT z, median(z) OVER () AS m FROM ({POINTS}))")
def _(spark, t):
    m = registration.clipped_misfit(points(t).withColumn("d", F.col("z")), 1.0)
    return m.withColumn("misfit", rounded(F.col("misfit")))


@query("win07_running_weight", f"""SELECT ok, ln, CAST(max(run) AS BIGINT) AS run FROM (SELECT ok, ln, sum(CAST(w * 5e1 AS BIGINT)) OVER (PARTITION BY floor(x / 1e0), floor(y / 1e0) ORDER BY z, w, ok, ln, x, y ROWS UNBOUNDED PRECEDING) AS run FROM ({POINTS})) GROUP BY 1, 2""")
def _(spark, t):
    run = cloud.running_weight(cloud.in_cells(points(t), 1.0), ["cx", "cy"], ["z", "w", "ok", "ln", "x", "y"], F.floor(F.col("w") * 50 + 0.5))
    return run.groupBy("ok", "ln").agg(F.max("run").alias("run"))


PRUNE = f"SELECT {AS_LONG}, CAST(count(*) AS DOUBLE) AS kept FROM ({POINTS}) WHERE z > 5e0 GROUP BY 1, 2"


@query("gra04_prune")
def _(spark, t):
    dense = cloud.in_cells(points(t).filter("z > 5"), 1.0).groupBy("cx", "cy").agg(F.count("*").cast("double").alias("kept"))
    return cloud.prune_to_fixed_point(dense, F.lit(4.0), saved)


# --- terrain grids ----------------------------------------------------------------------------------------------------

SLOPE = f"""SELECT row, col, z, gx, -gyr AS gy FROM (SELECT row, col, z,
  CASE WHEN lag(z) OVER r IS NULL THEN (lead(z) OVER r - z) / {CELL}e0 WHEN lead(z) OVER r IS NULL THEN (z - lag(z) OVER r) / {CELL}e0 ELSE (lead(z) OVER r - lag(z) OVER r) / {2 * CELL}e0 END AS gx,
  CASE WHEN lag(z) OVER c IS NULL THEN (lead(z) OVER c - z) / {CELL}e0 WHEN lead(z) OVER c IS NULL THEN (z - lag(z) OVER c) / {CELL}e0 ELSE (lead(z) OVER c - lag(z) OVER c) / {2 * CELL}e0 END AS gyr
  FROM ({TERRAIN}) WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row))"""
SLOPE_DEG = f"SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM ({SLOPE})"


@query("prj03_terrain", f"SELECT row, col, x, y, {r4('z')} AS z FROM ({TERRAIN})")
def _(spark, t):
    made = terrain(t).select("row", "col", rounded(F.col("z")).alias("z"))
    return grid.cells(spark, N, N, CELL).join(made, ["row", "col"])


@query("prj18_slope", f"SELECT row, col, {r4('gx')} AS dzdx, {r4('gy')} AS dzdy, {r4('slope_deg')} AS slope_deg FROM ({SLOPE_DEG})")
def _(spark, t):
    s = grid.slope(terrain(t), CELL, CELL)
    return s.select("row", "col", *[rounded(F.col(c)).alias(c) for c in ("dzdx", "dzdy", "slope_deg")])


@query("prj17_shading", f"SELECT row, col, {r4('(5e-1 - gx * 6e-1 - gy * 62449979e-8) / sqrt(gx * gx + gy * gy + 1e0)')} AS lit FROM ({SLOPE})")
def _(spark, t):
    s = grid.slope(terrain(t), CELL, CELL)
    return s.select("row", "col", rounded(grid.shading(F.col("dzdx"), F.col("dzdy"), 0.6, 0.62449979, 0.5)).alias("lit"))


SITES = "SELECT s_suppkey AS id, ((s_suppkey * 37) % 500 - 25e1) AS x, ((s_suppkey * 91) % 500 - 25e1) AS y FROM supplier"
HALF = CELL * (N - 1) / 2
INSIDE = f"abs(x) <= {HALF}e0 AND abs(y) <= {HALF}e0"


def sites(t):
    return t.supplier.selectExpr("s_suppkey AS id", "((s_suppkey * 37) % 500 - 25e1) AS x", "((s_suppkey * 91) % 500 - 25e1) AS y")


@query("join03_nearest_corner", f"""SELECT id, {r4('z')} AS sample FROM ({SITES}) s LEFT JOIN (SELECT row, col, z FROM ({TERRAIN})) g
  ON {INSIDE} AND row = CAST(floor(({HALF}e0 - y) / {2 * HALF}e0 * {N - 1} + 5e-1) AS INT) AND col = CAST(floor((x + {HALF}e0) / {2 * HALF}e0 * {N - 1} + 5e-1) AS INT)""")
def _(spark, t):
    row, col = grid.corner_cell(F.col("x"), F.col("y"), 2 * HALF, 2 * HALF, N, N)
    inside = F.expr(INSIDE)
    return grid.sample_nearest(sites(t), terrain(t), F.when(inside, row), F.when(inside, col)).select("id", rounded(F.col("sample")).alias("sample"))


@query("join03_nearest_area", f"""SELECT id, {r4('z')} AS sample FROM ({SITES}) s LEFT JOIN (SELECT row, col, z FROM ({TERRAIN})) g
  ON {INSIDE} AND row = least({N - 1}, CAST(floor(({HALF}e0 - y) / {2 * HALF}e0 * {N}) AS INT)) AND col = least({N - 1}, CAST(floor((x + {HALF}e0) / {2 * HALF}e0 * {N}) AS INT))""")
def _(spark, t):
    row, col = grid.area_cell(F.col("x"), F.col("y"), 2 * HALF, 2 * HALF, N, N)
    inside = F.expr(INSIDE)
    return grid.sample_nearest(sites(t), terrain(t), F.when(inside, row), F.when(inside, col)).select("id", rounded(F.col("sample")).alias("sample"))


FR, FC = f"({HALF}e0 - y) / {CELL}e0", f"(x + {HALF}e0) / {CELL}e0"


def _bilinear_sql(edges: str) -> str:
    lim = lambda v: f"least(greatest({v}, 0e0), {N - 1}e0)"
    out = "FALSE" if edges == "clamp" else f"({FR} < -1e-3 OR {FR} > {N - 1} + 1e-3 OR {FC} < -1e-3 OR {FC} > {N - 1} + 1e-3)"
    rule = "w > 0 AND NOT outside" + ("" if edges == "renormalise" else " AND gap = 0")
    return f"""WITH p AS (SELECT id, {out} AS outside, {lim(FR)} AS fr, {lim(FC)} AS fc FROM ({SITES})),
q AS (SELECT *, least(CAST(floor(fr) AS INT), {N - 2}) AS r0, least(CAST(floor(fc) AS INT), {N - 2}) AS c0 FROM p),
k AS (SELECT id, outside, r0 + a AS row, c0 + b AS col, (CASE a WHEN 1 THEN fr - r0 ELSE 1 - (fr - r0) END) * (CASE b WHEN 1 THEN fc - c0 ELSE 1 - (fc - c0) END) AS wt FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
g AS (SELECT row, col, CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE z END AS z FROM ({TERRAIN})),
s AS (SELECT id, sum(wt * z) AS s, sum(CASE WHEN z IS NOT NULL THEN wt END) AS w, coalesce(sum(CASE WHEN z IS NULL THEN wt END), 0) AS gap, bool_or(outside) AS outside FROM k LEFT JOIN g USING (row, col) GROUP BY id)
SELECT id, {r4(f'CASE WHEN {rule} THEN s / w END')} AS sample FROM s"""


def _bilinear(edges: str):
    @query(f"join04_bilinear_{edges}", _bilinear_sql(edges))
    def _(spark, t):
        holed = terrain(t).withColumn("z", F.when((F.col("row") * 7 + F.col("col")) % 11 != 0, F.col("z")))
        s = grid.sample_bilinear(sites(t), ["id"], holed, F.expr(FR), F.expr(FC), N, N, edges)
        return s.select("id", rounded(F.col("sample")).alias("sample"))


for _edges in ("clamp", "null", "renormalise"):
    _bilinear(_edges)

G = f"(SELECT row, col, z FROM ({TERRAIN}))"


def _near(reach: int) -> str:
    return f"SELECT a.row, a.col, b.z AS v FROM {G} a JOIN {G} b ON abs(a.row - b.row) <= {reach} AND abs(a.col - b.col) <= {reach}"


@query("win01_window_stats", f"SELECT row, col, {r4('max(v)')} AS max, {r4('min(v)')} AS min, {r4('sum(v) / 9e0')} AS mean FROM ({_near(1)}) GROUP BY 1, 2")
def _(spark, t):
    s = grid.window_stats(terrain(t), N, N)
    return s.select("row", "col", *[rounded(F.col(c)).alias(c) for c in ("max", "min", "mean")])


SPARSE = f"SELECT row, col, z FROM ({TERRAIN}) WHERE (row * 5 + col) % 3 <> 0"


@query("win02_window_median", f"""WITH g AS ({SPARSE}), a AS (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range({N}) r, range({N}) c),
k AS (SELECT a.row, a.col, b.z - 2e1 AS v FROM a JOIN g b ON abs(a.row - b.row) <= 7 AND abs(a.col - b.col) <= 7)
SELECT row, col, {r4('list_sort(list_concat(list(v), list_transform(range(225 - count(*)), lambda q: 0e0)))[113]')} AS median FROM k GROUP BY 1, 2""")
def _(spark, t):
    sparse = terrain(t).filter("(row * 5 + col) % 3 <> 0").withColumn("z", F.col("z") - 20.0)
    m = grid.window_median(sparse, N, N)
    return m.select("row", "col", rounded(F.col("median")).alias("median"))


MIRROR = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END"


def _fill_sql(src: str, reach: int, least: int) -> str:
    return f"""SELECT g.row, g.col, coalesce(g.z, CASE WHEN m.n >= {least} THEN m.m END) AS z FROM {src} g JOIN (
  SELECT a.row, a.col, count(b.z) AS n, avg(b.z) AS m FROM (SELECT row, col, {MIRROR('row + dr', N)} AS r, {MIRROR('col + dc', N)} AS c FROM {src},
    (SELECT CAST(range AS INT) - {reach} AS dr FROM range({2 * reach + 1})) u, (SELECT CAST(range AS INT) - {reach} AS dc FROM range({2 * reach + 1})) v) a
  JOIN {src} b ON b.row = a.r AND b.col = a.c GROUP BY 1, 2) m USING (row, col)"""


HOLED = f"SELECT row, col, CASE WHEN (row * 5 + col * 3) % 4 = 0 OR (row > 8 AND row < 13 AND col > 8 AND col < 14) THEN NULL ELSE z END AS z FROM ({TERRAIN})"


def holed(t):
    return terrain(t).selectExpr("row", "col", "CASE WHEN (row * 5 + col * 3) % 4 = 0 OR (row > 8 AND row < 13 AND col > 8 AND col < 14) THEN NULL ELSE z END AS z")


@query("win03_bridge_holes", f"WITH g AS ({HOLED}), a AS ({_fill_sql('g', 1, 5)}), b AS ({_fill_sql('a', 1, 5)}) SELECT row, col, {r4('z')} AS z FROM b")
def _(spark, t):
    return grid.bridge_holes(holed(t), N, N).select("row", "col", rounded(F.col("z")).alias("z"))


@query("win06_box_fill", f"WITH g AS ({HOLED}), a AS ({_fill_sql('g', 3, 12)}), b AS ({_fill_sql('a', 3, 12)}) SELECT row, col, {r4('z')} AS z FROM b")
def _(spark, t):
    return grid.box_fill(holed(t), N, N).select("row", "col", rounded(F.col("z")).alias("z"))


def _mirrored(src: str, value: str, reach: int) -> str:
    return f"""SELECT a.row, a.col, a.dr, a.dc, b.{value} AS v FROM (SELECT row, col, dr, dc, {MIRROR('row + dr', N)} AS r, {MIRROR('col + dc', N)} AS c FROM {src},
  (SELECT CAST(range AS INT) - {reach} AS dr FROM range({2 * reach + 1})) u, (SELECT CAST(range AS INT) - {reach} AS dc FROM range({2 * reach + 1})) w) a JOIN {src} b ON b.row = a.r AND b.col = a.c"""


@query("win05_close_and_smooth", f"""WITH g AS (SELECT row, col, z IS NULL AS empty, coalesce(z, min(z) OVER ()) AS z FROM ({HOLED})),
h AS (SELECT row, col, max(v) AS h FROM ({_mirrored('g', 'z', 1)}) GROUP BY 1, 2),
c AS (SELECT row, col, min(v) AS c FROM ({_mirrored('h', 'h', 1)}) GROUP BY 1, 2),
k AS (SELECT sum(exp(-(d * d) / 72e-2)) AS t FROM (SELECT CAST(range AS DOUBLE) - 2 AS d FROM range(5))),
s AS (SELECT row, col, sum(v * (exp(-CAST(dr * dr AS DOUBLE) / 72e-2) / t) * (exp(-CAST(dc * dc AS DOUBLE) / 72e-2) / t)) AS s FROM ({_mirrored('c', 'c', 2)}), k GROUP BY 1, 2)
SELECT row, col, {r4('CASE WHEN NOT empty THEN s END')} AS z FROM g JOIN s USING (row, col)""")
def _(spark, t):
    return grid.close_and_smooth(holed(t), N, N).select("row", "col", rounded(F.col("z")).alias("z"))


FACTOR = 4


@query("agg26_max_pool", f"""WITH s AS ({SLOPE_DEG}), n AS (SELECT CAST(r.range AS INT) AS node_row, CAST(c.range AS INT) AS node_col FROM range({(N - 1) // FACTOR + 1}) r, range({(N - 1) // FACTOR + 1}) c),
p AS (SELECT node_row, node_col, max(slope_deg) AS steepest FROM n JOIN s ON abs(s.row - node_row * {FACTOR}) <= {FACTOR // 2} AND abs(s.col - node_col * {FACTOR}) <= {FACTOR // 2} GROUP BY 1, 2)
SELECT node_row, node_col, {r4('h.z')} AS height, {r4('steepest')} AS steepest, steepest <= 12 AS passable FROM p JOIN s h ON h.row = node_row * {FACTOR} AND h.col = node_col * {FACTOR}""")
def _(spark, t):
    nodes = grid.rover_grid(grid.slope(terrain(t), CELL, CELL), N, N, FACTOR, 12.0)
    return nodes.select("node_row", "node_col", rounded(F.col("height")).alias("height"), rounded(F.col("steepest")).alias("steepest"), "passable")


@query("agg27_mean_pool", f"SELECT row // 8 AS block_row, col // 8 AS block_col, {r4('avg(z)')} AS mean, count(z) AS n FROM ({TERRAIN}) GROUP BY 1, 2")
def _(spark, t):
    return grid.mean_pool(terrain(t), 8).withColumn("mean", rounded(F.col("mean")))


RASTER = f"SELECT row, col, CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE z END AS value FROM ({TERRAIN})"


def raster(t):
    return terrain(t).selectExpr("row", "col", "CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE z END AS value")


@query("snk01_quantised", f"""SELECT row, col, q, {r4('-4e1 + q / 65535e0 * 14e1')} AS back FROM (SELECT row, col, CAST(round_even((value + 4e1) / 14e1 * 65535e0, 0) AS INT) AS q FROM ({RASTER}) WHERE value IS NOT NULL)""")
def _(spark, t):
    q = raster(t).filter("value is not null").withColumn("q", grid.quantised(F.col("value"), -40.0, 100.0, 16))
    return q.select("row", "col", "q", rounded(grid.dequantised(F.col("q"), -40.0, 100.0, 16)).alias("back"))


@query("snk02_coverage", f"SELECT {r4('min(value)')} AS low, {r4('max(value)')} AS high, {r4('avg(CASE WHEN value IS NULL THEN 0e0 ELSE 1e2 END)')} AS coverage_pct FROM ({RASTER})")
def _(spark, t):
    c = grid.coverage(raster(t))
    return c.select(*[rounded(F.col(x)).alias(x) for x in ("low", "high", "coverage_pct")])


@query("snk07_surface_pixels", f"SELECT row, col, coalesce(1 + CAST(round_even((value + 1e1) / 6e1 * 65534e0, 0) AS INT), 0) AS px FROM ({RASTER})")
def _(spark, t):
    return raster(t).select("row", "col", grid.surface_pixel(F.col("value"), -10.0, 50.0).alias("px"))


@query("flt16_fill_no_data", f"WITH g AS (SELECT row, col, CASE (row * 7 + col) % 11 WHEN 0 THEN NULL WHEN 1 THEN -2e6 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE z END AS z FROM ({TERRAIN})), v AS (SELECT min(z) FILTER (z > -1e6 AND NOT isnan(z)) AS m FROM g) SELECT row, col, {r4('CASE WHEN z > -1e6 AND NOT isnan(z) THEN z ELSE m END')} AS z FROM g, v")
def _(spark, t):
    bad = terrain(t).selectExpr("row", "col", "CASE (row * 7 + col) % 11 WHEN 0 THEN NULL WHEN 1 THEN -2e6 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE z END AS z")
    return grid.fill_no_data(bad).select("row", "col", rounded(F.col("z")).alias("z"))


MOVED = f"SELECT row - 3 AS row, col + 2 AS col, z * 2e0 + 1e0 AS value FROM ({TERRAIN}) WHERE (row + col) % 5 <> 0"


@query("join20_shift_search", f"""SELECT dr, dc, {r4('corr(a.value, b.value)')} AS r, count(*) AS n FROM ({MOVED}) a, (SELECT CAST(range AS INT) - 4 AS dr FROM range(9)) u, (SELECT CAST(range AS INT) - 4 AS dc FROM range(9)) v,
  ({RASTER}) b WHERE b.row = a.row + dr AND b.col = a.col + dc AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2""")
def _(spark, t):
    moved = terrain(t).filter("(row + col) % 5 <> 0").selectExpr("row - 3 AS row", "col + 2 AS col", "z * 2e0 + 1e0 AS value")
    s = registration.shift_search(moved, raster(t), 4)
    return s.select("dr", "dc", rounded(F.col("r")).alias("r"), "n")


@query("join20_best_shift", f"""WITH s AS (SELECT dr, dc, corr(a.value, b.value) AS r, count(*) AS n FROM ({MOVED}) a, (SELECT CAST(range AS INT) - 4 AS dr FROM range(9)) u, (SELECT CAST(range AS INT) - 4 AS dc FROM range(9)) v,
  ({RASTER}) b WHERE b.row = a.row + dr AND b.col = a.col + dc AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
m AS (SELECT dr, dc, r FROM s WHERE n >= 5e-2 * (SELECT max(n) FROM s) ORDER BY r DESC, dr, dc LIMIT 1) SELECT dr, dc FROM m WHERE abs(dr) < 4 AND abs(dc) < 4 AND r >= 3e-1""")
def _(spark, t):
    moved = terrain(t).filter("(row + col) % 5 <> 0").selectExpr("row - 3 AS row", "col + 2 AS col", "z * 2e0 + 1e0 AS value")
    return registration.best_shift(registration.shift_search(moved, raster(t), 4), 4).select("dr", "dc")


PASSABLE = f"SELECT row, col FROM ({SLOPE_DEG}) WHERE slope_deg <= 12"


@query("gra02_reachable", f"""WITH RECURSIVE p AS ({PASSABLE}), r(row, col) AS (SELECT row, col FROM p WHERE row = 5 AND col = 5 UNION
  SELECT p.row, p.col FROM r JOIN p ON abs(p.row - r.row) <= 1 AND abs(p.col - r.col) <= 1) SELECT row, col FROM r""")
def _(spark, t):
    mask = grid.slope(terrain(t), CELL, CELL).filter("slope_deg <= 12").select("row", "col")
    return graph.reachable(mask, 5, 5, saved)


STEEP = f"SELECT row, col FROM ({SLOPE_DEG}) WHERE slope_deg > 12"


@query("gra03_pieces", f"""WITH RECURSIVE p AS ({STEEP}), r(row, col, piece) AS (SELECT row, col, CAST(row AS BIGINT) * 2147483648 + col FROM p UNION
  SELECT p.row, p.col, r.piece FROM r JOIN p ON abs(p.row - r.row) + abs(p.col - r.col) = 1),
n AS (SELECT row, col, min(piece) AS piece FROM r GROUP BY 1, 2) SELECT piece, count(*) AS area FROM n GROUP BY 1""")
def _(spark, t):
    mask = grid.slope(terrain(t), CELL, CELL).filter("slope_deg > 12").select("row", "col")
    named = graph.pieces(mask, saved, graph.NEAR4)
    return named.groupBy("piece").agg(F.count("*").alias("area"))


def _routes(spark, t):
    nodes = grid.rover_grid(grid.slope(terrain(t), CELL, CELL), N, N, 2, 12.0)
    nodes = nodes.select(F.lit("s").alias("scene_id"), F.col("node_row").alias("row"), F.col("node_col").alias("col"), F.col("steepest").alias("slope"), "passable")
    # every supplier asks; goals beyond the grid's side come in again at the other
    goal = ("CAST(pmod(28 - s_suppkey, 31) AS INT) AS r1", "CAST(pmod(s_suppkey * 2, 31) AS INT) AS c1")
    asked = t.supplier.selectExpr("s_suppkey AS request_id", "'s' AS scene_id", "2 AS r0", "2 AS c0", *goal)
    return graph.routes(nodes, asked, 2 * CELL, 2 * CELL)


@query("gra01_routes")
def _(spark, t):
    return _routes(spark, t)


#: Least costs from the start by rounds over all edges, until none falls.
@query("gra01_route_costs", f"""WITH RECURSIVE s AS ({SLOPE_DEG}), n AS MATERIALIZED (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col, max(slope_deg) AS slope FROM range(31) r, range(31) c JOIN s ON abs(s.row - r.range * 2) <= 1 AND abs(s.col - c.range * 2) <= 1 GROUP BY 1, 2 HAVING max(slope_deg) <= 12),
e AS MATERIALIZED (SELECT a.row * 31 + a.col AS a, b.row * 31 + b.col AS b, {2 * CELL} * sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) * (1 + 1e-1 * (a.slope + b.slope) / 2) AS w FROM n a JOIN n b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row, a.col) <> (b.row, b.col)),
d(node, cost) USING KEY (node) AS (SELECT row * 31 + col, 0e0 FROM n WHERE row = 2 AND col = 2 UNION
  SELECT e.b, min(d.cost + e.w) FROM d JOIN e ON e.a = d.node LEFT JOIN recurring.d k ON k.node = e.b WHERE k.cost IS NULL OR d.cost + e.w < k.cost - 1e-9 GROUP BY e.b)
SELECT s_suppkey AS request_id, {r4('cost')} AS cost FROM supplier JOIN d ON node = (((28 - s_suppkey) % 31 + 31) % 31) * 31 + s_suppkey * 2 % 31""")
def _(spark, t):
    return _routes(spark, t).groupBy("request_id").agg(rounded(F.max("cost")).alias("cost"))


@query("medians_upper", f"SELECT ok % 100 AS series, list_sort(list(z))[count(*) // 2 + 1] AS m FROM ({POINTS}) GROUP BY 1")
def _(spark, t):
    return value_at_rank(points(t).withColumn("series", F.col("ok") % 100), ["series"], "z", cloud.UPPER_MEDIAN).drop("n")
