"""Queries of search, site, request and sky operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import angle_between, lookup_curve
from ..functions.maths import r4 as rounded
from ..operators import cloud, grid, moon, registration, score, search, text
from ..operators.saving import saved, spread
from .grids import HALF, SLOPE_DEG, sites
from .registry import CELL, N, POINTS, TERRAIN, points, query, r4, terrain

# --- search over cluster vectors --------------------------------------------------------------------------------------

#: The query is the vector with the smallest id, negatives are the next four.
UNIT = "SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 5)"
RELEVANCY = f"""WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c),
d AS (SELECT label, vec_id, sum(m * x) AS d FROM n JOIN ({UNIT}) USING (i) GROUP BY 1, 2),
r AS (SELECT label, 1 / (1 + exp(-1e1 * (max(CASE WHEN vec_id = 0 THEN d END) - max(CASE WHEN vec_id > 0 THEN d END)))) AS relevancy FROM d GROUP BY 1),
z AS (SELECT label, relevancy, CASE WHEN stddev_pop(relevancy) OVER () > 0 THEN (relevancy - avg(relevancy) OVER ()) / stddev_pop(relevancy) OVER () ELSE 0e0 END AS z FROM r),
s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1)"""


def _scored(t):
    members = t.embeddings
    asked = members.filter("vec_id < 5").select("vec_id", search.unit(F.col("embedding")).alias("v"))
    asked = asked.agg(F.first(F.when(F.col("vec_id") == 0, F.col("v")), ignorenulls=True).alias("q"), F.collect_list(F.when(F.col("vec_id") > 0, F.col("v"))).alias("negatives"))
    clusters = search.centroids(members, "label", "embedding").join(F.broadcast(asked))  # one row
    scored = clusters.select("label", "size", search.relevancy(F.col("centroid"), F.col("q"), F.col("negatives")).alias("relevancy"))
    return search.z_scores(scored, "relevancy")


@query("prj23_relevancy", f"{RELEVANCY} SELECT label, size, {r4('relevancy')} AS relevancy, {r4('z')} AS z FROM z JOIN s USING (label)")
def _(spark, t):
    return _scored(t).select("label", "size", rounded(F.col("relevancy")).alias("relevancy"), rounded(F.col("z")).alias("z"))


@query("search_clusters", f"{RELEVANCY} SELECT row_number() OVER (ORDER BY z DESC, label) AS rank, label, size AS members, {r4('z')} AS z FROM z JOIN s USING (label) WHERE z >= 1")
def _(spark, t):
    chosen = search.select_clusters(_scored(t), "label")  # a cluster's size comes with its centroid
    return chosen.select("rank", "label", F.col("size").alias("members"), rounded(F.col("z")).alias("z"))


@query("join02_highlighted", f"{RELEVANCY} SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM z WHERE z >= 1)")
def _(spark, t):
    chosen = search.select_clusters(_scored(t), "label")
    return search.highlighted(t.embeddings, chosen, "label").select("vec_id", "label")


@query("win10_rank_map", f"{RELEVANCY}, k AS (SELECT label, row_number() OVER (ORDER BY z DESC, label) - 1 AS r FROM z WHERE z >= 1) SELECT vec_id, label, CAST(coalesce(r, -1) AS INT) AS cluster_rank FROM embeddings LEFT JOIN k USING (label)")
def _(spark, t):
    chosen = search.select_clusters(_scored(t), "label")
    return search.ranks_or_minus_one(t.embeddings.select("vec_id", "label"), chosen, "label").select("vec_id", "label", "cluster_rank")


@query("agg24_k_means")
def _(spark, t):
    return search.k_means(t.embeddings, "embedding", 256).select("vec_id", "label", "cluster")


@query("agg25_cluster_sizes", "SELECT CAST(range AS INT) AS cluster, count(vec_id) AS n FROM range(256) LEFT JOIN embeddings ON label = range GROUP BY 1")
def _(spark, t):
    return spark.range(256).select(F.col("id").cast("int").alias("cluster")).join(t.embeddings.withColumnRenamed("label", "cluster"), "cluster", "left").groupBy("cluster").agg(F.count("vec_id").alias("n"))


# --- requests ---------------------------------------------------------------------------------------------------------

#: Requests made from part names: one wording for each remainder of the key.
WORDINGS = (
    "'Where is the best site to build?'", "concat('drive to ', p_name, '!')", "concat('Bury it under ', p_size, ' cm of regolith')", "concat('render the ', p_name)", "concat('can the rover reach ', p_name, '?')",
    "concat('Place a greenhouse dome at ', p_name)", "concat('what minerals did you find near ', p_name)", "'help'", "'go home'", "concat('put solar panels here, ', p_name)", "concat('cover it with ', p_size, '.5 m')", "p_name", "concat('is ', p_name, ' reachable')",
)
REQUESTS = "SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WORDINGS)) + " END AS said FROM part"


def _has(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


def _take(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN {_has(pattern)} THEN regexp_extract(t, '{pattern}', {group}) END"


@query("txt01_intent", f"""WITH r AS (SELECT p_partkey, said, lower(trim(said)) AS t FROM ({REQUESTS})),
d AS (SELECT *, coalesce({_take(text.TO_PLACE)}, {_take(text.IS_REACHABLE)}, {_take(text.HOMEWARD)}) AS place FROM r),
k AS (SELECT *, CASE WHEN t = '' OR {_has(text.HELP)} THEN NULL WHEN {_has(text.RENDER)} THEN 'render_concept' WHEN {_has(text.COVER)} THEN 'set_cover' WHEN {_has(text.DRIVE)} AND place IS NOT NULL THEN 'show_path'
  WHEN {_has(text.ROUTE)} AND place IS NOT NULL THEN 'show_path' WHEN {_has(text.WHERE)} THEN 'find_sites' WHEN {_has(text.SCIENCE)} THEN 'query_scene' WHEN {_has(text.PLACE)} THEN 'place_module' END AS intent FROM d)
SELECT p_partkey, intent, CASE intent WHEN 'show_path' THEN place WHEN 'place_module' THEN coalesce(place, 'selected_site') END AS destination,
  CASE WHEN intent = 'set_cover' AND {_has(text.DEPTH)} THEN TRY_CAST(regexp_extract(t, '{text.DEPTH}', 1) AS DOUBLE) * (CASE WHEN regexp_extract(t, '{text.DEPTH}', 2) LIKE 'c%' THEN 1e-2 ELSE 1e0 END) END AS depth_m,
  CASE WHEN intent = 'place_module' THEN CASE WHEN {_has('dome|greenhouse')} THEN 'greenhouse_dome' WHEN {_has('pad|landing')} THEN 'landing_pad' WHEN {_has('solar|panel')} THEN 'solar_field' ELSE 'habitat' END END AS module FROM k""")
def _(spark, t):
    got = spark.sql(REQUESTS.replace("FROM part", "FROM {part}"), part=t.part).withColumn("i", text.intent(F.col("said")))
    return got.select("p_partkey", *[F.col(f"i.{c}").alias(c) for c in ("intent", "destination", "depth_m", "module")])


NOTES = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('add a pin called ', p_name, '.') WHEN 1 THEN 'Drop pin' WHEN 2 THEN concat('mark this spot as ', p_name) WHEN 3 THEN concat('where is ', p_name) ELSE concat('please put a new pin: ', p_name, '!') END AS said FROM part"


@query("txt02_pin_request", f"""WITH r AS (SELECT p_partkey, regexp_replace(trim(said), '[.!]+$', '') AS t FROM ({NOTES})), n AS (SELECT p_partkey, coalesce({_take(text.ADD_PIN)}, {_take(text.PIN_THIS)}) AS rest FROM r)
SELECT p_partkey, CASE WHEN rest IS NOT NULL THEN trim(CASE WHEN regexp_matches(rest, '{text.NOTE}') THEN regexp_extract(rest, '{text.NOTE}', 1) ELSE '' END) END AS note FROM n""")
def _(spark, t):
    return spark.sql(NOTES.replace("FROM part", "FROM {part}"), part=t.part).select("p_partkey", text.pin_request(F.col("said")).alias("note"))


@query("txt08_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(spark, t):
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query("txt09_numbers", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS a, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS b FROM events")
def _(spark, t):
    got = text.number_tuple(F.concat(F.lit("("), F.col("value").cast("decimal(20,4)").cast("string"), F.lit(","), "props", F.lit(")")))
    return t.events.select("event_id", got.alias("n")).select("event_id", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"))


@query("txt12_codes", "SELECT c_custkey, list_contains(list_transform(string_split('household, Building ,AUTOMOBILE', ','), lambda x: lower(trim(x))), lower(trim(c_mktsegment))) AS allowed FROM customer")
def _(spark, t):
    return t.customer.select("c_custkey", text.code_allowed(F.lit("household, Building ,AUTOMOBILE"), F.col("c_mktsegment")).alias("allowed"))


@query("txt13_sign_in", "SELECT c_custkey AS identity FROM customer WHERE trim(' ' || c_mktsegment) = 'BUILDING' AND c_custkey % 3 = 1")
def _(spark, t):
    people = t.customer.select(F.col("c_custkey").alias("identity"), F.concat(F.lit(" "), "c_mktsegment").alias("entered"), (F.col("c_custkey") % 3).alias("wanted"))
    return text.sign_in(people, spark.createDataFrame([(1, "BUILDING")], "org_id long, code string")).select("identity")


@query("txt06_module_counts", """WITH k AS (SELECT l_orderkey AS scene_id, l_returnflag AS kind, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT scene_id, string_agg(n || ' ' || kind || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY first, kind) AS modules FROM k GROUP BY 1""")
def _(spark, t):
    rows = t.lineitem.selectExpr("l_orderkey AS scene_id", "l_returnflag AS kind", "l_linenumber AS pos")
    return text.module_counts(rows)


@query("txt07_checked_intent", "SELECT event_id, CASE WHEN event_type IN ('answer', 'set_cover') THEN event_type ELSE 'query_scene' END AS intent FROM events")
def _(spark, t):
    return t.events.select("event_id", text.checked_intent(F.to_json(F.struct(F.col("event_type").alias("intent")))).alias("intent"))


@query("txt05_fact_lines", "SELECT l_orderkey AS scene_id, substr(string_agg(l_shipdate::DATE || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_shipdate::DATE || ' ' || l_returnflag), 1, 40) AS facts FROM lineitem GROUP BY 1")
def _(spark, t):
    rows = t.lineitem.selectExpr("l_orderkey AS scene_id", "l_linenumber AS seq", "concat(CAST(CAST(l_shipdate AS DATE) AS STRING), ' ', l_returnflag) AS line")
    return text.fact_lines(rows, 40)


@query("txt14_cited_answer", """WITH m AS (SELECT l_orderkey AS pin_id, list({'label': l_returnflag, 'value': CAST(l_quantity AS INT), 'source_url': 'u' || l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS INT)) AS ms FROM lineitem GROUP BY 1),
e AS (SELECT pin_id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM m), f AS (SELECT m.source_url AS url, min((pin_id, pos)) AS spot FROM e GROUP BY 1), n AS (SELECT url, row_number() OVER (ORDER BY spot) AS source_no FROM f)
SELECT pin_id, CAST(pos AS INT) AS pos, m.label AS label, m.value AS value, CAST(source_no AS INT) AS source_no, url FROM e JOIN n ON m.source_url = url""")
def _(spark, t):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("int").alias("value"))
    pins = t.lineitem.groupBy(F.col("l_orderkey").alias("pin_id")).agg(F.array_sort(F.collect_list(one)).alias("ms"))
    pins = pins.withColumn("measurements", F.transform("ms", lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"), F.concat(F.lit("u"), m["l_suppkey"].cast("string")).alias("source_url"))))
    return text.cited_answer(pins, saved).withColumn("source_no", F.col("source_no").cast("int"))


# --- sites ------------------------------------------------------------------------------------------------------------

PLACED = "SELECT id, x, y, CAST((id * 30) % 180 AS DOUBLE) AS rotation_deg FROM (SELECT s_suppkey AS id, ((s_suppkey * 37) % 500 - 25e1) AS x, ((s_suppkey * 91) % 500 - 25e1) AS y FROM supplier)"
SITE_STATS = f"""WITH s AS (SELECT id, x + u * cos(radians(rotation_deg)) - v * sin(radians(rotation_deg)) AS px, y + u * sin(radians(rotation_deg)) + v * cos(radians(rotation_deg)) AS py FROM ({PLACED}), (VALUES (-2e0, -1e0), (-2e0, 1e0), (2e0, -1e0), (2e0, 1e0)) o(u, v)),
g AS ({SLOPE_DEG}), h AS (SELECT id, z, slope_deg FROM s LEFT JOIN g ON abs(px) <= {HALF}e0 AND abs(py) <= {HALF}e0 AND row = CAST(floor(({HALF}e0 - py) / {2 * HALF}e0 * {N - 1} + 5e-1) AS INT) AND col = CAST(floor((px + {HALF}e0) / {2 * HALF}e0 * {N - 1} + 5e-1) AS INT)),
a AS (SELECT id, bool_or(z IS NULL) AS off_terrain, median(z) AS pad, avg(slope_deg) AS mean_slope, max(slope_deg) AS max_slope, stddev_pop(z) AS flatness, count(*) AS n, list(z) AS hs FROM h GROUP BY 1),
t AS (SELECT id, off_terrain, CASE WHEN NOT off_terrain THEN pad END AS pad, CASE WHEN NOT off_terrain THEN mean_slope END AS mean_slope, CASE WHEN NOT off_terrain THEN max_slope END AS max_slope, CASE WHEN NOT off_terrain THEN flatness END AS flatness,
  CASE WHEN NOT off_terrain THEN list_sum(list_transform(hs, lambda h: abs(h - pad))) * 32e0 / n END AS level_m3, n FROM a)"""


def _stats(spark, t):
    placed = sites(t).withColumn("rotation_deg", ((F.col("id") * 30) % 180).cast("double")).withColumn("fp", score.footprint(F.lit("habitat")))
    return score.site_statistics(placed, ["id"], grid.slope(terrain(t), CELL, CELL), N, N, 2 * HALF, 2 * HALF)


@query("agg01_site_statistics", f"{SITE_STATS} SELECT id, off_terrain, {', '.join(f'{r4(c)} AS {c}' for c in ('pad', 'mean_slope', 'max_slope', 'flatness', 'level_m3'))}, n FROM t")
def _(spark, t):
    return _stats(spark, t).select("id", "off_terrain", *[rounded(F.col(c)).alias(c) for c in ("pad", "mean_slope", "max_slope", "flatness", "level_m3")], "n")


RAMP = "least(1e0, greatest(0e0, ({} - {}) / ({})))"


GRADES = f"{SITE_STATS} SELECT id, CAST(CASE WHEN off_terrain THEN 0 ELSE floor(greatest(0e0, 1e2 - 3e1 * {RAMP.format('max_slope', '5e0', '5e0')} - 15e0 * {RAMP.format('flatness', '0e0', '1e0')} - 15e0 * {RAMP.format('level_m3', '0e0', '16e0')}) + 5e-1) END AS INT) AS grade FROM t"


@query("agg02_grade", GRADES)
def _(spark, t):
    return score.grade(_stats(spark, t)).select("id", "grade")


PINS = "SELECT n_name AS name, CAST((n_nationkey * 53) % 400 - 200 AS DOUBLE) AS x, CAST((n_nationkey * 71) % 400 - 200 AS DOUBLE) AS y FROM nation"


def _pins(t):
    return t.nation.selectExpr("n_name AS name", "CAST((n_nationkey * 53) % 400 - 200 AS DOUBLE) AS x", "CAST((n_nationkey * 71) % 400 - 200 AS DOUBLE) AS y")


@query("join06_nearest_pin", f"SELECT id, arg_min(name, (d, name)) AS pin, {r4('min(d)')} AS distance FROM (SELECT s.id, p.name, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS d FROM ({PLACED}) s, ({PINS}) p) GROUP BY 1")
def _(spark, t):
    return score.nearest_pin(sites(t), ["id"], _pins(t), saved).withColumn("distance", rounded(F.col("distance")))


@query("join07_within", f"SELECT s.id AS a, p.name AS b FROM ({PLACED}) s JOIN ({PINS}) p ON sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) <= 75")
def _(spark, t):
    return score.within(sites(t), _pins(t).withColumnRenamed("name", "id"), 75.0).select("a", "b")


@query("top02_top_sites", f"""WITH RECURSIVE q AS MATERIALIZED (SELECT id AS idx, x, y, grade FROM ({GRADES}) JOIN ({PLACED}) USING (id)),
g AS (SELECT 0 AS rank, CAST(NULL AS STRUCT(idx BIGINT, x DOUBLE, y DOUBLE, grade INT)) AS best, CAST([] AS STRUCT(idx BIGINT, x DOUBLE, y DOUBLE, grade INT)[]) AS picked
  UNION ALL SELECT rank + 1, b, list_append(picked, b) FROM (SELECT rank, picked, (SELECT arg_max({{'idx': idx, 'x': x, 'y': y, 'grade': grade}}, (grade, -idx)) FROM q
    WHERE grade > 0 AND len(list_filter(picked, lambda p: sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 60)) = 0) AS b FROM g WHERE rank < 12) WHERE b IS NOT NULL)
SELECT rank, best.idx AS idx, best.x AS x, best.y AS y, best.grade AS grade FROM g WHERE rank > 0""")
def _(spark, t):
    graded = score.grade(_stats(spark, t)).join(sites(t), "id").withColumnRenamed("id", "idx")
    return score.top_sites(graded, 12, 60.0, saved)


@query("prj20_shielding", "SELECT p_partkey, CASE WHEN d <= 0 THEN 1e0 WHEN d <= 1 THEN 1e0 - 25e-2 * d WHEN d <= 2 THEN 75e-2 + 1e-1 * (d - 1) WHEN d <= 3 THEN 85e-2 - 35e-2 * (d - 2) ELSE 5e-1 END AS factor FROM (SELECT p_partkey, p_size / 8e0 - 1 AS d FROM part)")
def _(spark, t):
    curve = F.array(*[F.struct(F.lit(float(d)).alias("d"), F.lit(f).alias("f")) for d, f in ((0, 1.0), (1, 0.75), (2, 0.85), (3, 0.5))])
    return t.part.select("p_partkey", lookup_curve(curve, F.col("p_size") / 8.0 - 1).alias("factor"))


# --- sky --------------------------------------------------------------------------------------------------------------

HORIZON = "SELECT row, col, list_transform(range(360), lambda a: (a * (row + 1) % 17) * 5e-1 - col * 25e-2) AS h FROM (SELECT CAST(p_partkey AS INT) AS row, p_size AS col FROM part)"
SAMPLE_COLUMNS = ("CAST(s_suppkey AS DOUBLE) * 37 % 360 AS az", "CAST(s_suppkey % 13 AS DOUBLE) * 5e-1 - 1 AS el", "25e-2 + 1e-2 * (s_suppkey % 3) AS radius")
SAMPLES = f"SELECT {', '.join(SAMPLE_COLUMNS)} FROM supplier"


def _horizon(t):
    rc = spread(t.part.selectExpr("CAST(p_partkey AS INT) AS row", "p_size AS col"), 20_000)  # 360 numbers a row
    return rc.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(359)), lambda a: (a * (F.col("row") + 1) % 17) * 0.5 - F.col("col") * 0.25))


def _samples(t):
    return t.supplier.selectExpr(*SAMPLE_COLUMNS)


AT = "h[CAST(floor(az) AS INT) % 360 + 1] + (h[(CAST(floor(az) AS INT) + 1) % 360 + 1] - h[CAST(floor(az) AS INT) % 360 + 1]) * (az - floor(az))"


@query("join16_horizon_at", f"SELECT row, col, az, {r4(AT)} AS horizon FROM ({HORIZON}), (SELECT n_nationkey * 73e-1 AS az FROM nation)")
def _(spark, t):
    az = t.nation.selectExpr("n_nationkey * 73e-1 AS az")  # 25 rows at any scale
    return _horizon(t).crossJoin(F.broadcast(az)).select("row", "col", "az", rounded(moon.horizon_at(F.col("h"), F.col("az"))).alias("horizon"))


@query("agg16_visible_percent", f"""WITH v AS (SELECT row, col, least(1e0, greatest(-1e0, (el - ({AT})) / radius)) AS x FROM ({HORIZON}), ({SAMPLES}))
SELECT row, col, {r4('1e2 * avg(5e-1 + (x * sqrt(1 - x * x) + asin(x)) / pi())')} AS percent FROM v GROUP BY 1, 2""")
def _(spark, t):
    return moon.visible_percent(_horizon(t), _samples(t)).withColumn("percent", rounded(F.col("percent")))


@query("prj16_dose", f"SELECT row, col, {r4('1369 * 36525e-2 / 1e3 * list_sum(list_transform(h, lambda e: 1 - sin(radians(e)))) / 360')} AS dose FROM ({HORIZON})")
def _(spark, t):
    return _horizon(t).select("row", "col", rounded(moon.dose(F.col("h"))).alias("dose"))


@query("prj01_lonlat", f"SELECT row, col, {r4('degrees(atan2(x, y))')} AS lon, {r4('degrees(2 * atan(sqrt(x * x + y * y) / (2 * 17374e2))) - 90')} AS lat FROM ({TERRAIN}) WHERE x <> 0 OR y <> 0")
def _(spark, t):
    lon, lat = moon.map_to_lonlat(F.col("x"), F.col("y"))
    return terrain(t).filter("x <> 0 OR y <> 0").select("row", "col", rounded(lon).alias("lon"), rounded(lat).alias("lat"))


SKY_COLUMNS = ("s_suppkey AS i", "147e6 * cos(radians(s_suppkey * 7e0)) AS b1", "147e6 * sin(radians(s_suppkey * 7e0)) AS b2", "4e6 * cos(radians(s_suppkey * 3e0)) AS b3")
SKY = f"SELECT {', '.join(SKY_COLUMNS)} FROM supplier"


@query("prj04_azel", f"""WITH s AS ({SKY}), k AS (SELECT *, radians(40e0) AS lo, radians(-85e0) AS la FROM s), u AS (SELECT *, b1 - cos(la) * cos(lo) * 17374e-1 AS ax, b2 - cos(la) * sin(lo) * 17374e-1 AS ay, b3 - sin(la) * 17374e-1 AS az FROM k),
d AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS dist, -sin(lo) * ax + cos(lo) * ay AS e, -sin(la) * cos(lo) * ax - sin(la) * sin(lo) * ay + cos(la) * az AS n, cos(la) * cos(lo) * ax + cos(la) * sin(lo) * ay + sin(la) * az AS up FROM u)
SELECT i, {r4('(degrees(atan2(e, n)) + 36e1) % 36e1')} AS azimuth, {r4('degrees(asin(up / dist))')} AS elevation, {r4('degrees(asin(6957e2 / dist))')} AS radius FROM d""")
def _(spark, t):
    s = t.supplier.selectExpr(*SKY_COLUMNS)
    az, el, radius = moon.azel([F.col("b1"), F.col("b2"), F.col("b3")], F.radians(F.lit(40.0)), F.radians(F.lit(-85.0)), moon.R, 695_700.0)
    return s.select("i", rounded(az).alias("azimuth"), rounded(el).alias("elevation"), rounded(radius).alias("radius"))


@query("top08_best_sample", "SELECT az, el FROM (SELECT az, el, row_number() OVER (ORDER BY el DESC, az) AS n FROM (" + SAMPLES + ") WHERE abs((az - 315e0 + 18e1 + 36e1) % 36e1 - 18e1) < 25) WHERE n = 1")
def _(spark, t):
    near = _samples(t).filter(F.abs(angle_between(F.col("az"), 315.0)) < 25)
    return near.agg(F.max_by(F.struct("az", "el"), F.struct("el", -F.col("az"))).alias("b")).select("b.az", "b.el")


@query("join18_horizons")
def _(spark, t):
    cells = saved(terrain(t))
    model = (cells.select("row", "col", "z"), N, N, -HALF - CELL / 2, HALF + CELL / 2, CELL)
    return moon.tiled_horizons(cells, [model], saved, tile=32)


@query("prj11_projected", f"""SELECT ok, ln, image_id, count(*) AS n, {r4('sum(CASE WHEN depth > 5e-2 THEN 5e2 * x / depth + 32e1 END)')} AS u FROM (SELECT ok, ln, i.range AS image_id, x, z + i.range * 1e0 - 1 AS depth FROM ({POINTS}), range(3) i) GROUP BY 1, 2, 3""")
def _(spark, t):
    seen = cloud.projected(points(t), _images(spark))
    return seen.groupBy("ok", "ln", "image_id").agg(F.count("*").alias("n"), rounded(F.sum("u")).alias("u"))


def _images(spark):
    turn = ("array(1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0) AS r", "array(0e0, 0e0, id * 1e0 - 1) AS t")
    return spark.range(3).selectExpr("id AS image_id", *turn, "5e2 AS fx", "5e2 AS fy", "32e1 AS cx", "24e1 AS cy", "4096 AS width", "4096 AS height")


@query("join13_visible")
def _(spark, t):
    p = points(t).select("ok", "ln", "x", "y", "z", F.col("w").alias("opacity"), F.lit(0.02).alias("radius"))
    return cloud.visible(p, _images(spark)).groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct("ok").alias("points"))


@query("agg19_gains")
def _(spark, t):
    seen = t.lineitem.selectExpr("l_linenumber AS frame", "l_partkey AS point", "l_extendedprice * (1 + l_linenumber) AS value")
    return registration.alternating_medians(seen, saved)


@query("win08_path_length", f"""SELECT ok, count(*) AS points, {r4('sum(d)')} AS length FROM (SELECT l_orderkey AS ok, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 97) * 125e-3 AS x, (l_suppkey % 89) * 125e-3 AS y FROM lineitem)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) GROUP BY 1""")
def _(spark, t):
    p = t.lineitem.selectExpr("l_orderkey AS ok", "l_linenumber", "l_partkey", "l_suppkey", "(l_partkey % 97) * 125e-3 AS x", "(l_suppkey % 89) * 125e-3 AS y")
    return cloud.path_lengths(p, ["ok"], ["l_linenumber", "l_partkey", "l_suppkey"]).withColumn("length", rounded(F.col("length")))
