"""Queries of relational and shared-state operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r4 as rounded
from ..operators import tables
from ..streaming import state
from .registry import query, r4


@query("win11_keep_newest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 12")
def _(spark, t):
    return tables.newest(t.events, ["user_id"], [F.col("event_id").desc()], 12).select("user_id", "event_id")


@query("str01_upsert_by_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, t):
    return tables.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("str09_throttle", "SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, floor(epoch_us(ts) / 3600000000) AS w, row_number() OVER (PARTITION BY user_id, event_type, floor(epoch_us(ts) / 3600000000) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY user_id, event_type, w")
def _(spark, t):
    return state.throttled(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "1 hour", ["event_id"]).select("user_id", "event_type", "event_id")


LIFE = "CASE event_type WHEN 'click' THEN 'connect' WHEN 'error' THEN 'disconnect' WHEN 'purchase' THEN 'sign_out' ELSE 'move' END"


@query("str04_lifecycle", f"""WITH e AS (SELECT user_id, event_id, value, {LIFE} AS kind FROM events),
l AS (SELECT user_id, coalesce(max(CASE WHEN kind = 'connect' THEN event_id END), -1) AS up, coalesce(max(CASE WHEN kind = 'disconnect' THEN event_id END), -1) AS down, coalesce(max(CASE WHEN kind = 'sign_out' THEN event_id END), -1) AS out, coalesce(max(CASE WHEN kind = 'move' THEN event_id END), -1) AS moved FROM e GROUP BY 1)
SELECT l.user_id, up > down AS online, CASE WHEN moved > greatest(down, out) THEN e.value END AS cursor FROM l LEFT JOIN e ON e.event_id = moved AND e.user_id = l.user_id""")
def _(spark, t):
    e = t.events.select("user_id", F.col("event_id").alias("seq"), F.expr(LIFE).alias("kind"), F.col("value").alias("pose"))
    return state.presence(e).withColumnRenamed("pose", "cursor")


@query("str06_repeated_ids", "SELECT user_id, v AS render_id, min(event_id) AS event_id FROM (SELECT *, CAST(value AS INT) AS v FROM (SELECT user_id, event_id, floor(value) AS value FROM events)) GROUP BY 1, 2")
def _(spark, t):
    e = t.events.select("user_id", F.floor("value").cast("int").alias("render_id"), "event_id")
    return state.first_of_id(e, ["user_id", "render_id"], "event_id").select("user_id", "render_id", "event_id")


@query("str03_edits", """WITH e AS (SELECT user_id AS id, event_id AS seq, event_type, value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'insert' ELSE 'update' END AS op FROM events),
k AS (SELECT *, max(CASE WHEN op IN ('delete', 'insert') THEN seq END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM e),
a AS (SELECT k.*, b.op AS before FROM k LEFT JOIN e b ON b.id = k.id AND b.seq = k.edge)
SELECT id, count(*) FILTER (op = 'update' AND coalesce(before, 'delete') = 'delete') AS refused, arg_max(op, seq) FILTER (op <> 'update') IS NOT DISTINCT FROM 'insert' AS alive,
  CASE WHEN arg_max(op, seq) FILTER (op <> 'update') = 'insert' THEN arg_max(value, seq) FILTER (op = 'insert' OR (op = 'update' AND before = 'insert')) END AS value FROM a GROUP BY 1""")
def _(spark, t):
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "insert").otherwise("update")
    return state.edits(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "value"))


@query("agg12_confusion", "SELECT l_returnflag AS label, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, t):
    return tables.confusion(t.lineitem.selectExpr("l_returnflag AS label", "l_linestatus AS predicted"), "label", "predicted")


CLASSES = "SELECT l_linenumber AS a, CAST(l_suppkey % 8 AS INT) AS b FROM lineitem"


@query("agg12_iou", f"""WITH c AS ({CLASSES}), k AS (SELECT a AS c FROM c UNION SELECT b FROM c), m AS (SELECT k.c, count(*) FILTER (a = k.c AND b = k.c) AS tp, count(*) FILTER (b = k.c AND a <> k.c) AS fp, count(*) FILTER (a = k.c AND b <> k.c) AS fn FROM k, c GROUP BY 1)
SELECT c AS class, tp, fp, fn, {r4('tp / greatest(fp + fn + tp, 1)')} AS iou FROM m""")
def _(spark, t):
    m = tables.class_agreement(tables.confusion(t.lineitem.selectExpr("l_linenumber AS a", "CAST(l_suppkey % 8 AS INT) AS b"), "a", "b"), "a", "b")
    return m.withColumn("iou", rounded(F.col("iou")))


@query("agg13_class_histogram", "SELECT CAST(range AS INT) AS class, count(l_linenumber) AS n, floor(count(l_linenumber) * 1e4 / (SELECT count(*) FROM lineitem) + 5e-1) / 1e4 AS share FROM range(10) LEFT JOIN lineitem ON l_linenumber = range GROUP BY 1")
def _(spark, t):
    h = tables.histogram(t.lineitem, "l_linenumber", 10)
    return h.withColumn("share", F.floor(F.col("share") * 1e4 + 0.5) / 1e4)


@query("agg14_survey", "SELECT year(o_orderdate) AS sol, o_orderstatus AS camera, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, t):
    return tables.survey(t.orders, [F.year("o_orderdate").cast("long").alias("sol"), F.col("o_orderstatus").alias("camera")])


@query("set02_replace_by_key", "SELECT s_suppkey AS key, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def _(spark, t):
    new = t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return tables.replaced(t.supplier.selectExpr("s_suppkey AS key", "s_name AS name"), new, "key")


@query("set03_append_missing", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, t):
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return tables.appended(old, t.supplier.selectExpr("s_suppkey AS key", "s_name AS name"), "key")


@query("flt08_access", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_nationkey, c_mktsegment) IN (SELECT n_nationkey, 'BUILDING' FROM nation WHERE n_regionkey = 1)")
def _(spark, t):
    members = t.customer.select("c_custkey", F.col("c_nationkey").alias("org_id"), F.concat("c_mktsegment", F.lit("#room7")).alias("scene"))
    access = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("org_id"), F.lit("BUILDING").alias("scene_id"))
    return tables.accessible(members, access, F.col("scene")).select("c_custkey")


@query("set04_first_free", "SELECT s_suppkey, coalesce(list_filter(['red', 'green', 'blue'], lambda c: NOT list_contains(CASE s_suppkey % 4 WHEN 0 THEN ['red'] WHEN 1 THEN ['red', 'green'] WHEN 2 THEN ['red', 'green', 'blue'] ELSE ['blue'] END, c))[1], 'grey') AS colour FROM supplier")
def _(spark, t):
    taken = F.expr("CASE s_suppkey % 4 WHEN 0 THEN array('red') WHEN 1 THEN array('red', 'green') WHEN 2 THEN array('red', 'green', 'blue') ELSE array('blue') END")
    return t.supplier.select("s_suppkey", tables.first_free(["red", "green", "blue"], taken, F.lit("grey")).alias("colour"))


@query("snk16_within_budget", "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS s FROM events) WHERE s <= 60")
def _(spark, t):
    return tables.within_budget(t.events, ["user_id"], [F.col("event_id").desc()], F.length("props"), 60).select("user_id", "event_id")


@query("join10_snapshot", "SELECT o_orderkey, coalesce(c_name, 'someone') AS author FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def _(spark, t):
    users = t.customer.filter("c_custkey % 3 <> 0").selectExpr("c_custkey AS o_custkey", "c_name AS author")
    return tables.with_authors(t.orders.select("o_orderkey", "o_custkey"), users, "o_custkey").select("o_orderkey", "author")


@query("agg29_presence", f"SELECT user_id % 10 AS scene, count(*) AS people FROM (SELECT user_id, max(CASE WHEN {LIFE} = 'connect' THEN event_id ELSE -1 END) > max(CASE WHEN {LIFE} = 'disconnect' THEN event_id ELSE -1 END) AS online FROM events GROUP BY 1) WHERE online GROUP BY 1")
def _(spark, t):
    e = t.events.select("user_id", F.col("event_id").alias("seq"), F.expr(LIFE).alias("kind"), F.col("value").alias("pose"))
    return state.presence(e).filter("online").groupBy((F.col("user_id") % 10).alias("scene")).agg(F.count("*").alias("people"))
