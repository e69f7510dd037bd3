"""Queries that run as streams: keyed state over the events table, accepted and refused rows in tables of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.saving import own_folder
from ..streaming import keyed
from .registry import query


def _events(t) -> DataFrame:
    """The events table, a file or a folder of them, as a stream; as a pattern, since the path of a stream is a folder or one."""
    kind = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    rows = t.spark.readStream.schema(kind).parquet(f"{t.folder}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(t, stream: DataFrame) -> DataFrame:
    """All rows of a stream once it has taken what there is: those accepted, and those refused with their reason."""
    folder = f"{own_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    keyed.delivered(stream, f"{folder}/accepted", f"{folder}/refused", f"{folder}/checkpoint").awaitTermination()
    kind = stream.schema
    accepted, refused = (t.spark.read.schema(kind).parquet(f"{folder}/{name}").select(*kind.names) for name in ("accepted", "refused"))
    return accepted.unionByName(refused)


@query("str03_stream_edits", """WITH e AS (SELECT user_id AS id, event_id AS seq, value, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'insert' ELSE 'update' END AS op FROM events),
k AS (SELECT *, last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT id, seq, op, CASE WHEN op = 'update' AND before IS DISTINCT FROM 'insert' THEN 'no such id' END AS refused,
  op = 'insert' OR (op = 'update' AND before IS NOT DISTINCT FROM 'insert') AS alive, CASE WHEN op = 'insert' OR (op = 'update' AND before = 'insert') THEN value END AS value FROM k""")
def _(spark, t):
    keyed.with_state_store(spark)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "insert").otherwise("update")
    e = _events(t).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "value", "ts")
    return _run(t, keyed.edits(e, "0 seconds"))


@query("str05_stream_retention", """SELECT user_id % 40 AS scene_id, event_id AS id, CAST(NULL AS VARCHAR) AS refused,
  CASE WHEN lag(event_id, 12) OVER w IS NULL THEN [] ELSE [lag(event_id, 12) OVER w] END AS gone FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY ts, event_id)""")
def _(spark, t):
    keyed.with_state_store(spark)
    e = _events(t).select((F.col("user_id") % 40).alias("scene_id"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"), "ts")
    return _run(t, keyed.retained(e, 12, "0 seconds")).drop("seq")


@query("str07_stream_arrivals", """WITH e AS (SELECT user_id AS scene_id, event_id AS "at", ts, event_id % 4 AS seq_no, CASE event_type WHEN 'click' THEN 'drive' WHEN 'error' THEN 'reset' ELSE 'arrive' END AS kind FROM events),
n AS (SELECT *, count(*) FILTER (kind <> 'arrive') OVER w AS number, last_value(CASE WHEN kind <> 'arrive' THEN kind END IGNORE NULLS) OVER w AS leg FROM e WINDOW w AS (PARTITION BY scene_id ORDER BY ts, "at" ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, kind = 'arrive' AND leg IS NOT DISTINCT FROM 'drive' AND seq_no = number AS fits FROM n),
a AS (SELECT *, coalesce(sum(CAST(fits AS INT)) OVER (PARTITION BY scene_id, number ORDER BY ts, "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c)
SELECT scene_id, "at", kind, CASE WHEN kind = 'arrive' AND NOT (fits AND earlier = 0) THEN 'not the drive under way' END AS refused, number AS now_seq,
  leg IS NOT DISTINCT FROM 'drive' AND earlier = 0 AND NOT fits AS driving FROM a""")
def _(spark, t):
    keyed.with_state_store(spark)
    kind = F.when(F.col("event_type") == "click", "drive").when(F.col("event_type") == "error", "reset").otherwise("arrive")
    e = _events(t).select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("at"), kind.alias("kind"), (F.col("event_id") % 4).alias("seq_no"), "ts")
    return _run(t, keyed.drives(e, "0 seconds"))


@query("str10_stream_access", """SELECT event_id, CASE WHEN m.org IS NULL THEN 'not signed in' WHEN s IS NULL THEN 'no access to ""' WHEN NOT (m.org = n.n_regionkey) THEN 'no access to "' || s || '"' END AS refused
FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN 's' || CAST(user_id % 25 AS VARCHAR) END AS s FROM events) e
LEFT JOIN (SELECT c_custkey AS who, c_nationkey % 5 AS org FROM customer WHERE c_custkey % 4 <> 0) m ON who = user_id JOIN nation n ON n_nationkey = user_id % 25""")
def _(spark, t):
    scene = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("s"), (F.col("user_id") % 25).cast("string"), F.lit("#room")))
    e = _events(t).select("event_id", F.col("user_id").alias("identity"), scene.alias("scene_id"))
    members = t.customer.filter("c_custkey % 4 <> 0").selectExpr("c_custkey AS identity", "c_nationkey % 5 AS org_id")
    access = t.nation.selectExpr("n_regionkey AS org_id", "concat('s', n_nationkey) AS scene_id")
    return _run(t, keyed.checked(e, members, access)).select("event_id", "refused")
