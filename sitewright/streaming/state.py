"""Shared state as folds over keyed events. Each works on a table and, but for ``edits``, on a stream as well.

A fold is an aggregate by key with partial results, so a user with most of the events is no single task. Streams are
folded batch by batch into a table by ``upserted``; a replay of a batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import latest, numbered


def throttled(events: DataFrame, key: list[str], ts: str, every: str, columns: list[str]) -> DataFrame:
    """The newest row of each key and span of time: ``key``, ``columns`` and ``at``. ``ts`` must be a TIMESTAMP.

    On a stream, give it a watermark on ``ts`` first; a span's row then comes when the watermark passes it.
    """
    best = F.max(F.struct(F.col(ts).alias("_ts"), *columns)).alias("_r")
    out = events.groupBy(*key, F.window(ts, every).alias("_w")).agg(best)
    return out.select(*key, F.col("_r._ts").alias("at"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def presence(events: DataFrame) -> DataFrame:
    """``user_id, online, pose`` from ``events(user_id, seq, kind, pose)``.

    Kinds: connect, disconnect (online ends and the cursor goes), sign_out (the cursor goes), move (sets the cursor).
    """
    last = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("seq"))), F.lit(-1))
    moved = F.max(F.when(F.col("kind") == "move", F.struct("seq", "pose")))
    folded = events.groupBy("user_id").agg(last("connect").alias("up"), last("disconnect").alias("down"), last("sign_out").alias("out"), moved.alias("moved"))
    return folded.select("user_id", (F.col("up") > F.col("down")).alias("online"), F.when(F.col("moved.seq") > F.greatest("down", "out"), F.col("moved.pose")).alias("pose"))


def first_of_id(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each id; repeats are ignored."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def edits(events: DataFrame) -> DataFrame:
    """``id, refused, alive, value`` after ordered ``events(id, seq, op, value)``: insert, update, delete.

    An update of an id that is not there is refused; a delete of one passes in silence.
    """
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.last(F.when(F.col("op") != "update", F.col("op")), ignorenulls=True).over(before)
    seen = events.withColumn("_there", F.coalesce(edge, F.lit("delete")) == "insert")
    counts = (F.col("op") == "insert") | ((F.col("op") == "update") & F.col("_there"))
    folded = seen.groupBy("id").agg(
        F.sum(F.when((F.col("op") == "update") & ~F.col("_there"), 1).otherwise(0)).alias("refused"),
        F.max(F.when(F.col("op") != "update", F.struct("seq", "op"))).alias("_edge"),
        F.max(F.when(counts, F.struct("seq", "value"))).alias("_set"),
    )
    alive = F.coalesce(F.col("_edge.op") == "insert", F.lit(False))
    return folded.select("id", "refused", alive.alias("alive"), F.when(alive, F.col("_set.value")).alias("value"))


def arrivals(events: DataFrame) -> DataFrame:
    """Accepted arrivals of ``events(scene_id, seq_no, at, kind)``: those whose number is that of the newest drive before."""
    before = Window.partitionBy("scene_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    driving = F.last(F.when(F.col("kind") != "cursor", F.struct("kind", "seq_no")), ignorenulls=True).over(before)
    seen = events.withColumn("_d", driving)
    return seen.filter((F.col("kind") == "arrive") & (F.col("_d.kind") == "drive") & (F.col("_d.seq_no") == F.col("seq_no"))).drop("_d")


def training_steps(lines: DataFrame) -> DataFrame:
    """``step, loss`` of log lines ``value`` such as "step 120 loss 0.031"; other lines give no rows."""
    pattern = r"step[ =:]+(\d+).*?loss[ =:]+([0-9.eE+-]+)"
    got = lines.filter(F.col("value").rlike(pattern))
    return got.select(F.regexp_extract("value", pattern, 1).cast("long").alias("step"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("loss"))


def with_auto_ids(rows: DataFrame, scope: list[str], order: list[str], save) -> DataFrame:
    """``rows`` with ``id``, from 1 in each scope by ``order``: numbers over all, less those before the scope, so that a scope
    with most of the rows is not one task."""
    all_ = save(numbered(rows, [*scope, *order], "_n", save))
    first = all_.groupBy(*scope).agg(F.min("_n").alias("_first"))
    return all_.join(save(first), scope).withColumn("id", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def replayed(log: DataFrame, pending: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The log with what was pending while offline: rows that were sent twice count once, the first of each key."""
    return first_of_id(log.unionByName(pending), key, seq)


def peer_cursors(cursors: DataFrame, users: DataFrame, me) -> DataFrame:
    """Cursors of people who are online, without one's own, with their names."""
    online = users.filter("online").drop("online")
    return cursors.filter(F.col("identity") != F.lit(me)).join(online, "identity")


BUCKETS = 64


def _versions(spark, path: str) -> list[tuple[int, int]] | None:
    """(bucket, version) of what a table has; None before the first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/v=*"))]
    return [(int(b.removeprefix("bucket=")), int(v.removeprefix("v="))) for b, v in names] or None


def _parts(spark, path: str, schema, chosen: list[tuple[int, int]]) -> DataFrame:
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/bucket={b}/v={v}" for b, v in chosen])


def _newest(versions, before: int | None = None) -> dict[int, int]:
    out: dict[int, int] = {}
    for b, v in versions or []:
        if before is None or v < before:
            out[b] = max(v, out.get(b, -1))
    return out


def current(spark, path: str, schema) -> DataFrame:
    """The table that ``upserted`` keeps: the newest version of each bucket."""
    return _parts(spark, path, schema, sorted(_newest(_versions(spark, path)).items()))


def upserted(
    stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, also: Callable[[DataFrame], None] | None = None, keep: DataFrame | None = None
) -> StreamingQuery:
    """Fold a stream into the table of the latest row by key, in ``BUCKETS`` buckets of keys under ``path``.

    A batch rewrites only the buckets its keys are in, as version ``bucket=<b>/v=<batch>``, from the newest version before
    its own, so a batch that is run again gives the same. Versions that no batch can need again are removed. ``also`` gets
    the table after each batch, as a subscription's snapshot does; ``keep``, a table of scenes, filters it by ``scene_id``.
    """
    schema = stream.schema

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS))
        rows = batch.withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS
            versions = _versions(spark, path)
            before = _newest(versions, number)
            old = _parts(spark, path, schema, [(b, before[b]) for b in touched if b in before])
            folded = latest(old.unionByName(rows.drop("bucket")), key, order).select(*schema.names).withColumn("bucket", bucket).withColumn("v", F.lit(number))
            folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(path)
        finally:
            rows.unpersist()
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b, v in versions or []:
            if b in before and v < before[b]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/v={v}"), True)
        if also:
            now = current(spark, path, schema)
            also(now if keep is None else now.join(keep.select("scene_id"), "scene_id", "left_semi"))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
