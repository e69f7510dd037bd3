"""Shards by jump consistent hashing.

A key jumps through ever larger shard counts: from shard b, which it holds while there are up to ``leaves_at`` - 1 shards,
to the next. Where a jump leads is drawn from the key alone, so no table of a ring is kept, and when a shard is appended a
row either stays or moves to the new shard: the share 1 / (shards + 1) of all rows moves, which is the least that keeps
shards even.

Rows are stored as Parquet, a folder a shard, in ranges of the key's hash; a row carries the count at which it leaves its
shard. A shard is therefore appended by one scan of that column and a write of the rows that move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Fixed value of the published method: the factor of its linear congruential generator.
_FACTOR = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each unsigned 64-bit key among ``shards``; the least number of shards at which it is in another)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        shard[going] = ahead[going]
        drawn = state[going] * _FACTOR + np.uint64(1)
        state[going] = drawn
        step = 2.0**31 / ((drawn >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((shard[going] + 1).astype(np.float64) * step).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard, ahead + 1


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with ``_draw``, the first 16 hexadecimal digits of the MD5 sum of the id, ``_shard`` and ``_leaves_at``.

    The id and the number of shards decide; for a row without an id its text takes the id's place.
    """

    @F.pandas_udf("shard int, leaves_at long")
    def placed(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        shard, leaves = jump(high.to_numpy(np.uint64) << np.uint64(32) | low.to_numpy(np.uint64), shards)
        return pd.DataFrame({"shard": shard.astype(np.int32), "leaves_at": leaves})

    stand_in = F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))
    half = lambda at: F.conv(F.substring("_draw", at, 8), 16, 10).cast("long")
    drawn = docs.withColumn("_draw", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), stand_in)), 1, 16))
    made = drawn.withColumn("_placed", placed(half(1), half(9)))
    return made.withColumn("_shard", F.col("_placed.shard")).withColumn("_leaves_at", F.col("_placed.leaves_at")).drop("_placed")


def write(docs: DataFrame, folder: str, shards: int = 8, file_rows: int = 16384) -> None:
    """Store ``doc_id, text`` of all rows of ``docs`` under ``folder``, a folder a shard, in ranges of about ``file_rows`` rows.

    Within a shard, rows are in the order of ``_draw`` and id. A range that rows of one id fill far beyond the others is
    dealt into several files, whose rows are in that order each.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    rows = own.count()
    ranges = max(-(-rows // (shards * file_rows)), -(-3 * spark.sparkContext.defaultParallelism // shards))
    in_range = F.expr(f"cast(floor(cast(conv(substring(_draw, 1, 8), 16, 10) as long) * {ranges} / 4294967296) as int)")
    placed = assign(own, shards).withColumn("_range", in_range)
    most = 4 * max(1, rows // (shards * ranges))
    hot = placed.groupBy("_shard", "_range").count().filter(F.col("count") > most)
    hot = written(hot.select("_shard", "_range", F.ceil(F.col("count") / most).alias("_files")), "hot")
    placed = placed.join(hot, ["_shard", "_range"], "left")
    placed = placed.withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.coalesce("_files", F.lit(1)).cast("long"))).drop("_files")
    dealt = placed.repartition(shards * ranges, "_shard", "_range", "_file").sortWithinPartitions("_shard", "_range", "_draw", "doc_id")
    dealt.drop("_file").write.partitionBy("_shard", "_range").parquet(folder)


_STORED = "doc_id {}, text string, _draw string, _leaves_at long, _shard int, _range int"


def read(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """The stored rows with ``shard`` and ``slot``, their place in the shard, gapless from 0.

    A slot is the number of rows in the files before, in the order of ranges and names, and the row's place in its own
    file: nothing is sorted, and no window goes over rows. For a folder to which no shard was appended.
    """
    rows = spark.read.schema(_STORED.format(kind)).parquet(folder).select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_index"))
    files = written(rows.groupBy("_shard", "_range", "_name").agg(F.count("*").alias("_rows")), "files")
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("_shard").orderBy("_range", "_name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_shard", "_range", "_name", before.alias("_before"))
    placed = rows.join(files, ["_shard", "_range", "_name"]).withColumn("slot", (F.col("_before") + F.col("_index")).cast("long"))
    return placed.withColumnRenamed("_shard", "shard").drop("_before", "_index", "_name", "_range")


def append_shard(spark: SparkSession, folder: str, shards: int, kind: str = "bigint") -> None:
    """Make ``shards`` shards ``shards + 1``: the rows that leave theirs are written to a new one, and no others.

    They stay in the old files too, where ``live`` passes over them.
    """
    moved = live(spark, folder, shards, kind).filter(F.col("_leaves_at") == shards + 1)
    again = assign(moved.select("doc_id", "text"), shards + 1).withColumn("_range", F.lit(0))
    # the same rows are read and, under another name, written; the write takes effect for readers when it is committed
    again.write.mode("append").partitionBy("_shard", "_range").parquet(folder)


def live(spark: SparkSession, folder: str, shards: int, kind: str = "bigint") -> DataFrame:
    """The rows of a folder that holds ``shards`` shards by now; a row that has left a shard is not read from it."""
    return spark.read.schema(_STORED.format(kind)).parquet(folder).filter(F.col("_leaves_at") > shards)


def sharded(docs: DataFrame, folder: str, shards: int = 8) -> DataFrame:
    """Store ``docs(doc_id, text)`` in ``shards`` shards and return what was stored, a row for each row of ``docs``.

    ``doc_id, text, shard, slot, grown_shard, leaves_at``; ``grown_shard`` is the shard with one more of them. The id
    decides, so copies of a text with ids of their own lie where those ids go; rows of one id lie in one shard, each with
    a slot of its own. A row without an id is placed by its text; null and empty texts are stored as they are. An empty
    table gives no rows. Other columns play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    write(docs, folder, shards)
    grown = F.when(F.col("_leaves_at") == shards + 1, F.lit(shards)).otherwise(F.col("shard")).cast("int")
    stored = read(docs.sparkSession, folder, kind)
    return stored.select("doc_id", "text", "shard", "slot", grown.alias("grown_shard"), F.col("_leaves_at").alias("leaves_at"))
