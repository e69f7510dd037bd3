"""Helpers that several operators use: the shared folder, written intermediates, and file access from tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A URI of this application's part of the folder that ``spark.checkpoint.dir`` names.

    Driver and executors see that folder alike. Where the setting is missing and all tasks run in the driver's machine
    (a local master), a temporary folder takes its place; on a cluster that is an error. The part is removed when the
    driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "sitewright-shared")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/sitewright-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage is cut and a lost executor costs nothing.
    ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, few: DataFrame, on: str, by: str, salts: int = 8) -> DataFrame:
    """Inner join for keys that are hot in ``many``: its rows of a key are dealt ``salts`` ways by the column ``by``, and
    those of ``few``, a small table with a row a key, are repeated as often."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = few.withColumn("_salt", F.explode(F.array(*[F.lit(n).cast("long") for n in range(salts)])))
    return dealt.join(repeated, [on, "_salt"]).drop("_salt")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of an empty folder in the shared folder, for files that tasks write."""
    uri = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def file_system(uri: str):
    """(file system, path) of a URI, for use inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def short_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound an Arrow batch in bytes, for rows that are long themselves."""
    held = spark._jsparkSession.sessionState().conf().getConfString("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
