"""Rounds of iterative operators, written where the cluster's checkpoints go and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """This application's part of the folder of ``spark.checkpoint.dir``, removed when the driver's JVM ends. Where that is
    unset and the master is local, a temporary folder takes its place; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "sitewright-rounds")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/rounds-{spark.sparkContext.applicationId}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return fs.makeQualified(folder).toString()


def saved(df: DataFrame) -> DataFrame:
    """``df`` by way of Parquet in ``own_folder``."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, each: int) -> DataFrame:
    """``rows``, of a table whose file may be one split, dealt to tasks of about ``each`` rows: for work that is long per row. A
    count of whole rows comes from the file's footers."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each + 1))
