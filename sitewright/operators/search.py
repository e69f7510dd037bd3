"""Text-to-cluster search: relevancy of cluster vectors to a query against negatives, z-scores, selection, highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.maths import dot, sigmoid, unit


def centroids(members: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid, size``: means of vectors by one aggregate with partial sums, of any length."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = members.select(label, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    means = vectors.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("size"))
    return means.select(label, vector_to_array("_m").alias("centroid"), "size")


def relevancy(vector: Column, query: Column, negatives: Column) -> Column:
    """sigmoid(10 (cos to the query - greatest cos to a negative)); all as unit vectors."""
    v = unit(vector)
    against = F.array_max(F.transform(negatives, lambda n: dot(v, n)))
    return sigmoid(config.RELEVANCY_SLOPE * (dot(v, query) - against))


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """Population z-score over all clusters (a few hundred rows by construction); 0 where all are equal."""
    everything = Window.partitionBy()
    deviation = F.stddev_pop(value).over(everything)
    return df.withColumn("z", F.when(deviation > 0, (F.col(value) - F.avg(value).over(everything)) / deviation).otherwise(0.0))


def select_clusters(scored: DataFrame, key: str, z_min: float = config.RELEVANCY_Z) -> DataFrame:
    kept = scored.filter(F.col("z") >= z_min)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.col("z").desc(), key)))


def highlighted(members: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Members of the chosen clusters."""
    return members.join(chosen.select(key), key, "left_semi")


def ranks_or_minus_one(members: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Members with the rank (from 0) of their cluster, -1 where it was not chosen."""
    return members.join(chosen.select(key, (F.col("rank") - 1).alias("cluster_rank")), key, "left").withColumn("cluster_rank", F.coalesce("cluster_rank", F.lit(-1)))


def k_means(members: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 30, sample_rows: int = 300_000) -> DataFrame:
    """Every member with its cluster of k; fitted on at most ``sample_rows`` by hash order, then all are assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = members.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    sample = rows.withColumn("_h", F.xxhash64(vector)).orderBy("_h").limit(sample_rows)
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(sample)
    return model.transform(rows).drop("_v")
