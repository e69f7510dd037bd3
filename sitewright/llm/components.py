"""Connected components of a table of links, by rounds of joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import salted_join, written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``; the root is the smallest node of its component.

    Rounds alternate two steps. Large star: each node's greater neighbours are linked to its smallest one. Small star:
    its smaller neighbours and itself are linked to the smallest. Both keep components; the links end as stars around
    the roots, in about log(nodes) rounds. Each round is written to the shared folder. The links of a hot node meet only
    partial aggregates and joins in which they are salted.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    marked = lambda edges: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    before = marked(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, low, "u", by="v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = salted_join(large, low, "u", by="v")
        small = kept.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        mark = marked(edges)
        if mark == before:
            break
        before = mark
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
