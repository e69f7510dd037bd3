"""The registry of queries: a name, a function of (spark, folder), and the same in DuckDB's SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(spark, tables)`` under ``name``."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(spark, Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# Fixtures, as expressions that both engines read alike.

#: lineitem as a cloud of points with weights.
POINT_COLUMNS = ("l_orderkey AS ok", "l_linenumber AS ln", "(l_partkey % 97) * 125e-3 AS x", "((l_suppkey * 7 + l_partkey) % 89) * 125e-3 AS y", "l_extendedprice / 1e4 AS z", "l_quantity / 5e1 AS w")
POINTS = f"SELECT {', '.join(POINT_COLUMNS)} FROM lineitem"


def points(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*POINT_COLUMNS)


#: A terrain: a hill, a crater and a ramp on N x N nodes of CELL metres, row 0 in the north, and on them what was measured,
#: the mean price of the line items of each node, in units of 100,000, as metres.
N, CELL = 61, 8.0
X, Y = f"((i % {N}) - {(N - 1) / 2:g}) * {CELL:g}e0", f"({(N - 1) / 2:g} - (i - i % {N}) / {N}) * {CELL:g}e0"
Z = "2e1 * exp(-(x * x + y * y) / 8e3) - 15e0 * exp(-((x - 12e1) * (x - 12e1) + (y + 9e1) * (y + 9e1)) / 25e2) + x * 5e-2 + 6e0 * sqrt((x * x + y * y) / 1e3 + 1e0)"


def measured_columns(n: int) -> tuple[str, ...]:
    return f"CAST(l_partkey % {n} AS INT) AS row", f"CAST(l_suppkey % {n} AS INT) AS col", "CAST(round(l_extendedprice * 1e2) AS BIGINT) AS cents"


def measured_sql(n: int) -> str:
    """Of the line items of each node of an n x n grid, the mean price; sums are of whole cents, so exact."""
    return f"SELECT row, col, sum(cents) / (count(*) * 1e7) AS m FROM (SELECT {', '.join(measured_columns(n))} FROM lineitem) GROUP BY row, col"


def measured(t: Tables, n: int) -> DataFrame:
    return t.lineitem.selectExpr(*measured_columns(n)).groupBy("row", "col").agg(F.expr("sum(cents) / (count(*) * 1e7) AS m"))


SHAPE = f"""SELECT CAST((i - i % {N}) / {N} AS INT) AS row, CAST(i % {N} AS INT) AS col, x, y, {Z} AS z
  FROM (SELECT i, {X} AS x, {Y} AS y FROM (SELECT CAST(range AS DOUBLE) AS i FROM range({N * N})) a) b"""
TERRAIN = f"SELECT row, col, x, y, z + coalesce(m, 0e0) AS z FROM ({SHAPE}) LEFT JOIN ({measured_sql(N)}) USING (row, col)"


def terrain(t: Tables) -> DataFrame:
    base = t.spark.range(N * N).selectExpr("CAST(id AS DOUBLE) AS i").selectExpr("i", f"{X} AS x", f"{Y} AS y")
    shape = base.selectExpr(f"CAST((i - i % {N}) / {N} AS INT) AS row", f"CAST(i % {N} AS INT) AS col", "x", "y", f"{Z} AS z")
    return shape.join(measured(t, N), ["row", "col"], "left").selectExpr("row", "col", "x", "y", "z + coalesce(m, 0e0) AS z")


def r4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 5e-1) / 1e4"
