"""Every query that has SQL gives the rows that DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitewright import plans

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def as_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    told = duck.execute(plans.ORACLE_SQL[name])
    assert as_rows([tuple(r) for r in got.collect()], got.columns) == as_rows(told.fetchall(), [c[0] for c in told.description])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_queries_without_sql_take_whole_tables_and_default_parameters(spark, monkeypatch):
    from sitewright.operators import cloud, graph, moon, registration, search

    seen = {}

    def watch(module, name):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: seen.update({name: (a, b)}) or f(*a, **b))

    for module, name in ((moon, "tiled_horizons"), (cloud, "visible"), (graph, "routes"), (registration, "alternating_medians"), (search, "k_means")):
        watch(module, name)
    for name in ("join13_visible", "gra01_routes", "agg19_gains", "agg24_k_means", "join18_horizons"):
        plans.QUERIES[name](spark, SMALL)
    rows = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").count()
    assert seen["visible"][0][0].count() == rows("lineitem") and seen["routes"][0][1].count() == rows("supplier")
    seen_from, models = seen["tiled_horizons"][0][:2]
    assert seen_from.count() == 61 * 61 and models[0][0].count() == 61 * 61 and set(seen["tiled_horizons"][1]) == {"tile"}
    assert seen["k_means"][0][2] == 256 and "rounds" not in seen["alternating_medians"][1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "label", "members", "z"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
