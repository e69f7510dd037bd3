"""Closed forms, brute force and synthetic recovery for operators that SQL does not express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.functions.maths import lookup_curve
from sitewright.operators import graph, moon, registration, score
from sitewright.operators.saving import saved


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_disc_fraction(spark):
    r = one(spark, *[moon.disc_fraction(F.lit(e), F.lit(0.0), F.lit(0.25)) for e in (-1.0, 0.0, 1.0, 0.1, -0.1)])
    assert r[0] == 0 and r[1] == 0.5 and r[2] == 1 and abs(r[3] + r[4] - 1) < 1e-12


def test_horizon_wraps_and_open_sky(spark):
    ramp = F.transform(F.sequence(F.lit(0), F.lit(359)), lambda a: a.cast("double"))
    flat, high = F.array_repeat(F.lit(0.0), 360), F.array_repeat(F.lit(30.0), 360)
    r = one(spark, moon.horizon_at(ramp, F.lit(-0.5)), moon.open_sky_factor(flat), moon.open_sky_factor(high))
    assert r[0] == 179.5 and abs(r[1] - 1) < 1e-12 and r[2] < 0.51


def test_cone_on_a_plain(spark):
    side = (np.arange(201) - 100) * 10.0
    dem = np.maximum(0, 200.0 - np.hypot(*np.meshgrid(side, side)))
    seen = spark.createDataFrame([(0, 0, 0.0, 0.0, 200.0), (0, 1, 900.0, 0.0, 0.0)], "row int, col int, x double, y double, z double")
    top, foot = [r.h for r in moon.horizons(seen, dem, -1005.0, 1005.0, 10.0, azimuths=4, far_m=2500.0, observer_m=0.0).orderBy("col").collect()]
    assert max(top) < 0
    assert abs(foot[3] - math.degrees(math.atan(200 / 900))) < 0.3 and foot[1] < 0.01


def test_curve_holds_its_ends(spark):
    curve = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(f).alias("f")) for d, f in ((0.0, 1.0), (2.0, 0.5))])
    assert tuple(one(spark, *[lookup_curve(curve, F.lit(x)) for x in (-1.0, 1.0, 9.0)])) == (1.0, 0.75, 0.5)


def test_routes_cost_as_dijkstra(spark):
    rng = np.random.default_rng(3)
    slope = rng.uniform(0, 20, (9, 9))
    nodes = spark.createDataFrame([("s", r, c, float(slope[r, c]), bool(slope[r, c] < 15)) for r in range(9) for c in range(9)], "scene_id string, row int, col int, slope double, passable boolean")
    free = [(r, c) for r in range(9) for c in range(9) if slope[r, c] < 15]
    asked = [(i, "s", *free[i], *free[-1 - i]) for i in range(6)]
    got = {r.request_id: r.cost for r in graph.routes(nodes, spark.createDataFrame(asked, "request_id long, scene_id string, r0 int, c0 int, r1 int, c1 int"), 4.0, 4.0).collect()}
    for i, _, r0, c0, r1, c1 in asked:
        best = {n: math.inf for n in free} | {(r0, c0): 0.0}
        for _ in range(len(free)):
            for a in free:
                for b in free:
                    if a != b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1:
                        best[b] = min(best[b], best[a] + 4 * math.dist(a, b) * (1 + 0.1 * (slope[a] + slope[b]) / 2))
        assert (i in got) == (best[r1, c1] < math.inf) and (i not in got or abs(got[i] - best[r1, c1]) < 1e-9)


def test_top_sites_is_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), int(g)) for i, (x, y, g) in enumerate(zip(rng.uniform(0, 300, 200), rng.uniform(0, 300, 200), rng.integers(0, 50, 200), strict=True))]
    picked = []
    for i, x, y, g in sorted(rows, key=lambda r: (-r[3], r[0])):
        if g > 0 and len(picked) < 8 and all(math.dist((x, y), p[1:3]) >= 60 for p in picked):
            picked.append((i, x, y, g))
    got = score.top_sites(spark.createDataFrame(rows, "idx long, x double, y double, grade int"), 8, 60.0, saved).orderBy("rank").collect()
    assert [r.idx for r in got] == [p[0] for p in picked]
    assert score.top_sites(spark.createDataFrame([], "idx long, x double, y double, grade int"), 8, 60.0, saved).count() == 0


def test_gains_are_recovered(spark):
    rng = np.random.default_rng(1)
    light = rng.uniform(1, 5, 40)
    rows = [(f, p, float(light[p] * g)) for f, g in enumerate((1.0, 0.5, 2.0)) for p in range(40)]
    got = [r.gain for r in registration.alternating_medians(spark.createDataFrame(rows, "frame int, point int, value double"), saved, rounds=4).orderBy("frame").collect()]
    assert np.allclose(got, [1, 0.5, 2])


def plain_gains(rows, rounds):
    f, p, v = (np.array(c) for c in zip(*[r for r in rows if None not in r and 0 < r[2] < math.inf], strict=True))
    v, frames = np.log(v), np.unique(f)
    g = np.zeros(len(frames))
    of = np.searchsorted(frames, f)
    for _ in range(rounds):
        level = {q: np.median((v - g[of])[p == q]) for q in np.unique(p)}
        off = v - np.array([level[q] for q in p])
        g = np.array([np.median(off[f == k]) for k in frames])
        g -= g.mean()
    return dict(zip(frames.tolist(), np.exp(g).tolist(), strict=True))


@pytest.mark.parametrize("most", [1, 40, 65_536])
def test_gains_whatever_the_rows_of_a_point(spark, most):
    """Points with more rows than ``most`` are dealt to several rows: with 1, nearly all; with 40, two of them."""
    rng = np.random.default_rng(4)
    points = [7] * 400 + [9] * 90 + rng.integers(10, 60, 300).tolist() + [99]
    rows = [(int(rng.choice([3, 5, 8, 11])), p, float(rng.lognormal(1.0, 1.0))) for p in points]
    rows += [(3, 7, float("nan")), (5, 7, float("inf")), (8, 9, 0.0), (8, 9, -2.0), (11, 20, None), (None, 7, 3.0), (3, None, 4.0), (77, 9, None)]
    got = registration.alternating_medians(spark.createDataFrame(rows, "frame int, point int, value double"), saved, rounds=3, most=most).collect()
    assert {r.frame: r.gain for r in got} == pytest.approx(plain_gains(rows, 3))
    none = registration.alternating_medians(spark.createDataFrame([], "frame int, point int, value double"), saved, rounds=1, most=most)
    assert none.count() == 0


@pytest.mark.parametrize(("points", "most"), [(40_000, {}), (4, {"most": 20_000})])
def test_rounds_of_gains_shuffle_counts_and_not_rows(spark, points, most):
    """120,000 rows, of points of three rows, or of four points that are dealt to several rows each."""
    n = 120_000
    seen = spark.range(n).selectExpr("id % 3 AS frame", f"id % {points} AS point", "1 + pmod(xxhash64(id), 1000003) / 1e5 AS value")

    def shuffled(rounds):
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        before = sc.statusStore().executorSummary("driver").totalShuffleWrite()
        registration.alternating_medians(seen, saved, rounds=rounds, **most).collect()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite() - before

    each = (shuffled(3) - shuffled(1)) / 2
    assert each < 2 * n  # bytes a round; a row that is shuffled has 8 at least


def test_pieces_of_a_long_path(spark):
    cells = [(0, c) for c in range(60)] + [(2, c) for c in range(5)]
    got = graph.pieces(spark.createDataFrame(cells, "row int, col int"), saved, graph.NEAR4).groupBy("piece").count()
    assert sorted(r["count"] for r in got.collect()) == [5, 60]
