"""Horizons over tiles against the march over whole models."""

import numpy as np
import pytest

from sitewright.operators import moon
from sitewright.operators.saving import saved


def cells_of(spark, dem):
    rows = [(r, c, float(dem[r, c])) for r in range(dem.shape[0]) for c in range(dem.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, z double").repartition(4)


@pytest.mark.parametrize("tile", [7, 64])
def test_tiles_and_rings_see_what_a_whole_model_shows(spark, tile):
    rng = np.random.default_rng(2)
    side = 20.0
    fine = (rng.random((50, 41)) * 30).cumsum(1) / 8
    coarse = rng.random((40, 40)) * 250
    west, north, far_west, far_north = 300.0, 900.0, -1500.0, 2600.0
    observers = [(r, c, west + (c + 0.5) * side, north - (r + 0.5) * side, float(fine[r, c])) for r in range(0, 50, 9) for c in range(0, 41, 8)] + [(99, 99, 5000.0, 5000.0, 10.0)]
    seen = spark.createDataFrame(observers, "row int, col int, x double, y double, z double")
    whole = {(r.row, r.col): r.h for r in moon.horizons(seen, fine, west, north, side, (coarse, far_west, far_north, 100.0), azimuths=72, far_m=2500.0).collect()}
    models = [(cells_of(spark, fine), 50, 41, west, north, side), (cells_of(spark, coarse), 40, 40, far_west, far_north, 100.0)]
    got = {(r.row, r.col): r.h for r in moon.tiled_horizons(seen, models, saved, azimuths=72, far_m=2500.0, tile=tile, together=5).collect()}
    assert set(got) == set(whole)
    for k, h in whole.items():
        assert np.allclose(got[k], h, atol=1e-9)


def test_distant_rings_that_cannot_matter_are_not_visited(spark, monkeypatch):
    dem = np.zeros((96, 96))
    dem[40:57, 40:57] = 300.0
    dem[47:50, 47:50] = 0.0  # a pit whose walls hide all else
    seen = spark.createDataFrame([(48, 48, 0.0, 0.0, 0.0)], "row int, col int, x double, y double, z double")
    visited = []
    plain = moon._highest
    monkeypatch.setattr(moon, "_highest", lambda units, *a: visited.extend(map(tuple, units.select("tr", "tc").collect())) or plain(units, *a))
    models = [(cells_of(spark, dem), 96, 96, -970.0, 970.0, 20.0)]
    got = moon.tiled_horizons(seen, models, saved, azimuths=36, far_m=1300.0, tile=8).first().h
    assert min(got) > 60 and 0 < len(visited) < 12


def test_models_with_holes_are_refused(spark):
    cells = cells_of(spark, np.zeros((9, 9))).filter("row <> 3 OR col <> 4")
    seen = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "row int, col int, x double, y double, z double")
    with pytest.raises(ValueError, match="holes"):
        moon.tiled_horizons(seen, [(cells, 9, 9, -9.0, 9.0, 2.0)], saved, azimuths=4, far_m=50.0, tile=4)
