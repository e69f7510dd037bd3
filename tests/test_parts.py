"""Whole scenes, columns patched by position, colour harmonics and edges."""

import json

import numpy as np
import pytest
from test_sources import png

from sitewright.operators import cloud, grid
from sitewright.sources import records


def scene(path, **parts):
    path.mkdir(exist_ok=True)
    samples = np.arange(12).reshape(3, 4) * 5000
    (path / "terrain.png").write_bytes(png(samples, 16, [0]))
    told = {"scene_id": "s", "name": "a scene", "body": "mars", "terrain": {"file": "terrain.png", "size_m": [8.0, 6.0], "resolution_m": 2.0, "z_min_m": -10.0, "z_max_m": 55.535}}
    (path / "scene.json").write_text(json.dumps(told | parts))
    return samples


def test_a_scene_of_a_terrain_alone(spark, tmp_path):
    samples = scene(tmp_path / "s")
    got = records.load_bundle(spark, str(tmp_path / "s"))
    assert {(r.row, r.col): round(r.z, 6) for r in got["terrain"].collect()} == {(r, c): round(-10 + samples[r, c] / 65535 * 65.535, 6) for r in range(3) for c in range(4)}
    assert got["pins"].count() == got["rasters"].count() == 0
    assert got["surface"] is got["layers"] is got["shielding"] is got["texture"] is None and got["manifest"].first().body == "mars"


def test_a_scene_with_all_parts(spark, tmp_path):
    at = tmp_path / "s"
    at.mkdir()
    (at / "surface.png").write_bytes(png(np.array([[0, 1], [65535, 1]]), 16, [0]))
    (at / "pins.json").write_text(json.dumps([{"id": "p1", "name": "rock", "position_site": [1, 2, 3], "kind": "target", "measurements": [{"label": "Si", "value": "3%", "source_url": "u"}], "sample": {"name": "Core", "number": 4}, "source_urls": ["u"]}]))
    (at / "rasters").mkdir()
    (at / "rasters" / "index.json").write_text(json.dumps([{"name": "ice", "file": "ice.png", "bits": 8, "min": 0, "max": 1, "unit": "%"}]))
    (at / "shielding.json").write_text(json.dumps({"series": [{"name": "gcr", "points": [{"depth_m": 0, "factor": 1}, {"depth_m": 1.5, "factor": 0.5, "areal": 200}]}]}))
    (at / "splat").mkdir()
    fields = [{"name": "height", "type": "f32", "offset": 0}, {"name": "kind", "type": "u16", "offset": 4}]
    (at / "splat" / "layers.json").write_text(json.dumps({"count": 2, "record_bytes": 6, "fields": fields}))
    (at / "splat" / "layers.bin").write_bytes(np.array([(1.5, 7), (2.5, 65535)], np.dtype([("a", "<f4"), ("b", "<u2")])).tobytes())
    scene(at, pins="pins.json", rasters="rasters/index.json", shielding="shielding.json", layers="splat/layers.json", splat_surface={"file": "surface.png", "z_min_m": 0.0, "z_max_m": 10.0})
    got = records.load_bundle(spark, str(at))
    assert [r.z for r in got["surface"].orderBy("row", "col").collect()] == [None, 0.0, 10.0, 0.0]
    pin = got["pins"].first()
    assert (pin.name, pin.position_site, pin.measurements[0].value, pin.sample.number) == ("rock", [1.0, 2.0, 3.0], "3%", 4)
    assert got["rasters"].first().path == f"{at}/rasters/ice.png"
    assert [tuple(r) for r in got["shielding"].orderBy("depth_m").collect()] == [("gcr", 0.0, 1.0, None), ("gcr", 1.5, 0.5, 200.0)]
    assert [(r.idx, r.height, r.kind) for r in got["layers"].orderBy("idx").collect()] == [(0, 1.5, 7), (1, 2.5, None)]


def test_a_scene_without_terrain_is_refused(spark, tmp_path):
    (tmp_path / "scene.json").write_text(json.dumps({"scene_id": "s"}))
    with pytest.raises(ValueError, match="no terrain"):
        records.load_bundle(spark, str(tmp_path))


def test_patches_that_do_not_fit_are_refused(spark):
    layers = spark.createDataFrame([(i, i * 1.0, 0) for i in range(6)], "idx long, height double, class int")
    values = lambda *rows: spark.createDataFrame(list(rows), "idx long, class int")
    once = records.patched(layers, "class", values((1, 5), (3, 7)), 6)
    want = [(0, None), (1, 5), (2, None), (3, 7), (4, None), (5, None)]
    assert [(r.idx, r["class"]) for r in once.orderBy("idx").collect()] == want
    assert [(r.idx, r["class"]) for r in records.patched(once, "class", values((1, 5), (3, 7)), 6).orderBy("idx").collect()] == want
    for rows, count, why in (([(1, 5)], 7, "7 are stated"), ([(1, 5), (1, 6)], 6, "more than one"), ([(6, 5)], 6, "past the last")):
        with pytest.raises(ValueError, match=why):
            records.patched(layers, "class", values(*rows), count)
    fields = [{"name": "a", "type": "f16", "offset": 6}, {"name": "b", "type": "u8x4", "offset": 8}, {"name": "c", "type": "u16", "offset": 12}]
    records.refuse_overlap(fields, "b", 8, 4)
    with pytest.raises(ValueError, match="field c overlaps"):
        records.refuse_overlap(fields, "b", 9, 4)
    with pytest.raises(ValueError, match="field b overlaps"):
        records.refuse_overlap(fields, "new", 11, 1)


def test_a_colour_looks_the_same_from_a_turned_side(spark):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rest = rng.normal(size=9)
    row = spark.createDataFrame([(0.0, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0], rest.tolist()), (1.0, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0], [])], "x double, y double, z double, quat array<double>, rest array<double>")
    whole, none = cloud.rotated(row, turn.tolist()).orderBy("x").collect() if turn[0, 0] > 0 else cloud.rotated(row, turn.tolist()).orderBy("x", ascending=False).collect()
    assert list(none.rest) == []
    colour = lambda c, d: [c[3 * k] * -d[1] + c[3 * k + 1] * d[2] + c[3 * k + 2] * -d[0] for k in range(3)]
    for d in rng.normal(size=(5, 3)):
        assert np.allclose(colour(whole.rest, turn @ d), colour(rest, d))
    with pytest.raises(Exception, match="first band"):
        cloud.rotated(row.limit(1).selectExpr("x", "y", "z", "quat", "array(1D, 2D) AS rest"), turn.tolist()).collect()


def test_paths_with_exact_ends(spark):
    points = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(4)] + [("b", 0, 5.0, 5.0, 5.0)], "k string, n int, x double, y double, z double")
    ends = spark.createDataFrame([("a", 0.5, None, None, 3.0, 4.0, 0.0)], "k string, from_x double, from_y double, from_z double, to_x double, to_y double, to_z double")
    got = {r.k: (r.points, r.length) for r in cloud.path_lengths(points, ["k"], ["n"], ("x", "y", "z"), ends).collect()}
    assert got == {"a": (4, pytest.approx(0.5 + 1 + math_hypot(1, 4))), "b": (1, None)}


def math_hypot(a, b):
    return float(np.hypot(a, b))


def test_edges_of_an_image(spark):
    flat = [(1, r, c, 3.0) for r in range(12) for c in range(16)]
    rng = np.random.default_rng(2)
    noisy = rng.random((14, 18)) * 100
    rows = flat + [(2, r, c, float(noisy[r, c])) for r in range(14) for c in range(18)]
    got = {r.image_id: r.detail for r in grid.edge_strength(spark.createDataFrame(rows, "image_id int, row int, col int, value double")).collect()}
    small = np.array([[noisy[r : r + 4, c : c + 4].mean() for c in range(0, 18, 4)] for r in range(0, 14, 4)])
    wide = np.pad(small, 1, mode="reflect")
    lap = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * small
    assert got == {1: 0.0, 2: pytest.approx(float(np.median(np.abs(lap))))}
