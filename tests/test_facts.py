"""Lines of all kinds about a scene, in order."""

from sitewright.operators import text


def test_all_kinds_of_lines_take_their_places(spark):
    make = spark.createDataFrame
    scenes = make([("s", "mars", "Ridge", 1000, 900, 2, "-5", "40", ["one", "two"]), ("t", "moon", "Rim", 10, 9, 5, "0", "1", ["three"])], "scene_id string, body string, title string, width int, depth int, resolution int, z_min string, z_max string, sources array<string>")
    pins = make([("s", 1, "rock", 1.4, -2.0, "a rock", [("Si", "3%")])], "scene_id string, pos int, name string, x double, y double, summary string, measurements array<struct<label: string, value: string>>")
    sites = make([("s", 1, 10.0, 20.0, 77)], "scene_id string, rank int, x double, y double, grade int")
    modules = make([("s", 1, "solar_field", "Ada", 1.0, 2.0, "grade 5")], "scene_id string, pos int, kind string, author string, x double, y double, score string")
    others = text.scene_details(
        splats=make([("s", 635906), ("t", None)], "scene_id string, count long"),
        data=make([("s", True, False, True), ("t", False, False, False)], "scene_id string, layers boolean, rasters boolean, shielding boolean"),
        samples=make([("s", 1, "Core", 4)], "scene_id string, pos int, name string, number int"),
        rovers=make([("s", 12.6, -3.2)], "scene_id string, x double, y double"),
        routes=make([("s", "rock", "driving", 120.5, 9.96), ("t", "rim", "planning", None, None)], "scene_id string, label string, status string, length_m double, max_slope double"),
        shielding=make([("s", "paper", [(0.0, 1.0), (1.5, 0.5)], "Only so.", False), ("s", "deep paper", [(2.0, 0.4)], None, True)], "scene_id string, citation string, points array<struct<depth_m: double, factor: double>>, limits string, deep boolean"),
        rasters=make([("s", 0, "ice", "", "orbiter", "20 m", True, "how much ice"), ("s", 1, "dose", "mSv", "model", "20 m", False, None)], "scene_id string, pos int, name string, unit string, source string, resolution string, estimate boolean, description string"),
        fields=make([("s", 0, "slope", "deg", "terrain", None)], "scene_id string, pos int, name string, unit string, source string, resolution string"),
        placing=make([("s", "landing_pad", 5.0, 6.0, "grade 9"), ("t", None, None, None, None)], "scene_id string, kind string, x double, y double, score string"),
    )
    got = {r.scene_id: r.facts.split("\n") for r in text.scene_facts(scenes, pins, sites, modules, others=others).collect()}
    assert got["s"] == [
        "Body: mars. Site: Ridge.",
        "Terrain window: 1000 m by 900 m at 2 m per pixel; elevation from -5 m to 40 m relative to the site origin.",
        "A Gaussian splat of the ground near the rover, built from rover photos (635,906 Gaussians).",
        "Data in this scene: per-Gaussian splat layers, radiation shielding estimates.",
        "Sources: one; two.",
        'Science pin "rock" at (1, -2) m: a rock',
        "  Sample: Core (no. 4).",
        "  Cited measurement: Si: 3%",
        "Rover: at (13, -3) m.",
        "Rover route to rock: driving, 121 m long, steepest slope 10.0 degrees.",
        "Best site 1: (10, 20) m, grade 77 of 100 (computed by the app).",
        "Regolith cover on a module is scored with a deeper cited series (deep paper; an estimate): 2.0 m: factor 0.4. Linear between points is this app's choice; nothing beyond the deepest point. This series and the next one have different baselines and are never mixed.",
        "Radiation shielding by regolith depth (dose factor relative to no cover; paper): 0.0 m: factor 1.0; 1.5 m: factor 0.5. Values between these points are this app's linear interpolation, and there is no data beyond the deepest point. Only so.",
        'Terrain layer "ice" (no unit; orbiter, 20 m; an estimate): how much ice',
        'Terrain layer "dose" (mSv; model, 20 m)',
        'Splat layer "slope" (deg): terrain',
        "The user's module being placed now: landing pad at (5, 6) m: grade 9.",
        "Modules built in the shared session (1):",
        "  1. solar field by Ada at (1, 2) m: grade 5.",
        "Coordinates are meters east and north of the site origin.",
    ]
    assert "No Gaussian splat in this scene." in got["t"] and "Data in this scene: terrain only." in got["t"] and "Rover route to rim: planning." in got["t"]
    assert got["t"][-3:] == ["The user is not placing a module right now.", "Nobody has built a module in the shared session yet.", "Coordinates are meters east and north of the site origin."]
