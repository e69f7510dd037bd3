"""Requests in short text: intents by ordered rules, pin wording, destinations, citations, prompts and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered

# Fixed patterns of the request language, matched on trimmed lower-case text, in this order.
HELP = r"\b(help|what can you do|commands)\b"
RENDER = r"\b(render|picture|image|concept|visuali[sz]e|imagine|look like|draw)\b"
COVER = r"\b(bury|buried|underground|regolith|cover (it|the)|tunnel (it|this))\b"
DEPTH = r"(\d+(?:\.\d+)?)\s*(cm|centimet|m\b|met)"
TO_PLACE = r"\b(?:to|reach|get to|at)\s+(.+?)[?.!]*$"
IS_REACHABLE = r"\b(?:is|are)\s+(.+?)\s+reachable"
HOMEWARD = r"\b(home|back|start)\b"
DRIVE = r"\b(drive|go|move|head|navigate|roll|send|return)\b"
ROUTE = r"\b(reach|reachable|route|path|get to|can (?:the rover|you|it) go)\b"
WHERE = r"\b(where|best|good|recommend|suggest)\b.*\b(site|spot|place|build|camp|base|land)\b"
SCIENCE = r"\b(mineral|chemistry|composition|carbonate|olivine|organic|sample|found|find|discover|detect|analy|rock|science|measure)"
PLACE = r"\b(place|put|build)\b"

ADD_PIN = r"(?i)^(?:please\s+)?(?:add|drop|place|put|create|make|leave|set)\s+(?:a\s+|another\s+|one\s+more\s+)?(?:new\s+)?pin\b(.*)$"
PIN_THIS = r"(?i)^(?:please\s+)?(?:pin|mark)\s+((?:this|that|here|the\s+rover|the\s+spot|my\s+position|where)\b.*)$"
NOTE = r"(?i)(?:\bas\b|\bcalled\b|\bnamed\b|\blabell?ed\b|\bsaying\b|:)\s*(.+)$"

INTENTS = ("find_sites", "place_module", "show_path", "query_scene", "render_concept", "toggle_layer", "compare_sites", "set_cover", "answer")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def intent(text: Column) -> Column:
    """``struct<intent, destination, depth_m, module, drive, query>`` of a request; null for help or anything unknown.

    The first rule that matches decides; the order is part of the meaning.
    """
    t = F.lower(F.trim(text))
    destination = F.coalesce(_group(t, TO_PLACE), _group(t, IS_REACHABLE), _group(t, HOMEWARD))
    number = F.regexp_extract(t, DEPTH, 1).try_cast("double")
    depth = F.when(t.rlike(DEPTH), number * F.when(F.regexp_extract(t, DEPTH, 2).startswith("c"), 0.01).otherwise(1.0))
    module = F.when(t.rlike("dome|greenhouse"), "greenhouse_dome").when(t.rlike("pad|landing"), "landing_pad").when(t.rlike("solar|panel"), "solar_field").otherwise("habitat")

    def made(name: str, **fields) -> Column:
        null = {"destination": "string", "depth_m": "double", "module": "string", "drive": "boolean", "query": "string"}
        return F.struct(F.lit(name).alias("intent"), *[(fields.get(k, F.lit(None))).cast(kind).alias(k) for k, kind in null.items()])

    has_place = destination.isNotNull()
    return (
        F.when((t == "") | t.rlike(HELP), None)
        .when(t.rlike(RENDER), made("render_concept"))
        .when(t.rlike(COVER), made("set_cover", depth_m=depth))
        .when(t.rlike(DRIVE) & has_place, made("show_path", destination=destination, drive=F.lit(True)))
        .when(t.rlike(ROUTE) & has_place, made("show_path", destination=destination))
        .when(t.rlike(WHERE), made("find_sites"))
        .when(t.rlike(SCIENCE), made("query_scene", query=F.trim(text)))
        .when(t.rlike(PLACE), made("place_module", module=module, destination=F.coalesce(destination, F.lit("selected_site"))))
    )


def pin_request(text: Column) -> Column:
    """The note of a request for a pin, empty when it has none; null for any other text."""
    t = F.regexp_replace(F.trim(text), r"[.!]+$", "")
    rest = F.coalesce(_group(t, ADD_PIN), _group(t, PIN_THIS))
    note = F.coalesce(_group(rest, NOTE), F.lit(""))
    return F.when(rest.isNotNull(), F.trim(F.regexp_replace(note, "^[\"'“]|[\"'”]$", "")))


#: Fixed patterns of phrases that name a pin, a site, what is selected, home, or a place.
PIN_NUMBER, NEWEST_PIN, SITE_NUMBER = r"\bpin\s*#?(\d+)\b", r"\b(last|latest|newest|my)\s+pin\b", r"\bsite\s*#?(\d+)"
SELECTED, HOME, PLACE = r"\b(selected|placement|habitat|module|it|there)\b", r"\b(home|start|origin|back)\b", r"(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"


def find_user_pin(requests: DataFrame, pins: DataFrame) -> DataFrame:
    """``request_id, pin`` (a number from 1, or null): by number, the newest own pin, or the longest note in the phrase.

    ``requests(request_id, scene_id, to)``, ``pins(scene_id, n, note, mine)`` with n from 1 in each scene. Numbers and newest
    pins are equi-joins. Only phrases of neither kind meet the notes of their scene, each phrase and each note once, however
    many requests and pins have them.
    """
    t = F.lower(F.trim("to"))
    asked = requests.select("request_id", "scene_id", t.alias("t"), _group(t, PIN_NUMBER).try_cast("long").alias("number"), t.rlike(NEWEST_PIN).alias("newest"))
    last = pins.groupBy("scene_id").agg(F.coalesce(F.max(F.when(F.col("mine"), F.col("n"))), F.max("n")).alias("last"))
    numbered = pins.select("scene_id", F.col("n").alias("number"), F.col("n").alias("by_number")).distinct()
    notes = pins.groupBy("scene_id", F.lower(F.trim("note")).alias("low")).agg(F.min("n").alias("n"))
    phrases = asked.filter(F.col("number").isNull() & ~F.coalesce("newest", F.lit(False))).select("scene_id", "t").distinct()
    by_note = (F.col("t") == F.col("low")) | ((F.length("low") >= 3) & F.contains(F.col("t"), F.col("low")))
    longest = F.max(F.struct(F.length("low").alias("l"), (-F.col("n")).alias("n"))).alias("noted")
    noted = phrases.join(notes, "scene_id").filter(by_note).groupBy("scene_id", "t").agg(longest)
    found = asked.join(numbered, ["scene_id", "number"], "left").join(last, "scene_id", "left").join(noted, ["scene_id", "t"], "left")
    pin = F.when(F.col("number").isNotNull(), F.col("by_number")).when(F.col("newest"), F.col("last")).otherwise(-F.col("noted.n"))
    return found.select("request_id", pin.alias("pin"))


def coordinates(text: Column) -> Column:
    """``struct<x, y>`` of the first "x, y" in a text, or null."""
    return F.when(text.rlike(PLACE), F.struct(F.regexp_extract(text, PLACE, 1).cast("double").alias("x"), F.regexp_extract(text, PLACE, 2).cast("double").alias("y")))


def destination_kind(to: Column, pin: Column) -> Column:
    """Which rule takes a destination phrase: user pin, site, selected, home, coordinates or science pin, in that order."""
    t = F.lower(F.trim(to))
    return (
        F.when(pin.isNotNull(), "user_pin").when(t.rlike(SITE_NUMBER), "site").when(t.rlike(SELECTED), "selected")
        .when(t.rlike(HOME), "home").when(coordinates(t).isNotNull(), "coordinates").otherwise("science_pin")
    )


def resolve_destinations(requests: DataFrame, user_pins: DataFrame, sites: DataFrame, selected: DataFrame, pins: DataFrame) -> DataFrame:
    """``request_id, rule, x, y, label`` of each destination phrase in ``requests(request_id, scene_id, to)``.

    The first rule that takes the phrase decides (``destination_kind``), and may find nothing: then x, y and label are
    null. ``user_pins(scene_id, n, note, mine, x, y)``, ``sites(scene_id, rank, x, y)``, ``selected(scene_id, x, y, label)``,
    ``pins(scene_id, pos, name, x, y)``: of science pins whose name is in the phrase, or the phrase in it, the first counts.
    All are joined by scene, and reduced to a row a request.
    """
    asked = requests.join(find_user_pin(requests, user_pins), "request_id").withColumn("t", F.lower(F.trim("to")))
    asked = asked.withColumns({"rule": destination_kind(F.col("to"), F.col("pin")), "number": _group(F.col("t"), SITE_NUMBER).try_cast("int"), "at": coordinates(F.col("t"))})
    own = user_pins.select("scene_id", F.col("n").alias("pin"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("note").alias("unote"))
    ranked = sites.select("scene_id", F.col("rank").alias("number"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    chosen = selected.select("scene_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("label").alias("clabel"))
    named = asked.filter("rule = 'science_pin'").select("request_id", "scene_id", "t").join(pins, "scene_id").withColumn("low", F.lower("name"))
    named = named.filter(F.contains("t", "low") | F.contains("low", "t")).groupBy("request_id").agg(F.min_by(F.struct("name", "x", "y"), "pos").alias("science"))
    all_ = asked.join(own, ["scene_id", "pin"], "left").join(ranked, ["scene_id", "number"], "left").join(chosen, "scene_id", "left").join(named, "request_id", "left")
    spot = lambda x, y, label: F.when(x.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), label.alias("label")))
    c, whole = F.col, lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    place = (
        F.when(c("rule") == "user_pin", spot(c("ux"), c("uy"), c("unote"))).when(c("rule") == "site", spot(c("sx"), c("sy"), F.concat(F.lit("Site "), c("number").cast("string"))))
        .when(c("rule") == "selected", spot(c("cx"), c("cy"), c("clabel"))).when(c("rule") == "home", spot(F.lit(0.0), F.lit(0.0), F.lit("the start point")))
        .when(c("rule") == "coordinates", spot(c("at.x"), c("at.y"), F.concat(F.lit("("), whole(c("at.x")), F.lit(", "), whole(c("at.y")), F.lit(") m"))))
        .otherwise(spot(c("science.x"), c("science.y"), c("science.name")))
    )
    return all_.withColumn("p", place).select("request_id", "rule", "p.x", "p.y", "p.label")


def rounded_metres(x: Column) -> Column:
    return F.format_string("%.0f", x)


#: Where lines of each kind stand among those of ``scene_facts``: two numbers, before those of the rows themselves.
_AFTER = 1 << 60


def scene_details(
    splats: DataFrame | None = None, data: DataFrame | None = None, samples: DataFrame | None = None, rovers: DataFrame | None = None, routes: DataFrame | None = None,
    shielding: DataFrame | None = None, rasters: DataFrame | None = None, fields: DataFrame | None = None, placing: DataFrame | None = None,
) -> DataFrame:
    """``scene_id, a, b, c, line``: lines of further kinds, for ``others`` of ``scene_facts``. The sentences are fixed wording.

    ``splats(scene_id, count)``, null where a scene has none; ``data(scene_id, layers, rasters, shielding)``, whether it has
    them; ``samples(scene_id, pos, name, number)`` of pins; ``rovers(scene_id, x, y)``; ``routes(scene_id, label, status,
    length_m, max_slope)``, the last two null while there is none; ``shielding(scene_id, citation, points
    array<struct<depth_m, factor>>, limits, deep)``, ``deep`` for a deeper series; ``rasters(scene_id, pos, name, unit, source,
    resolution, estimate, description)``; ``fields(scene_id, pos, name, unit, source, resolution)``; ``placing(scene_id,
    kind, x, y, score)``, ``kind`` null where nothing is being placed.
    """
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    some = lambda before, c, after="": F.when(F.coalesce(c, F.lit("")) != "", said(before, c, after)).otherwise("")
    spot = said("(", rounded_metres(F.col("x")), ", ", rounded_metres(F.col("y")), ") m")
    out = []

    def put(rows: DataFrame | None, a: int, b: Column | int, c: int, line: Column) -> None:
        if rows is not None:
            b = b.cast("long") if isinstance(b, Column) else F.lit(b).cast("long")
            out.append(rows.select("scene_id", F.lit(a).alias("a"), b.alias("b"), F.lit(c).alias("c"), line.alias("line")))

    built = said("A Gaussian splat of the ground near the rover, built from rover photos (", F.format_number("count", 0), " Gaussians).")
    put(splats, 1, 1, 0, F.when(F.col("count").isNotNull(), built).otherwise("No Gaussian splat in this scene."))
    kinds = (("layers", "per-Gaussian splat layers"), ("rasters", "orbital raster layers"), ("shielding", "radiation shielding estimates"))
    listed = F.concat_ws(", ", *[F.when(F.col(c), F.lit(words)) for c, words in kinds])
    put(data, 1, 2, 0, said("Data in this scene: ", F.when(listed == "", "terrain only").otherwise(listed), "."))
    put(samples, 3, F.col("pos"), 1, said("  Sample: ", F.col("name"), " (no. ", F.col("number").cast("string"), ")."))
    put(rovers, 3, _AFTER, 0, said("Rover: at ", spot, "."))
    length = F.when(F.col("length_m").isNotNull(), said(", ", F.format_string("%.0f", F.floor(F.col("length_m") + 0.5).cast("double")), " m long, steepest slope ", F.format_string("%.1f", "max_slope"), " degrees")).otherwise("")
    put(routes, 3, _AFTER + 1, 0, said("Rover route to ", F.col("label"), ": ", F.col("status"), length, "."))
    if shielding is not None:
        points = F.array_join(F.transform("points", lambda p: said(p["depth_m"].cast("string"), " m: factor ", p["factor"].cast("string"))), "; ")
        deeper = said("Regolith cover on a module is scored with a deeper cited series (", F.col("citation"), "; an estimate): ", points, ". Linear between points is this app's choice; nothing beyond the deepest point. This series and the next one have different baselines and are never mixed.")
        plain = said("Radiation shielding by regolith depth (dose factor relative to no cover; ", F.col("citation"), "): ", points, ". Values between these points are this app's linear interpolation, and there is no data beyond the deepest point. ", F.coalesce("limits", F.lit("")))
        put(shielding, 4, F.when(F.col("deep"), _AFTER).otherwise(_AFTER + 1), 0, F.when(F.col("deep"), deeper).otherwise(plain))
    unit = F.when(F.coalesce("unit", F.lit("")) == "", "no unit").otherwise(F.col("unit")) if rasters is not None else None
    if rasters is not None:
        put(rasters, 4, _AFTER + 2 + F.col("pos"), 0, said('Terrain layer "', F.col("name"), '" (', unit, "; ", F.col("source"), ", ", F.col("resolution"), F.when(F.coalesce("estimate", F.lit(False)), "; an estimate").otherwise(""), ")", some(": ", F.col("description"))))
    if fields is not None:
        put(fields, 4, 2 * _AFTER + F.col("pos"), 0, said('Splat layer "', F.col("name"), '"', some(" (", F.col("unit"), ")"), some(": ", F.col("source")), some(", ", F.col("resolution"))))
    if placing is not None:
        now = said("The user's module being placed now: ", F.regexp_replace("kind", "_", " "), " at ", spot, some(": ", F.col("score")), ".")
        put(placing, 5, -1, 0, F.when(F.col("kind").isNotNull(), now).otherwise("The user is not placing a module right now."))
    made = out[0]
    for rows in out[1:]:
        made = made.unionByName(rows)
    return made


def scene_facts(scenes: DataFrame, pins: DataFrame, sites: DataFrame, modules: DataFrame, most: int = 15_000, others: DataFrame | None = None) -> DataFrame:
    """``scene_id, facts``: what is known of each scene, as lines in a fixed order, cut at ``most`` characters.

    ``scenes(scene_id, body, title, width, depth, resolution, z_min, z_max, sources array<string>)``, ``pins(scene_id, pos,
    name, x, y, summary, measurements array<struct<label, value>>)``, ``sites(scene_id, rank, x, y, grade)``,
    ``modules(scene_id, pos, kind, author, x, y, score)``. Each kind of row becomes lines by itself; one aggregate joins
    them, so a scene without pins, sites or modules says so and no table is joined to another. ``others`` are lines of
    ``scene_details``, which take their places among these. The sentences are fixed wording.
    """
    line = lambda a, b, *parts: F.struct(F.lit(a).alias("a"), b.cast("long").alias("b"), F.lit(0).alias("c"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("line"))
    spot, n0 = lambda: F.concat(F.lit("("), rounded_metres(F.col("x")), F.lit(", "), rounded_metres(F.col("y")), F.lit(") m")), F.lit(0)
    text = lambda c: F.col(c).cast("string")
    head = scenes.select("scene_id", F.explode(F.array(
        line(0, n0, "Body: ", text("body"), ". Site: ", text("title"), "."),
        line(1, n0, "Terrain window: ", text("width"), " m by ", text("depth"), " m at ", text("resolution"), " m per pixel; elevation from ", text("z_min"), " m to ", text("z_max"), " m relative to the site origin."),
        line(2, n0, "Sources: ", F.array_join("sources", "; "), "."),
        line(9, n0, "Coordinates are meters east and north of the site origin."),
    )).alias("l"))
    of_pin = pins.select("scene_id", line(3, F.col("pos"), 'Science pin "', text("name"), '" at ', spot(), ": ", text("summary")).alias("l"))
    cited = pins.select("scene_id", "pos", F.posexplode("measurements").alias("i", "m"))
    cited = cited.select("scene_id", F.struct(F.lit(3).alias("a"), F.col("pos").cast("long").alias("b"), (F.col("i") + 2).alias("c"), F.concat(F.lit("  Cited measurement: "), F.col("m.label"), F.lit(": "), F.col("m.value").cast("string")).alias("line")).alias("l"))
    of_site = sites.select("scene_id", line(4, F.col("rank"), "Best site ", text("rank"), ": ", spot(), ", grade ", text("grade"), " of 100 (computed by the app).").alias("l"))
    score = F.coalesce(F.concat(F.lit(": "), F.col("score")), F.lit(": no score recorded"))
    of_module = modules.select("scene_id", line(6, F.col("pos"), "  ", text("pos"), ". ", F.regexp_replace("kind", "_", " "), " by ", text("author"), " at ", spot(), score, ".").alias("l"))
    none = lambda rows, a, said: scenes.select("scene_id").join(rows.select("scene_id").distinct(), "scene_id", "left_anti").select("scene_id", line(a, n0, said).alias("l"))
    counted = modules.groupBy("scene_id").agg(F.count("*").alias("n")).select("scene_id", line(5, n0, "Modules built in the shared session (", text("n"), "):").alias("l"))
    lines = head.unionByName(of_pin).unionByName(cited).unionByName(of_site).unionByName(of_module).unionByName(counted)
    lines = lines.unionByName(none(pins, 3, "No science pins, so no cited measurements in this scene.")).unionByName(none(modules, 5, "Nobody has built a module in the shared session yet."))
    if others is not None:
        lines = lines.unionByName(others.select("scene_id", F.struct("a", "b", "c", "line").alias("l")))
    known = lines.join(scenes.select("scene_id"), "scene_id", "left_semi").select("scene_id", F.struct("l.a", "l.b", "l.c").alias("seq"), "l.line")
    return fact_lines(known, most)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def number_tuple(text: Column) -> Column:
    """The numbers of "(a,b,...)", truncated to whole ones."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double").cast("long"))


def short_source(text: Column) -> Column:
    """One short clause of a source's text: without addresses, cut at a break after 12 characters or more, at most 64."""
    # fixed patterns and lengths
    bare = F.trim(F.regexp_replace(text, r",?\s*https?://\S+", ""))
    first = F.regexp_extract(bare, r"^(.*?)[;:]\s", 1)
    has = bare.rlike(r"^.*?[;:]\s")
    clause = F.when(has & (F.length(first) >= 12), first).otherwise(bare)
    head = F.regexp_extract(F.substring(clause, 1, 65), r"^(.*) ", 1)
    short = F.concat(F.regexp_replace(head, r"[,.(]+$", ""), F.lit("…"))
    return F.when(F.coalesce(text, F.lit("")) == "", "not stated").when(F.length(clause) <= 64, clause).otherwise(short)


def citation(text: Column) -> Column:
    """"Author et al. year" of a citation, or the text itself."""
    pattern = r"^([^,]+),.*?\((\d{4})\)"
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.lit(" et al. "), F.regexp_extract(text, pattern, 2))).otherwise(text)


def other_model_note(cite: Column, theirs: Column, ours: Column) -> Column:
    """A note where a second model's factor differs by 0.1 or more."""
    two = lambda x: F.format_string("%.2f", x.cast("double"))
    return F.when(F.abs(theirs - ours) >= 0.1, F.concat(F.lit("An older model ("), citation(cite), F.lit(") gives × "), two(theirs), F.lit(" at this depth, not × "), two(ours), F.lit(".")))


def code_allowed(codes: Column, code: Column) -> Column:
    """Whether a comma list of codes, trimmed and in any case, has a code; an empty list lets all in."""
    listed = F.filter(F.transform(F.split(codes, ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    return (F.size(listed) == 0) | F.coalesce(F.array_contains(listed, F.lower(F.trim(code))), F.lit(False))


def enter(people: DataFrame, codes: DataFrame) -> DataFrame:
    """Each person's organisation by code, in any case; the last organisation with the code wins."""
    match = people.join(codes, F.upper(F.trim("entered")) == F.upper(F.trim("code")))
    return match.groupBy("identity").agg(F.max("org_id").alias("org_id"))


def sign_in(people: DataFrame, codes: DataFrame) -> DataFrame:
    """People whose trimmed code equals that of the organisation they name, exactly."""
    return people.join(codes, (F.col("wanted") == F.col("org_id")) & (F.trim("entered") == F.col("code")), "left_semi")


def cited_answer(pins: DataFrame, save) -> DataFrame:
    """Measurements with numbered sources: urls are numbered as they come first, by pin and place in its list.

    ``pins(pin_id, measurements array<struct<label, value, source_url>>)``; pins without measurements give no rows.
    """
    each = pins.select("pin_id", F.posexplode("measurements").alias("pos", "m"))
    first = each.groupBy(F.col("m.source_url").alias("url")).agg(F.min(F.struct("pin_id", "pos")).alias("at"))
    sources = numbered(first, ["at"], "source_no", save)
    return each.join(sources.drop("at"), F.col("m.source_url") == F.col("url")).select("pin_id", "pos", "m.label", "m.value", "source_no", "url")


def fact_lines(lines: DataFrame, most: int = 15_000) -> DataFrame:
    """``scene_id, facts``: a scene's lines in order, joined and cut at ``most`` characters."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return lines.groupBy("scene_id").agg(F.substring(F.array_join(F.transform(listed, lambda s: s["line"]), "\n"), 1, most).alias("facts"))


def module_counts(modules: DataFrame) -> DataFrame:
    """``scene_id, modules``: counts by type in the order in which types come first, as a plural list."""
    by_type = modules.groupBy("scene_id", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    said = F.concat(F.col("n").cast("string"), F.lit(" "), F.regexp_replace("kind", "_", " "), F.when(F.col("n") > 1, "s").otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("first", "kind", said.alias("said"))))
    return by_type.groupBy("scene_id").agg(F.array_join(F.transform(listed, lambda s: s["said"]), ", ").alias("modules"))


def checked_intent(answer: Column) -> Column:
    """The intent of a model's JSON answer; anything malformed or unknown becomes a scene query."""
    got = F.get_json_object(answer, "$.intent")
    return F.when(got.isin(*INTENTS), got).otherwise("query_scene")


def plain_name(x: Column) -> Column:
    """A name that passes: trimmed and not empty, at most 32 characters."""
    t = F.trim(x)
    return F.when((F.length(t) > 0) & (F.length(t) <= 32), t)
