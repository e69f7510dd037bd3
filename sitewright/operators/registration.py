"""Bringing rasters and clouds into line: shift search, misfits, alternating medians."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import medians


def shift_search(moving: DataFrame, fixed: DataFrame, reach: int, least_overlap: float = 0.05) -> DataFrame:
    """``dr, dc, r, n``: correlation of ``moving`` shifted by each whole-pixel shift with ``fixed``, jointly valid cells.

    Both are ``row, col, value``. Moving cells are sent once per shift and meet ``fixed`` by an equi-join on the cell;
    sums for the correlation are combined before they are shuffled.
    """
    n = fixed.filter("value is not null").agg(F.count("*").alias("all"))
    shifts = [F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias(a) for a in ("dr", "dc")]
    sent = moving.filter("value is not null").select("row", "col", F.col("value").alias("a"), shifts[0]).select("*", shifts[1])
    sent = sent.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "a", "dr", "dc")
    both = sent.join(fixed.filter("value is not null").select("row", "col", F.col("value").alias("b")), ["row", "col"])
    out = both.groupBy("dr", "dc").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))
    return out.join(F.broadcast(n)).filter(F.col("n") >= least_overlap * F.col("all")).drop("all")  # one row


def best_shift(scores: DataFrame, reach: int, least: float = 0.3) -> DataFrame:
    """The shift of the greatest correlation (ties: smallest shift); none if it lies on the edge or is below ``least``."""
    best = scores.agg(F.max_by(F.struct("dr", "dc", "r", "n"), F.struct("r", -F.abs("dr"), -F.abs("dc"), -F.col("dr"), -F.col("dc"))).alias("b")).select("b.*")
    return best.filter((F.abs("dr") < reach) & (F.abs("dc") < reach) & (F.col("r") >= least))


def clipped_misfit(points: DataFrame, cell_m: float, clip: float = 0.2, least: int = 4) -> DataFrame:
    """Mean of min(|d - median|, clip) over points ``x, y, d`` and the number of points; infinite with too few."""
    middle = medians(points, [], "d").select(F.col("m"))
    off = points.join(F.broadcast(middle)).select(F.least(F.abs(F.col("d") - F.col("m")), F.lit(clip)).alias("o"))  # one row
    return off.agg(F.avg("o").alias("misfit"), F.count("*").alias("n")).withColumn("misfit", F.when(F.col("n") >= least, F.col("misfit")).otherwise(F.lit(float("inf"))))


def alternating_medians(seen: DataFrame, save, rounds: int = 12, most: int = 65_536) -> DataFrame:
    """``frame, gain``: log gains of frames, so that ``seen(frame, point, value)`` is gain x point brightness.

    Rounds of two medians: points given gains, gains given points; gains average 0 in the log. Values that are not above 0, or
    not finite, say nothing.

    Rows are shuffled once: all values of a point are laid in one row, a point with more than ``most`` in several. Rounds read
    these rows where they lie; what they shuffle are counts, and the values near the middle of each frame and of each point
    with several rows. The gains, a number a frame, go to all tasks.
    """
    known = seen.filter("frame IS NOT NULL AND point IS NOT NULL AND value > 0D AND value < double('Infinity')")
    logs = save(known.select("frame", "point", F.log("value").alias("v")))
    frames = save(logs.select("frame").distinct().agg(F.array_sort(F.collect_list("frame")).alias("_all")).select(F.posexplode("_all").alias("i", "frame")))
    named = logs.join(frames, "frame").select("point", "i", "v")
    large = save(logs.groupBy("point").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("point", F.ceil(F.col("n") / most).alias("_parts")))

    def laid(rows: DataFrame, *by: str) -> DataFrame:
        rows = rows.repartition(*by).groupBy(*by).agg(F.collect_list(F.struct("i", "v")).alias("_all"))
        return save(rows.select("point", F.col("_all.i").alias("f"), F.col("_all.v").alias("v")))

    shared = None
    if not large.isEmpty():
        shared = laid(named.join(large, "point").withColumn("_part", F.pmod(F.monotonically_increasing_id(), "_parts")), "point", "_part")
        named = named.join(large, "point", "left_anti")
    whole = laid(named, "point")

    less = lambda f, v: F.coalesce(v - F.get("_g", f), F.lit(0.0))  # noqa: E731  neither is null; so said, numbers are sorted as such
    given = lambda rows: rows.join(F.broadcast(gains)).withColumn("_d", F.zip_with("f", "v", less))  # noqa: E731  one row
    half = lambda n: F.floor(n / 2).cast("int")
    middle = (F.get("_d", half(F.size("_d") - 1)) + F.get("_d", half(F.size("_d")))) / 2
    gains = save(frames.agg(F.array_repeat(F.lit(0.0), F.count("*").cast("int")).alias("_g")))
    for _ in range(rounds):
        level = given(whole).withColumn("_d", F.sort_array("_d")).select("f", "v", F.coalesce(middle, F.lit(0.0)).alias("p"))
        if shared is not None:
            apart = save(medians(given(shared).select("point", F.explode("_d").alias("d")), ["point"], "d", save=save).select("point", F.col("m").alias("p")))
            level = level.unionByName(shared.join(apart, "point").select("f", "v", "p"))
        off = level.select("p", F.inline(F.arrays_zip("f", "v")).alias("i", "v")).select("i", (F.col("v") - F.col("p")).alias("d"))
        raw = medians(off, ["i"], "d", save=save).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_all")).select(F.col("_all.m").alias("_g"))
        mean = F.aggregate("_g", F.lit(0.0), lambda s, g: s + g) / F.size("_g")
        gains = save(raw.withColumn("_m", mean).select(F.transform("_g", lambda g: g - F.col("_m")).alias("_g")))
    return gains.select(F.posexplode("_g").alias("i", "g")).join(frames, "i").select("frame", F.exp("g").alias("gain"))


def _over(points: DataFrame, ground: DataFrame, cell_m: float) -> DataFrame:
    """``points(.., x, y, z)`` with ``d``, their height over the ground of their cell; only those over known ground."""
    cell = {"cx": F.floor(F.col("x") / cell_m).cast("long"), "cy": F.floor(F.col("y") / cell_m).cast("long")}
    return points.withColumns(cell).join(ground, ["cx", "cy"]).withColumn("d", F.col("z") - F.col("h")).drop("cx", "cy", "h")


#: What a motion has: turns about z, y and x in degrees, and a shift in metres.
FREEDOMS = ("yaw", "pitch", "roll", "dx", "dy", "dz")


def motion(values: dict[str, float], pivot) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift): X -> R X + t, which turns about the pivot and then shifts."""
    turn = np.eye(3)
    for name, (a, b) in (("roll", (1, 2)), ("pitch", (2, 0)), ("yaw", (0, 1))):
        c, s = np.cos(np.radians(values.get(name, 0.0))), np.sin(np.radians(values.get(name, 0.0)))
        one = np.eye(3)
        one[a, a] = one[b, b] = c
        one[a, b], one[b, a] = -s, s
        turn = one @ turn
    about = np.asarray(pivot, float)
    return turn, about + [values.get(n, 0.0) for n in ("dx", "dy", "dz")] - turn @ about


def candidate_misfits(points: DataFrame, ground: DataFrame, tried: list[dict[str, float]], pivot, cell_m: float, clip: float, level: bool) -> DataFrame:
    """``k, misfit, n, dz`` of each motion of ``tried``, by its number: the mean clipped height difference over known ground.

    With ``level`` differences are taken from their median, ``dz``; else as they are, and ``dz`` is 0. Every point is sent
    once a candidate, of which there are as many as the search names, and sums by candidate are combined before they are
    shuffled.
    """
    moves = []
    for k, values in enumerate(tried):
        turn, shift = motion(values, pivot)
        moves.append(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, map(float, turn.ravel()))).alias("r"), F.array(*map(F.lit, map(float, shift))).alias("t")))
    sent = points.withColumn("_m", F.explode(F.array(*moves)))
    place = [sum((F.col("_m.r")[3 * i + j] * F.col(n) for j, n in enumerate("xyz")), F.col("_m.t")[i]) for i in range(3)]
    off = _over(sent.select(F.col("_m.k").alias("k"), *[c.alias(n) for c, n in zip(place, "xyz", strict=True)]), ground, cell_m).select("k", "d")
    if level:
        off = off.join(F.broadcast(medians(off, ["k"], "d").select("k", F.col("m").alias("dz"))), "k")  # a row a candidate
    else:
        off = off.withColumn("dz", F.lit(0.0))
    return off.groupBy("k").agg(F.avg(F.least(F.abs(F.col("d") - F.col("dz")), F.lit(clip))).alias("misfit"), F.count("*").alias("n"), F.first("dz").alias("dz"))


def climb(score, start: dict[str, float], steps: dict[str, float], halvings: int = 5, passes: int = 50) -> tuple[dict[str, float], float]:
    """(values, score) where no step along any of ``steps`` raises ``score`` after ``halvings`` rounds, each with half the step.

    ``score`` takes a list of candidates and gives their scores. In a pass all steps from where the search stands, two for
    each value, are scored at once; it moves to the best, if that is better, and the round ends where none is.
    """
    here, size = dict(start), dict(steps)
    (best,) = score([here])
    for _ in range(halvings):
        for _ in range(passes):
            tried = [here | {n: here[n] + sign * step} for n, step in size.items() for sign in (1, -1)]
            found = score(tried)
            top = max(range(len(tried)), key=lambda k: found[k])
            if not found[top] > best:
                break
            here, best = tried[top], found[top]
        size = {n: step / 2 for n, step in size.items()}
    return here, best


#: Fixed values of the search: half-widths of shift (m) and heading (degrees), steps of the first look, the share of points
#: that must be over known ground, the size of a cell and the difference from which one is no misfit but an edge (m).
SEARCH_M, SEARCH_DEG, LOOK_M, LOOK_DEG, OVERLAP, CELL_M, CLIP_M = 1.5, 4.0, 0.15, 1.0, 0.25, 0.05, 0.2
#: Steps with which all six values are then climbed, before the first halving.
CLIMB_STEPS = {"yaw": 0.5, "pitch": 0.5, "roll": 0.5, "dx": 0.08, "dy": 0.08, "dz": 0.04}


def align(
    ref: DataFrame, mov: DataFrame, pivot: tuple[float, float, float], save, cell_m: float = CELL_M, clip: float = CLIP_M, search: float = SEARCH_M, yaw: float = SEARCH_DEG,
    most: int = 40_000, seed: int = 0, steps: dict[str, float] = CLIMB_STEPS, halvings: int = 5,
):
    """(rotation as nine numbers by row, shift, report): the rigid motion X -> R X + t that lays the ground of ``mov`` on that
    of ``ref``, both ``x, y, z`` with z upwards.

    A first look scores headings and shifts on a grid about ``pivot``, each with the median of its height differences as
    the shift upwards. From the best, all six freedoms are climbed. Heights of ``ref`` are means by cell. At most ``most``
    of the moving points over known ground, by the order of a hash, are compared: a bounded sample, whose size is a
    parameter. The driver sees a score for each candidate.
    """
    ground = save(ref.groupBy(F.floor(F.col("x") / cell_m).cast("long").alias("cx"), F.floor(F.col("y") / cell_m).cast("long").alias("cy")).agg(F.avg("z").alias("h")))
    points = save(_over(mov.select("x", "y", "z"), ground, cell_m).drop("d").orderBy(F.xxhash64(F.lit(seed), "x", "y", "z")).limit(most))
    still = dict.fromkeys(FREEDOMS, 0.0)
    first = candidate_misfits(points, ground, [still], pivot, cell_m, clip, True).first()
    need = OVERLAP * (first.n if first else 0)
    along = lambda half, step: [round(k * step, 9) for k in range(-round(half / step), round(half / step) + 1)]
    looks = [still | {"yaw": a, "dx": b, "dy": c} for a in along(yaw, LOOK_DEG) for b in along(search, LOOK_M) for c in along(search, LOOK_M)]
    seen = None
    for n in range(0, len(looks), 256):  # candidates of one job
        part = candidate_misfits(points, ground, looks[n : n + 256], pivot, cell_m, clip, True).withColumn("k", F.col("k") + n)
        seen = part if seen is None else seen.unionByName(part)
    best = save(seen).filter(F.col("n") >= need).orderBy("misfit", "k").first() if first else None
    here = looks[best.k] | {"dz": -best.dz} if best else still

    def score(tried: list[dict[str, float]]) -> list[float]:
        got = {r.k: -r.misfit for r in candidate_misfits(points, ground, tried, pivot, cell_m, clip, False).filter(F.col("n") >= need).collect()}
        return [got.get(k, float("-inf")) for k in range(len(tried))]

    if best:
        here, _ = climb(score, here, steps, halvings)
    turn, shift = motion(here, pivot)
    last = candidate_misfits(points, ground, [here], pivot, cell_m, clip, True).first()
    report = {"overlap_points": last.n if last else 0, "misfit_before_m": first.misfit if first else None, "misfit_after_m": last.misfit if last else None}
    return turn.ravel().tolist(), shift.tolist(), report
