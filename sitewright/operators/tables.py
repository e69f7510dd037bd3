"""Relational pieces: picks, retention, upserts by key, access chains, agreement of classes, numbered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], name: str, save) -> DataFrame:
    """``rows`` with a number from 1 by ``order`` over all of them. They are sorted by ranges and saved; each range then
    starts where the counts of those before it end, so that no task holds all rows."""
    placed = save(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ahead = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + within).drop("_at", "_part", "_ahead")


def newest(rows: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key by ``order``. Ranks are limited within tasks before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the greatest by ``order``: an aggregate with partial maxima, no window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not new, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones whose key is not yet there."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_agreement(matrix: DataFrame, label: str, predicted: str) -> DataFrame:
    """``class, tp, fp, fn, iou`` from confusion counts; IoU is tp / max(fp + fn + tp, 1)."""
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    actual = matrix.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("actual"), F.sum(hit).alias("tp"))
    said = matrix.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    both = actual.join(said, "class", "full").na.fill(0)
    fp, fn = F.col("said") - F.col("tp"), F.col("actual") - F.col("tp")
    return both.select("class", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("tp") / F.greatest(fp + fn + F.col("tp"), F.lit(1))).alias("iou"))


def accessible(members: DataFrame, access: DataFrame, scene: Column) -> DataFrame:
    """Members' rows whose organisation has the scene (its name before any ``#room``)."""
    asked = members.withColumn("_scene", F.substring_index(scene, "#", 1))
    return asked.join(access.select("org_id", F.col("scene_id").alias("_scene")), ["org_id", "_scene"], "left_semi").drop("_scene")


def my_scenes(members: DataFrame, access: DataFrame) -> DataFrame:
    """``identity, scene_id``: the scenes of each member's own organisation."""
    return members.select("identity", "org_id").join(access.select("org_id", "scene_id"), "org_id").select("identity", "scene_id")


def why_no_access(events: DataFrame, members: DataFrame, access: DataFrame) -> DataFrame:
    """``events(identity, scene_id, ..)`` with ``refused``: why, or null for those that may. Rooms of a scene ("scene#room")
    share its access. ``members`` has a row a person; two equi-joins."""
    scene = F.substring_index("scene_id", "#", 1)
    grants = access.select(F.col("org_id").alias("_org"), F.col("scene_id").alias("_scene")).distinct().withColumn("_ok", F.lit(True))
    seen = events.join(members.select("identity", F.col("org_id").alias("_mine")), "identity", "left")
    seen = seen.join(grants, (F.col("_mine") == F.col("_org")) & (scene == F.col("_scene")), "left")
    why = F.when(F.col("_mine").isNull(), "not signed in").when(F.col("_ok").isNull(), F.concat(F.lit('no access to "'), F.coalesce(scene, F.lit("")), F.lit('"')))
    return seen.withColumn("refused", why).select(*events.columns, "refused")


def clean_text(x: Column, most: int, what: str) -> tuple[Column, Column]:
    """(trimmed text, why it is refused or null): not empty, at most ``most`` characters."""
    t = F.trim(x)
    return t, F.when(F.coalesce(F.length(t), F.lit(0)) == 0, f"{what} must not be empty").when(F.length(t) > most, f"{what} is longer than {most} characters")


def refused_if(*tests: tuple[Column, str]) -> Column:
    """The first reason whose test is true; null when all pass. A null test is true."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), why) for bad, why in tests])


def is_finite(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok


def accepted_and_refused(rows: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one and ``refused``)."""
    marked = rows.withColumn("refused", why)
    return marked.filter("refused is null").drop("refused"), marked.filter("refused is not null")


def histogram(rows: DataFrame, value: str, classes: int) -> DataFrame:
    """``class, n, share`` of every class from 0, those without rows too."""
    counts = rows.groupBy(F.col(value).alias("class")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_all"))
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left").join(F.broadcast(total))  # one row
    return every.select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("share"))


def survey(rows: DataFrame, key: list[Column]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n"))


def with_authors(rows: DataFrame, users: DataFrame, key: str, unknown: str = "someone") -> DataFrame:
    """Rows with the name of their author; one for those who are unknown."""
    return rows.join(users, key, "left").withColumn("author", F.coalesce("author", F.lit(unknown)))


def fractions(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key, fractions``: a map from each value to its share of the key's rows."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("_n"))
    listed = counts.groupBy(*key).agg(F.sum("_n").alias("_all"), F.collect_list(F.struct(value, "_n")).alias("_l"))
    return listed.select(*key, F.map_from_entries(F.transform("_l", lambda s: F.struct(s[value], s["_n"] / F.col("_all")))).alias("fractions"))


def concatenated(**clouds: DataFrame) -> DataFrame:
    """Rows of all clouds, with ``source``; missing columns are null."""
    out = None
    for name, c in clouds.items():
        one = c.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def shuffled(rows: DataFrame, key: list[str], seed: int, epoch: int) -> DataFrame:
    """Rows in an order that depends on their key, the seed and the epoch only, range-sorted."""
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), F.lit(epoch), *key)).orderBy("draw", *key).drop("draw")


def sampled(rows: DataFrame, key: list[str], count: int, seed: int) -> DataFrame:
    """``count`` rows without replacement, the first by a seeded hash of their key: the same in every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(count)


def first_free(palette: list[str], taken: Column, asked: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array_except(F.array(*map(F.lit, palette)), taken), F.lit(1)), asked)


def within_budget(rows: DataFrame, key: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The newest rows of each key whose sizes fit a budget together."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_s", F.sum(size).over(w)).filter(F.col("_s") <= budget).drop("_s")
