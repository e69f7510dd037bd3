"""Moon operators: map projection, body positions, horizons, illumination and dose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.maths import pmod
from .saving import saved

R = config.MOON_RADIUS_M


def map_to_lonlat(x: Column, y: Column, radius: float = R) -> tuple[Column, Column]:
    """Inverse south polar stereographic projection on a sphere: degrees."""
    rho = F.sqrt(x * x + y * y)
    return F.degrees(F.atan2(x, y)), F.degrees(2 * F.atan(rho / (2 * radius))) - 90


def local_axes(lon: Column, lat: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """East, north and up unit vectors of a place given in radians."""
    sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
    return [-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]


def azel(body_km: list[Column], lon: Column, lat: Column, radius_m: Column | float, r_km: float) -> tuple[Column, Column, Column]:
    """Azimuth (0 to 360), elevation and angular radius of a body, in degrees, from a place at ``radius_m``."""
    east, north, up = local_axes(lon, lat)
    away = [b - u * (radius_m if isinstance(radius_m, Column) else F.lit(radius_m)) / 1000 for b, u in zip(body_km, up, strict=True)]
    dot = lambda a: sum((p * q for p, q in zip(a, away, strict=True)), F.lit(0.0))
    distance = F.sqrt(sum((p * p for p in away), F.lit(0.0)))
    return pmod(F.degrees(F.atan2(dot(east), dot(north))), 360.0), F.degrees(F.asin(dot(up) / distance)), F.degrees(F.asin(F.lit(r_km) / distance))


def window_lonlat(row: Column, col: Column, origin_x: float, origin_y: float, pixels: int, out_pixels: int, radius: float) -> tuple[Column, Column]:
    """Longitude and latitude (radians) of the centre of a cell of a window of ``pixels`` map metres around an origin, row 0
    in the north; the window's edges are whole metres. Map x = radius * lon, y = radius * lat."""
    west, north, step = np.floor(origin_x) - pixels // 2, np.ceil(origin_y) + pixels // 2, pixels / out_pixels
    return (F.lit(float(west)) + (col + 0.5) * step) / radius, (F.lit(float(north)) - (row + 0.5) * step) / radius


def source_pixel(lon: Column, lat: Column, radius: float, lat_ts_deg: float, west: float, north: float, pixel_m: float) -> tuple[Column, Column]:
    """Row and column of the pixel of an equirectangular image, with a latitude of true scale, that holds a place (radians)."""
    x = F.lit(radius) * F.cos(F.radians(F.lit(lat_ts_deg))) * lon
    return F.floor((F.lit(north) - F.lit(radius) * lat) / pixel_m).cast("int"), F.floor((x - west) / pixel_m).cast("int")


def site_shift(lon_deg: Column, lat_deg: Column, height: Column, origin_x: float, origin_y: float, origin_z: float, radius: float) -> Column:
    """``struct<east, north, up>`` in metres from a site's map origin to a place."""
    lat = origin_y / radius
    east = F.lit(radius * float(np.cos(lat))) * (F.radians(lon_deg) - F.lit(origin_x / radius))
    return F.struct(east.alias("east"), (F.lit(radius) * (F.radians(lat_deg) - F.lit(lat))).alias("north"), (height - origin_z).alias("up"))


def depth_m(areal_g_cm2: Column, density_g_cm3: float) -> Column:
    """Metres of cover with an areal density."""
    return areal_g_cm2 / density_g_cm3 / 100.0


def shielding_points(values: DataFrame, density_g_cm3: float) -> DataFrame:
    """``series, depth_m, factor`` from ``values(series, areal, value)``: values relative to that of no cover (the one with
    the least areal density of its series), to 4 and 3 decimals."""
    base = values.groupBy("series").agg(F.min_by("value", "areal").alias("_base"))
    return values.join(base, "series").select("series", F.round(depth_m(F.col("areal"), density_g_cm3), 4).alias("depth_m"), F.round(F.col("value") / F.col("_base"), 3).alias("factor"))


def shielded_ranges(points: DataFrame, low: float, high: float) -> DataFrame:
    """``series, depth_m, low, high, rises``: a raster's range under each stated cover, and whether the series' factor ever
    rises with depth. A series is a handful of cited points."""
    from pyspark.sql import Window

    before = F.lag("factor").over(Window.partitionBy("series").orderBy("depth_m"))
    rises = F.max(F.coalesce(F.col("factor") > F.col("_b"), F.lit(False))).over(Window.partitionBy("series"))
    return points.withColumn("_b", before).select("series", "depth_m", (F.lit(low) * F.col("factor")).alias("low"), (F.lit(high) * F.col("factor")).alias("high"), rises.alias("rises"))


def site_azimuth(true_deg: Column, lon_deg: Column) -> Column:
    """An azimuth from the site's +y, from the true one."""
    return pmod(true_deg + lon_deg, 360.0)


def sample_clock(i: Column, start: str, step_hours: int) -> Column:
    """The UTC time of the i-th sample, as ISO text."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + i * (step_hours * 3600)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sky_series(samples: DataFrame) -> DataFrame:
    """``body, samples, radius, json``: each body's series in order as one JSON text, rounded as published: azimuths (of the
    site) and elevations to 2, visible shares to 3 decimals. ``samples(body, i, az, el, radius, visible)``; a series is what
    one file holds."""
    listed = F.array_sort(F.collect_list(F.struct("i", F.round("az", 2).alias("az"), F.round("el", 2).alias("el"), F.round("visible", 3).alias("v"))))
    folded = samples.groupBy("body").agg(F.count("*").alias("samples"), F.round(F.avg("radius"), 3).alias("radius"), listed.alias("l"))
    json = F.to_json(F.struct(F.transform("l", lambda s: s["az"]).alias("az_site_deg"), F.transform("l", lambda s: s["el"]).alias("el_deg"), F.transform("l", lambda s: s["v"]).alias("visible_fraction")))
    return folded.select("body", "samples", "radius", json.alias("json"))


def tan_elevation(q0: Column, r0: Column, d: Column, x: Column, y: Column, z: Column, radius: float = R) -> Column:
    """Tangent of the elevation, on a sphere, of ground at map x, y and height z, seen over the chord d."""
    q = 1 + (x * x + y * y) / (4 * radius * radius)
    cos_t = 1 - d * d / (q0 * q) / (2 * radius * radius)
    return ((radius + z) * cos_t - r0) / ((radius + z) * F.sqrt(1 - cos_t * cos_t))


def disc_fraction(el: Column, horizon: Column, radius: Column) -> Column:
    """Fraction of a disc above a level line."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (el - horizon) / radius))
    return 0.5 + (x * F.sqrt(1 - x * x) + F.asin(x)) / np.pi


def horizon_at(h: Column, azimuth: Column) -> Column:
    """A 360-element horizon at any azimuth, linear between bins, 359 next to 0."""
    a = pmod(azimuth, 360.0)
    i = F.floor(a).cast("int") % 360
    low, high = F.element_at(h, i + 1), F.element_at(h, (i + 1) % 360 + 1)
    return low + (high - low) * (a - F.floor(a))


def open_sky_factor(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda s, e: s + (1 - F.sin(F.radians(e)))) / F.size(h)


def dose(h: Column) -> Column:
    """mSv a year under a horizon."""
    return config.DOSE_OPEN_SKY * open_sky_factor(h)


def visible_percent(cells: DataFrame, samples: DataFrame, block: int = 8192) -> DataFrame:
    """``row, col, percent``: mean visible share of a body's disc over time.

    ``cells(row, col, h)`` and ``samples(az, el, radius)``, the site's time series, of any length. Samples that are alike
    are taken once, with how many they are, and meet the cells in blocks of about ``block``, which are dealt by hash; sums
    are added by cell. Cells go in groups of 1000, so that a block is sent once a group. A block's samples are parted by azimuth, so that the horizons of a batch of cells are read once for
    each, and only discs that a horizon cuts are worked out. A pair is neither a row nor an object.
    """
    number = [F.col(c).cast("double").alias(c) for c in ("az", "el", "radius")]
    alike = saved(samples.select(*number).groupBy("az", "el", "radius").agg(F.count("*").alias("n")).filter("az IS NOT NULL AND el IS NOT NULL AND radius IS NOT NULL"))
    dealt = alike.withColumn("_b", F.pmod(F.xxhash64("az", "el", "radius"), F.lit(alike.count() // block + 1)))
    blocks = saved(dealt.groupBy("_b").agg(F.collect_list("az").alias("az"), F.collect_list("el").alias("el"), F.collect_list("radius").alias("radius"), F.collect_list("n").alias("n")))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in range(0, len(pdf), 1000):
                part = pdf.iloc[n : n + 1000]
                yield pd.DataFrame({"row": [part["row"].to_numpy()], "col": [part["col"].to_numpy()], "h": [np.stack(part["h"].to_numpy()).astype(np.float64).tobytes()]})

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                h = np.ascontiguousarray(np.frombuffer(p.h).reshape(len(p.row), -1).T)
                total, az = np.zeros(len(p.row)), np.asarray(p.az)
                order = np.argsort(az, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(az[order])) + 1):
                    a = az[part[0]] % 360.0
                    i = int(a) % 360
                    level = h[i] + (h[(i + 1) % 360] - h[i]) * (a - np.floor(a))
                    for el, radius, n in zip(p.el[part], p.radius[part], p.n[part], strict=True):
                        x = (el - level) / radius
                        total += n * (x > 0)
                        cut = np.flatnonzero(np.abs(x) < 1)
                        if len(cut):
                            x = x[cut]
                            total[cut] += n * (0.5 + (x * np.sqrt(1 - x * x) + np.arcsin(x)) / np.pi - (x > 0))
                yield pd.DataFrame({"row": p.row, "col": p.col, "total": total, "n": int(p.n.sum())})

    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("row", "col")}
    groups = cells.select("row", "col", "h").mapInPandas(packed, f"row array<{kinds['row']}>, col array<{kinds['col']}>, h binary")
    each = groups.join(blocks).mapInPandas(seen, f"row {kinds['row']}, col {kinds['col']}, total double, n long")
    return each.groupBy("row", "col").agg((100 * F.sum("total") / F.sum("n")).alias("percent"))


def march_distances(far_m: float) -> np.ndarray:
    near = np.arange(5.0, 1000.0, 5.0)
    steps = int(np.floor(np.log(far_m / 1000.0) / np.log(1.005))) + 1
    return np.concatenate([near, 1000.0 * 1.005 ** np.arange(steps)])


def horizons(observers: DataFrame, dem: np.ndarray, west: float, north: float, cell: float, far_dem: tuple[np.ndarray, float, float, float] | None = None, azimuths: int = 360, far_m: float = 300_000.0, observer_m: float = 2.0, radius: float = R, most_bytes: int = 256 << 20) -> DataFrame:
    """``row, col, h``: elevation in degrees of the horizon of each observer ``(row, col, x, y, z)`` in every direction.

    Rays are marched in tasks, observer by observer; the elevation model, whose size is checked, is a broadcast array, and
    so is a coarser one, ``far_dem`` (heights, west, north, cell), which counts where the first has no data. Exploding cells x azimuths x distances as rows would be thousands of rows per cell and direction.
    """
    if dem.nbytes + (far_dem[0].nbytes if far_dem else 0) > most_bytes:
        raise ValueError("the elevation model is too large to send to every task: cut it into overlapping tiles")
    models = [(dem.astype(np.float32), west, north, cell), *([(far_dem[0].astype(np.float32), *far_dem[1:])] if far_dem else [])]
    shared = observers.sparkSession.sparkContext.broadcast(models)
    distance = march_distances(far_m)
    directions = np.radians(np.arange(azimuths) * 360.0 / azimuths)

    def sample(grid: np.ndarray, west: float, north: float, cell: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c, r = (x - west) / cell - 0.5, (north - y) / cell - 0.5
        good = (c >= 0) & (r >= 0) & (c <= grid.shape[1] - 1) & (r <= grid.shape[0] - 1)
        c, r = np.where(good, c, 0), np.where(good, r, 0)
        c0, r0 = np.minimum(c.astype(int), grid.shape[1] - 2), np.minimum(r.astype(int), grid.shape[0] - 2)
        u, v = c - c0, r - r0
        z = (grid[r0, c0] * (1 - u) + grid[r0, c0 + 1] * u) * (1 - v) + (grid[r0 + 1, c0] * (1 - u) + grid[r0 + 1, c0 + 1] * u) * v
        return np.where(good, z, np.nan)

    def march(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, *far = shared.value
        for pdf in batches:
            out = []
            for x, y, z in zip(pdf["x"], pdf["y"], pdf["z"], strict=True):
                q0, r0 = 1 + (x * x + y * y) / (4 * radius * radius), radius + z + observer_m
                px = x + np.sin(directions)[:, None] * distance
                py = y + np.cos(directions)[:, None] * distance
                ground = radius + sample(*near, px, py)
                for other in far:
                    ground = np.where(np.isnan(ground), radius + sample(*other, px, py), ground)
                q = 1 + (px * px + py * py) / (4 * radius * radius)
                cos_t = 1 - distance * distance / (q0 * q) / (2 * radius * radius)
                tan = (ground * cos_t - r0) / (ground * np.sqrt(1 - cos_t * cos_t))
                best = np.nanmax(np.where(np.isnan(tan).all(1)[:, None], -np.inf, tan), axis=1)
                out.append(np.degrees(np.arctan(best)).tolist())
            yield pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "h": out})

    return observers.select("row", "col", "x", "y", "z").mapInPandas(march, "row int, col int, h array<double>")


# --- horizons over models of any size ---------------------------------------------------------------------------------


def model_tiles(cells: DataFrame, rows: int, cols: int, tile: int, save) -> DataFrame:
    """``tr, tc, at, heights, top`` of a model ``cells(row, col, z)``: each tile's heights by place, with the first row and
    column of its neighbours, and the greatest of them. A model has a height in every cell; else it is refused."""
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 1) / tile).cast("int")), F.least(F.lit((n - 2) // tile), F.floor(F.col(c) / tile).cast("int"))))
    sent = cells.select("row", "col", F.col("z").cast("float").alias("z")).withColumn("tr", near("row", rows)).withColumn("tc", near("col", cols))
    at = ((F.col("row") - F.col("tr") * tile) * (tile + 1) + F.col("col") - F.col("tc") * tile).cast("int")
    tiles = save(sent.groupBy("tr", "tc").agg(F.collect_list(at).alias("at"), F.collect_list("z").alias("heights"), F.max("z").alias("top")))
    side = lambda t, n: F.least(F.lit(tile + 1), F.lit(n) - F.col(t) * tile)
    short = tiles.filter((F.size("heights") != side("tr", rows) * side("tc", cols)) | F.exists("heights", lambda z: z.isNull() | F.isnan(z)))
    whole = (-(-(rows - 1) // tile)) * (-(-(cols - 1) // tile))
    if not short.isEmpty() or tiles.count() != whole:
        raise ValueError("the elevation model has holes")
    return tiles


def _highest(units: DataFrame, extent: tuple[int, int, float, float, float], tile: int, inside: tuple[float, float, float, float] | None, azimuths: int, far_m: float, observer_m: float, radius: float) -> DataFrame:
    """``row, col, tans``: for each observer of a unit, the greatest tangent of elevation of each ray within the unit's tile.

    ``units(tr, tc, at, heights, seen)``. Only the rays and distances that can meet the tile are sampled. ``inside`` is the
    box of a finer model: where that counts, this one does not.
    """
    rows, cols, west, north, cell = extent
    distance, step = march_distances(far_m), 360.0 / azimuths

    def march(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u in pdf.itertuples(index=False):
                grid = np.full((tile + 1) * (tile + 1), np.nan, np.float32)
                grid[np.asarray(u.at)] = np.asarray(u.heights, np.float32)
                grid = grid.reshape(tile + 1, tile + 1)
                # the box of the places whose cell this is, in map metres, with half a cell to spare
                x0, x1 = west + (u.tc * tile) * cell, west + ((u.tc + 1) * tile + 1) * cell
                y0, y1 = north - ((u.tr + 1) * tile + 1) * cell, north - (u.tr * tile) * cell
                out = []
                for o in u.seen:
                    x, y, z = o["x"], o["y"], o["z"]
                    gap = np.hypot(max(x0 - x, 0.0, x - x1), max(y0 - y, 0.0, y - y1))
                    reach = np.hypot(max(abs(x0 - x), abs(x1 - x)), max(abs(y0 - y), abs(y1 - y)))
                    ds = distance[np.searchsorted(distance, gap - cell) : np.searchsorted(distance, reach + cell)]
                    ks = np.arange(azimuths)
                    if gap > 0:  # from outside, the box spans less than half a turn
                        middle = np.degrees(np.arctan2((x0 + x1) / 2 - x, (y0 + y1) / 2 - y))
                        turned = [(np.degrees(np.arctan2(a - x, b - y)) - middle + 180) % 360 - 180 for a in (x0, x1) for b in (y0, y1)]
                        ks = np.unique(np.arange(np.floor((middle + min(turned)) / step), np.ceil((middle + max(turned)) / step) + 1).astype(int) % azimuths)
                    tans = np.full(azimuths, -np.inf)
                    if len(ds) and len(ks):
                        way = np.radians(ks * 360.0 / azimuths)
                        px, py = x + np.sin(way)[:, None] * ds, y + np.cos(way)[:, None] * ds
                        c, r = (px - west) / cell - 0.5, (north - py) / cell - 0.5
                        good = (c >= 0) & (r >= 0) & (c <= cols - 1) & (r <= rows - 1)
                        if inside:
                            fine_rows, fine_cols, fine_west, fine_north, fine = inside
                            fc, fr = (px - fine_west) / fine - 0.5, (fine_north - py) / fine - 0.5
                            good &= ~((fc >= 0) & (fr >= 0) & (fc <= fine_cols - 1) & (fr <= fine_rows - 1))
                        c0, r0 = np.minimum(np.where(good, c, 0).astype(int), cols - 2), np.minimum(np.where(good, r, 0).astype(int), rows - 2)
                        good &= (c0 // tile == u.tc) & (r0 // tile == u.tr)
                        which, far = np.nonzero(good)
                        if len(which):
                            c, r, c0, r0 = c[good], r[good], c0[good], r0[good]
                            a, b, v, w = r0 - u.tr * tile, c0 - u.tc * tile, c - c0, r - r0
                            ground = radius + ((grid[a, b] * (1 - v) + grid[a, b + 1] * v) * (1 - w) + (grid[a + 1, b] * (1 - v) + grid[a + 1, b + 1] * v) * w)
                            q0, q1, d = 1 + (x * x + y * y) / (4 * radius * radius), 1 + (px[good] ** 2 + py[good] ** 2) / (4 * radius * radius), ds[far]
                            cos_t = 1 - d * d / (q0 * q1) / (2 * radius * radius)
                            tan = (ground * cos_t - (radius + z + observer_m)) / (ground * np.sqrt(1 - cos_t * cos_t))
                            np.maximum.at(tans, ks[which], tan)
                    out.append((o["row"], o["col"], tans.tolist()))
                yield pd.DataFrame(out, columns=["row", "col", "tans"])

    return units.mapInPandas(march, "row int, col int, tans array<double>")


def tiled_horizons(
    observers: DataFrame, models: list[tuple[DataFrame, int, int, float, float, float]], save, azimuths: int = 360, far_m: float = 300_000.0, observer_m: float = 2.0,
    radius: float = R, tile: int = 256, together: int = 256,
) -> DataFrame:
    """``row, col, h``: as ``horizons``, over models that are tables of cells, of any size.

    ``models`` are (``cells(row, col, z)``, rows, columns, west, north, cell size), the finest first; of two, the first
    counts wherever it reaches. Each is cut into tiles, and observers into groups of about ``together`` neighbours. Rays go
    out from their group's tile in rings, each twice as wide as all before: a tile is sent the groups it can still matter
    to, with what their rays have seen so far. A tile that could not rise over the lowest horizon of a group, were its
    highest ground at its nearest edge, is not visited, so that distant rings fall away. Rounds grow with the logarithm of
    the reach in tiles, and no task holds more than a tile and a group.
    """
    seen = save(observers.select("row", "col", "x", "y", "z"))
    state = save(seen.select("row", "col", F.expr(f"array_repeat(double('-Infinity'), {azimuths})").alias("tans")))
    for n, (cells, rows, cols, west, north, cell) in enumerate(models):
        tiles = model_tiles(cells, rows, cols, tile, save)
        span = tile * cell
        deep, wide = (rows - 2) // tile, (cols - 2) // tile
        own = seen.withColumn("gr", F.floor((F.lit(north) - F.col("y")) / span).cast("int")).withColumn("gc", F.floor((F.col("x") - west) / span).cast("int"))
        crowds = own.groupBy("gr", "gc").agg(F.ceil(F.count("*") / together).alias("_n"))
        own = own.join(crowds, ["gr", "gc"]).withColumn("part", F.pmod(F.xxhash64("row", "col"), F.col("_n"))).drop("_n")
        own = save(own)
        group = ["gr", "gc", "part"]
        reach = int(far_m / span) + 2
        low, high = 0, 0
        while low <= reach:
            high = min(high, reach)
            lowest = own.join(state, ["row", "col"]).groupBy(*group).agg(F.min(F.array_min("tans")).alias("least"), F.min("z").alias("_z"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
            between = lambda c, most, high=high: F.explode(F.expr(f"sequence(greatest(0, {c} - {high}), least({most}, {c} + {high}))"))
            near = lowest.filter(F.expr(f"gr - {high} <= {deep} AND gr + {high} >= 0 AND gc - {high} <= {wide} AND gc + {high} >= 0"))
            near = near.withColumn("tr", between("gr", deep)).withColumn("tc", between("gc", wide))
            near = near.filter(F.greatest(F.abs(F.col("tr") - F.col("gr")), F.abs(F.col("tc") - F.col("gc"))) >= low)
            x0, x1 = F.lit(west) + F.col("tc") * span, F.lit(west) + (F.col("tc") + 1) * span + cell
            y1, y0 = F.lit(north) - F.col("tr") * span, F.lit(north) - (F.col("tr") + 1) * span - cell
            gap = lambda a, b, p, q: F.greatest(F.lit(0.0), a - q, p - b)
            gap = F.hypot(gap(x0, x1, F.col("xa"), F.col("xb")), gap(y0, y1, F.col("ya"), F.col("yb")))
            edge = lambda a, b: F.greatest(F.abs(a), F.abs(b))
            # the map is wider than the ground by up to q; a twentieth more for the curvature of what lies between
            q = 1 + (edge(x0, x1) ** 2 + edge(y0, y1) ** 2) / (4 * radius * radius)
            rise = F.greatest(F.col("top") - F.col("_z") - observer_m, F.lit(0.0))
            could = (gap <= cell) | (1.05 * q * rise / gap >= F.col("least"))
            units = near.withColumn("_gap", gap).filter(F.col("_gap") <= far_m).join(tiles.select("tr", "tc", "top"), ["tr", "tc"]).filter(could)
            groups = own.groupBy(*group).agg(F.collect_list(F.struct("row", "col", "x", "y", "z")).alias("seen"))
            units = units.select(*group, "tr", "tc").join(groups, group).join(tiles.select("tr", "tc", "at", "heights"), ["tr", "tc"])
            units = units.repartition(units.sparkSession.sparkContext.defaultParallelism * 4, *group, "tr", "tc")
            finer = models[0][1:] if n else None
            made = _highest(units, (rows, cols, west, north, cell), tile, finer, azimuths, far_m, observer_m, radius)
            folded = state.unionByName(made).groupBy("row", "col").agg(F.collect_list("tans").alias("all"))
            best = F.aggregate("all", F.expr(f"array_repeat(double('-Infinity'), {azimuths})"), lambda m, t: F.zip_with(m, t, lambda a, b: F.greatest(a, b)))
            state = save(folded.select("row", "col", best.alias("tans")))
            low, high = high + 1, 2 * high + 1
    return state.select("row", "col", F.transform("tans", lambda t: F.degrees(F.atan(t))).alias("h"))
