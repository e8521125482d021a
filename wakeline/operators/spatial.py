"""Joins of points with zones, segments and each other, all as equi-joins on grid cells followed by the exact test.

Nothing is broadcast by hand: the cell is an ordinary join key, so Spark broadcasts a small side and shuffles a large one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def with_ring(zones: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Zones with ``ring`` (edges), bounding box and area."""
    b = geo.bounds(F.col(vertices))
    return zones.withColumn("ring", geo.edges(F.col(vertices))).withColumns(b).withColumn("area", geo.ring_area(F.col("ring")))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


#: Levels of the grid for zones and legs: a level has 2 ** level columns round the globe.
LEVELS = (14, 12, 10, 8, 6, 4, 2)
#: A zone, or a leg, is put on the finest level where it is no longer than so many cells.
MOST_CELLS = 8


def _finest(size: float) -> tuple[int, ...]:
    """The levels whose cells are not much smaller than ``size`` degrees."""
    return tuple(k for k in LEVELS if 360 / 2**k >= size * 0.9) or LEVELS[-1:]


def _level(span: Column, levels: tuple[int, ...]) -> Column:
    out = F.lit(levels[-1])
    for k in levels[-2::-1]:
        out = F.when(span <= MOST_CELLS * 360 / 2**k, k).otherwise(out)
    return out


def _row_of(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) * F.pow(F.lit(2.0), level) / 360).cast("long")


def _column_of(lon: Column, level: Column) -> Column:
    """Not yet wrapped: longitudes beyond 180 have columns beyond the last."""
    return F.floor((lon + 180) * F.pow(F.lit(2.0), level) / 360).cast("long")


def _wrapped(column: Column, level: Column) -> Column:
    return F.pmod(column, F.pow(F.lit(2.0), level).cast("long"))


def _levels_of(df: DataFrame) -> list[int]:
    return sorted(r["_level"] for r in df.select("_level").distinct().collect())  # at most len(LEVELS) numbers


def _box_cells(boxes: DataFrame) -> DataFrame:
    """A row per cell of _level that the box _x0, _x1, _y0, _y1 touches: _cx, _cy."""
    level = F.col("_level")
    across = F.transform(F.sequence(_column_of(F.col("_x0"), level), _column_of(F.col("_x1"), level)), lambda c: _wrapped(c, level))
    return boxes.withColumn("_cx", F.explode(F.array_distinct(across))).withColumn("_cy", F.explode(F.sequence(_row_of(F.col("_y0"), level), _row_of(F.col("_y1"), level))))


def as_seen_from(lon: Column, low: Column, high: Column) -> Column:
    """A longitude, or the same place a turn further, such that it lies in [low, high] if it can; a zone may so reach beyond 180 degrees."""
    return F.when((lon < low) & (lon + 360 <= high), lon + 360).when((lon > high) & (lon - 360 >= low), lon - 360).otherwise(lon)


def _margins(margin: float, lat: Column) -> tuple[float, Column]:
    """Degrees of latitude and longitude that hold so many metres beyond a box whose sides reach up to ``lat`` north or south, as ``geo.segment_distance`` measures them."""
    up = margin * 1.000001 / (math.radians(1) * geo.EARTH_M)
    return up, F.least(up / F.greatest(F.cos(F.radians(F.least(lat + up, F.lit(90.0)))), F.lit(1e-6)), F.lit(180.0))


def near_zones(points: DataFrame, zones: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Pairs of a point and a zone (with ``with_ring``) whose bounding box, widened by ``margin`` metres, holds it; ``zone_lon`` is the point's longitude as the zone counts.

    Cells have several levels, the finest of about ``size`` degrees. A zone is repeated for the cells its box touches on the level that suits its extent, some
    dozens at most however wide it is; a point has one cell on each level that zones are on, so a pair comes once.
    """
    up, wide = _margins(margin, F.greatest(F.abs("min_lat"), F.abs("max_lat")))
    boxed = zones.withColumns({"_x0": F.col("min_lon") - wide, "_x1": F.col("max_lon") + wide, "_y0": F.col("min_lat") - up, "_y1": F.col("max_lat") + up})
    boxed = boxed.withColumn("_level", _level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), _finest(size)))
    used = _levels_of(boxed)
    if not used:
        used = [LEVELS[-1]]
    placed = points.withColumn("_level", F.lit(used[0]) if len(used) == 1 else F.explode(F.array(*map(F.lit, used))))
    placed = placed.withColumns({"_cx": _wrapped(_column_of(F.col("lon"), F.col("_level")), F.col("_level")), "_cy": _row_of(F.col("lat"), F.col("_level"))})
    met = placed.join(_box_cells(boxed), ["_level", "_cx", "_cy"]).withColumn("zone_lon", as_seen_from(F.col("lon"), F.col("_x0"), F.col("_x1")))
    inside = F.col("zone_lon").between(F.col("_x0"), F.col("_x1")) & F.col("lat").between(F.col("_y0"), F.col("_y1"))
    return met.filter(inside).drop("_level", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1")


def in_zones(points: DataFrame, zones: DataFrame, size: float, boundary: bool = True) -> DataFrame:
    """All pairs of a point and a zone that contains it."""
    return near_zones(points, zones, size).filter(geo.in_polygon(F.col("zone_lon"), F.col("lat"), F.col("ring"), boundary)).drop("zone_lon")


def best_zone(points: DataFrame, zones: DataFrame, key: list[str], pick: tuple, name: str, size: float) -> DataFrame:
    """Each point with ``name``: of the zones that contain it the one with the least ``pick`` (columns or expressions); null if none."""
    hits = in_zones(points.select(*key, "lon", "lat"), zones, size)
    best = hits.groupBy(*key).agg(F.min_by("zone", F.struct(*pick)).alias(name))
    return points.join(best, key, "left")


def nearest_zone(points: DataFrame, zones: DataFrame, key: list[str], within: float, size: float) -> DataFrame:
    """The nearest zone within a distance (0 inside), ties by name."""
    lon, lat, ring = F.col("zone_lon"), F.col("lat"), F.col("ring")
    d = F.when(geo.in_polygon(lon, lat, ring), F.lit(0.0)).otherwise(geo.ring_distance(lon, lat, ring))
    hits = near_zones(points.select(*key, "lon", "lat"), zones, size, within).withColumn("distance", d).filter(F.col("distance") <= within)
    return hits.groupBy(*key).agg(F.min(F.struct("distance", "zone")).alias("_m")).select(*key, F.col("_m.zone").alias("zone"), F.col("_m.distance").alias("distance"))


def nearest_segment(points: DataFrame, segments: DataFrame, key: list[str], within: float, size: float) -> DataFrame:
    """Distance to the nearest segment (x1, y1, x2, y2, segment) within a radius, through the cells it passes."""
    boxed = segments.withColumns({"min_lon": F.least("x1", "x2"), "max_lon": F.greatest("x1", "x2"), "min_lat": F.least("y1", "y2"), "max_lat": F.greatest("y1", "y2")})
    pairs = near_zones(points.select(*key, "lon", "lat"), boxed, size, within)
    d = geo.segment_distance(F.col("zone_lon"), F.col("lat"), F.struct("x1", "y1", "x2", "y2"))
    return pairs.withColumn("distance", d).filter(F.col("distance") <= within).groupBy(*key).agg(F.min("distance").alias("distance"))


def leg_cells(legs: DataFrame, levels: list[int]) -> DataFrame:
    """A row per cell that the line from (_plon, _plat) to (_elon, lat) passes, on each of the levels or its own if that is coarser.

    The cells are walked along the line, by grid column, so a leg has no more than a few for each of the ``MOST_CELLS`` columns and rows it spans.
    """
    span = F.greatest(F.abs(F.col("_elon") - F.col("_plon")), F.abs(F.col("lat") - F.col("_plat")))
    own = _level(span, LEVELS)
    at = F.array_distinct(F.array(*(F.least(F.lit(k), own) for k in levels)))
    spread = legs.withColumn("_level", F.explode(at))
    level, width = F.col("_level"), F.lit(360.0) / F.pow(F.lit(2.0), F.col("_level"))
    west, east = F.least("_plon", "_elon"), F.greatest("_plon", "_elon")
    spread = spread.withColumn("_c", F.explode(F.sequence(_column_of(west, level), _column_of(east, level))))
    a, b = F.greatest(west, F.col("_c") * width - 180), F.least(east, (F.col("_c") + 1) * width - 180)  # the part within the column
    slope = (F.col("lat") - F.col("_plat")) / F.when(F.col("_elon") != F.col("_plon"), F.col("_elon") - F.col("_plon")).otherwise(1.0)
    steep = F.col("_elon") == F.col("_plon")
    y = [F.when(steep, end).otherwise(F.col("_plat") + (x - F.col("_plon")) * slope) for x, end in ((a, F.col("_plat")), (b, F.col("lat")))]
    slack = F.lit(1e-9)
    spread = spread.withColumn("_cy", F.explode(F.sequence(_row_of(F.least(*y) - slack, level), _row_of(F.greatest(*y) + slack, level))))
    return spread.withColumn("_cx", _wrapped(F.col("_c"), level)).drop("_c")


def legs_meeting(fixes: DataFrame, zones: DataFrame, key: str, margin: float, size: float = 0.1) -> DataFrame:
    """The fixes that matter for a zone: ends of legs that pass its box, widened by a margin in metres, and their starts.

    fixes: mmsi, t, lon, lat. Zones (key, vertices) may hold from ``from_t`` to before ``until_t`` (null: open). Returns mmsi, key, t, lon, lat, ``is_end``
    and ``is_first`` (the vessel's first fix, or its first since the zone holds); between the rows of a zone a vessel was outside it. A leg goes the short
    way round the globe and is looked up by the cells along its line, of a level that suits its length.
    """
    w = Window.partitionBy("mmsi").orderBy("t")
    legs = fixes.select("mmsi", "t", "lon", "lat", *(F.lag(c).over(w).alias(f"_p{c}") for c in ("t", "lon", "lat")))
    legs = legs.withColumns({c: F.coalesce(c, c[2:]) for c in ("_plon", "_plat")})
    turn = F.when(F.col("lon") - F.col("_plon") > 180, F.col("lon") - 360).when(F.col("lon") - F.col("_plon") < -180, F.col("lon") + 360).otherwise(F.col("lon"))
    legs = legs.withColumn("_elon", turn)
    b = geo.bounds(F.col("vertices"))
    up, wide = _margins(margin, F.greatest(F.abs(b["min_lat"]), F.abs(b["max_lat"])))
    held = [F.col(c).cast("double").alias(c) if c in zones.columns else F.lit(None).cast("double").alias(c) for c in ("from_t", "until_t")]
    box = zones.select(key, *held, (b["min_lon"] - wide).alias("_x0"), (b["max_lon"] + wide).alias("_x1"), (b["min_lat"] - up).alias("_y0"), (b["max_lat"] + up).alias("_y1"))
    levels = _finest(size)
    box = box.withColumn("_level", _level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), levels))
    used = _levels_of(box) or [LEVELS[-1]]
    # a leg that is too long for a zone's level looks for it on its own, coarser one, so zones are there too
    zones_at = box.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda k: k <= F.col("_level"))))
    met = leg_cells(legs, used).join(_box_cells(zones_at), ["_level", "_cx", "_cy"])
    west, east = F.least("_plon", "_elon"), F.greatest("_plon", "_elon")
    low, high = F.least("_plat", "lat"), F.greatest("_plat", "lat")
    beside = F.exists(F.array(*(F.lit(float(d)) for d in (0, 360, -360))), lambda d: (west + d <= F.col("_x1")) & (east + d >= F.col("_x0")))
    met = met.filter(beside & (low <= F.col("_y1")) & (high >= F.col("_y0")))
    met = met.filter((F.col("from_t").isNull() | (F.col("t") >= F.col("from_t"))) & (F.col("until_t").isNull() | (F.col("t") < F.col("until_t"))))
    opens = F.col("_pt").isNull() | F.coalesce(F.col("_pt") < F.col("from_t"), F.lit(False))
    met = met.withColumn("_opens", opens)
    ends = met.select("mmsi", key, "t", "lon", "lat", F.lit(True).alias("is_end"), F.col("_opens").alias("is_first"))
    starts = met.filter(~F.col("_opens")).select("mmsi", key, F.col("_pt").alias("t"), F.col("_plon").alias("lon"), F.col("_plat").alias("lat"), F.lit(False).alias("is_end"), F.lit(False).alias("is_first"))
    both = ends.unionByName(starts)
    return both.groupBy("mmsi", key, "t").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.max("is_end").alias("is_end"), F.max("is_first").alias("is_first"))


def _band(lat: Column, size: Column) -> Column:
    return F.floor(lat / size).cast("long")


def _columns_of(band: Column, size: Column) -> Column:
    """How many cells a band of latitude has round the globe: none is narrower than ``size`` degrees of latitude are high."""
    most = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * size, F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(most)) / size), F.lit(1)).cast("long")


def with_cell(df: DataFrame, radius: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """_cy, _cx: the cell of a point for a search of so many metres; the same at every longitude and latitude."""
    size = _degrees(radius)
    band = _band(F.col(lat), size)
    n = _columns_of(band, size)
    return df.withColumns({"_cy": band, "_cx": F.pmod(F.floor((F.col(lon) + 180) * n / 360).cast("long"), n)})


def with_cells_around(df: DataFrame, radius: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A row per cell that a circle of so many metres around the point touches, across 180 degrees too."""
    size = _degrees(radius)
    spread = df.withColumn("_cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _band(F.col(lat), size) + d)))
    n = _columns_of(F.col("_cy"), size)
    reach, up = F.sin(radius * 1.0001 / geo.EARTH_M), F.cos(F.radians(lat))
    wide = F.when((reach < up) & (radius < geo.EARTH_M), F.degrees(F.asin(reach / F.when(reach < up, up).otherwise(1.0)))).otherwise(F.lit(180.0)) + 1e-9
    low, high = (F.floor((F.col(lon) + 180 + d * wide) * n / 360).cast("long") for d in (-1, 1))
    round_ = F.sequence(F.lit(0).cast("long"), n - 1)
    some = F.transform(F.sequence(low, high), lambda i: F.pmod(i, n))
    return spread.withColumn("_cx", F.explode(F.when(high - low + 1 >= n, round_).otherwise(some)))


def _degrees(radius: Column) -> Column:
    """Degrees of latitude, with a little slack."""
    return F.degrees(radius * 1.001 / geo.EARTH_M)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """Pairs within ``radius`` metres, anywhere on the globe: columns of both, the right's with suffix _b, and ``distance``.

    The right side is repeated for the cells around its own; ``on`` names further equi-join columns (a frame, say).
    The caller filters symmetric pairs.
    """
    a = with_cell(left, F.lit(float(radius)))
    b = right.select(*on, *(F.col(c).alias(f"{c}_b") for c in right.columns if c not in on))
    b = with_cells_around(b, F.lit(float(radius)), "lon_b", "lat_b")
    d = geo.haversine(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b"))
    pairs = a.join(b, ["_cx", "_cy", *on]).drop("_cx", "_cy").withColumn("distance", d)
    return pairs.filter(F.col("distance") <= radius) if exact else pairs


def nearest_point(points: DataFrame, targets: DataFrame, key: list[str], within: float) -> DataFrame:
    """The nearest target within a radius, with its columns (suffix _b) and distance; ties by smallest target columns."""
    pairs = near_pairs(points, targets, within)
    rest = [c for c in pairs.columns if c.endswith("_b")]
    best = pairs.groupBy(*key).agg(F.min(F.struct("distance", *rest)).alias("_m"))
    return best.select(*key, F.col("_m.distance").alias("distance"), *(F.col(f"_m.{c}").alias(c) for c in rest))


def nearest_listed(points: DataFrame, targets: DataFrame, within: float, name: str, near: float = 0.125) -> DataFrame:
    """Each point with ``name``: a struct of the distance to the nearest target within a radius and its columns (suffix _b), null if none; ties as in ``nearest_point``.

    For targets that are thin on the ground, such as grid points: the targets about a cell go with it as a list, so no row is made for a pair, and a point stays one row. Lists of a
    share ``near`` of the radius are asked first; the long ones only where these say nothing.
    """
    kept = targets.select(*(F.col(c).alias(f"{c}_b") for c in targets.columns))
    out, names = points, [f"{c}_b" for c in targets.columns]
    for k, radius in enumerate(F.lit(float(r)) for r in (within * near, within)):
        cells = [f"_{c}{k}" for c in ("cx", "cy")]
        spread = with_cells_around(kept, radius, "lon_b", "lat_b").withColumnsRenamed(dict(zip(("_cx", "_cy"), cells, strict=True)))
        lists = spread.groupBy(*cells).agg(F.collect_list(F.struct(*names)).alias("_list"))
        met = with_cell(out, radius).withColumnsRenamed(dict(zip(("_cx", "_cy"), cells, strict=True))).join(lists, cells, "left")
        rated = F.transform("_list", lambda b: F.struct(geo.haversine(F.col("lon"), F.col("lat"), b["lon_b"], b["lat_b"]).alias("distance"), *(b[c].alias(c) for c in names)))
        nearest = F.array_min(rated)
        best = F.when(nearest["distance"] <= radius, nearest)
        out = met.withColumn(name, best if k == 0 else F.coalesce(name, best)).drop("_list", *cells)
    return out


def nearest_anywhere(points: DataFrame, targets: DataFrame, key: list[str], first: float = 1000.0, widen: float = 8.0) -> DataFrame:
    """The nearest target of each point, however far, with its columns (suffix _b) and distance; no rows if there are no targets.

    Rings: points that have a target within the radius are done, as all targets within it have been met; the others go on with a wider one, until it is the whole
    globe. So only points with nothing near pay for a wide search, and each round is a join on cells of its radius.
    """
    open_, found, radius, half = points, None, first, 3.15 * geo.EARTH_M
    while True:
        hit = nearest_point(open_, targets, key, min(radius, half)).persist()
        found = hit if found is None else found.unionByName(hit)
        open_ = open_.join(hit.select(*key), key, "left_anti")
        if radius >= half or open_.isEmpty():
            return found
        radius *= widen


def route_grid(points: DataFrame, grid: float, at_least: int) -> DataFrame:
    """Cells with many points: count, mean position, mean axis of the courses (double-angle) and its coherence."""
    two = F.radians(F.col("course") * 2)
    agg = points.groupBy(cell(F.col("lon"), grid).alias("cell_x"), cell(F.col("lat"), grid).alias("cell_y")).agg(
        F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.sum(F.cos(two)).alias("c"), F.sum(F.sin(two)).alias("s"), F.count("course").alias("n_course"),
    )
    axis = F.pmod(F.degrees(F.atan2("s", "c")) / 2 + 360, F.lit(180.0))
    return agg.filter(F.col("n") >= at_least).select("cell_x", "cell_y", "n", "lon", "lat", F.when(F.col("n_course") > 0, axis).alias("axis"), F.when(F.col("n_course") > 0, F.hypot("c", "s") / F.col("n_course")).alias("coherence"))


def override(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both, a change taking the place of the base row with its key; an inactive one removes it."""
    names = [c for c in base.columns if c != key]
    b, c = base.select(key, F.lit(True).alias("_b"), F.struct(*names).alias("_base")), changes.select(key, F.lit(True).alias("_c"), "is_active", F.struct(*names).alias("_change"))
    merged = b.join(c, key, "full_outer").filter(F.col("_c").isNull() | F.col("is_active"))
    return merged.select(key, *(F.when(F.col("_c"), F.col(f"_change.{n}")).otherwise(F.col(f"_base.{n}")).alias(n) for n in names))
