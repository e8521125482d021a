"""The detectors: each a function from DataFrames of fixes and reference tables, with a frozen configuration, to alerts.

Fixes have mmsi, t (epoch seconds), lon, lat, speed (knots), course, and what a detector names. The reference time is the newest time of the input.
A frame, where one is needed, is a distinct value of the column ``frame``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.records import UNKNOWN_NAME, at_night, identity_mismatch, pair_key, registry, ship_mmsi
from ..operators import folds, sequence, spatial, temporal, tracks


def blacklist(ships: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed vessels that are present; an unknown name falls back to the list's."""
    found = ships.join(listed.withColumnRenamed("name", "_listed"), "mmsi")
    return found.withColumn("name", F.when(F.col("name").isNull() | (F.col("name") == UNKNOWN_NAME), F.col("_listed")).otherwise(F.col("name"))).drop("_listed")


@dataclass(frozen=True)
class CollisionConfig:
    max_age: float = 120.0
    horizon: float = 900.0
    min_relative: float = 0.2
    warning: float = 300.0
    buffer: float = 50.0
    high_seconds: float = 300.0
    high_dcpa: float = 150.0
    high_now: float = 100.0


#: Upper speeds (knots) of the classes that the pair search uses; a report can't say more than 102.2.
SPEED_CLASSES = (2.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0, 102.3)


def collision(ships: DataFrame, cfg: CollisionConfig = CollisionConfig(), order: str = "id") -> DataFrame:
    """Pairs on collision course, by closest point of approach. Of a vessel's reports of its newest time the first by ``order`` counts.

    A pair can only meet within the horizon if it is nearer now than safety + both speeds times the horizon. A vessel looks for
    those that are no faster, in cells of a size that follows from its own speed class, so fast reports don't widen the search
    of the slow; a vessel is repeated for the cells of its class and the faster ones. Speeds above 102.2 knots are no speeds.
    """
    valid = ships.filter(F.col("mmsi").isNotNull() & F.col("speed").between(0, 102.2) & F.col("course").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rows = sequence.latest(valid.select("mmsi", "t", "lon", "lat", "speed", "course", "length", order), tie=order, last_wins=False)
    fresh = sequence.fresh(rows, cfg.max_age).persist()  # one row a vessel, needed three times
    ref = fresh.agg(F.max("t").alias("ref"), F.max("length").alias("l")).first()
    now, safety = (0, cfg.warning) if ref["ref"] is None else (ref["ref"], max(cfg.warning, (ref["l"] or 0.0) + cfg.buffer))
    lon, lat = geo.dead_reckon(F.col("lon"), F.col("lat"), F.col("speed"), F.col("course"), F.lit(now) - F.col("t"))
    v = F.col("speed") * geo.KNOT_MPS
    level = F.lit(0)
    for k, most in enumerate(SPEED_CLASSES[:-1]):
        level = F.when(F.col("speed") > most, k + 1).otherwise(level)
    placed = fresh.select("mmsi", "length", lon.alias("lon"), lat.alias("lat"), (v * F.sin(F.radians("course"))).alias("vx"), (v * F.cos(F.radians("course"))).alias("vy"), level.alias("level"))
    reach = F.element_at(F.array(*(F.lit((safety + 2 * most * geo.KNOT_MPS * cfg.horizon) * 1.01) for most in SPEED_CLASSES)), F.col("level") + 1)
    others = placed.select(*(F.col(c).alias(f"{c}_b") for c in placed.columns)).withColumn("level", F.explode(F.sequence("level_b", F.lit(len(SPEED_CLASSES) - 1))))
    met = spatial.with_cell(placed, reach).join(spatial.with_cells_around(others, reach, "lon_b", "lat_b"), ["_cx", "_cy", "level"])
    met = met.filter((F.col("level") > F.col("level_b")) | (F.col("mmsi") < F.col("mmsi_b"))).filter("mmsi <> mmsi_b")
    swap = F.col("mmsi") > F.col("mmsi_b")
    names = ("mmsi", "length", "lon", "lat", "vx", "vy")
    pairs = met.select(*(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(c)).alias(c) for c in names), *(F.when(swap, F.col(c)).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in names))
    mid = F.radians((F.col("lat") + F.col("lat_b")) / 2)
    east = F.pmod(F.col("lon_b") - F.col("lon") + 180, F.lit(360.0)) - 180
    wide = F.when(F.abs(F.col("lon_b") - F.col("lon")) <= 180, F.col("lon_b") - F.col("lon")).otherwise(east)
    x, y = F.radians(wide) * geo.EARTH_M * F.cos(mid), F.radians(F.col("lat_b") - F.col("lat")) * geo.EARTH_M
    a = geo.closest_approach(x, y, F.col("vx_b") - F.col("vx"), F.col("vy_b") - F.col("vy"))
    rated = pairs.withColumns({**a, "now_distance": F.hypot(x, y), "safety": geo.safety_distance(F.col("length"), F.col("length_b"), cfg.warning, cfg.buffer)})
    alerts = rated.filter(F.col("closing") & F.col("tcpa").between(0, cfg.horizon) & (F.col("relative_speed") >= cfg.min_relative) & (F.col("dcpa") <= F.col("safety")))
    high = ((F.col("tcpa") <= cfg.high_seconds) & (F.col("dcpa") <= cfg.high_dcpa)) | (F.col("now_distance") <= cfg.high_now)
    risk = F.when(high, "high").otherwise("medium").alias("risk")
    return alerts.select(F.col("mmsi").alias("mmsi_a"), "mmsi_b", pair_key(F.col("mmsi"), F.col("mmsi_b")).alias("pair"), "tcpa", "dcpa", "now_distance", "relative_speed", risk)


@dataclass(frozen=True)
class HighSpeedConfig:
    limit: float = 30.0
    max_gap: float = 90.0
    window: float = 1800.0
    min_seconds: float = 300.0
    high_excess: float = 10.0


def high_speed(fixes: DataFrame, cfg: HighSpeedConfig = HighSpeedConfig()) -> DataFrame:
    """Vessels above the limit without a break for long enough."""
    ref = fixes.agg(F.max("t").alias("_ref"))
    recent = fixes.filter(F.col("speed").between(0, 102.2)).crossJoin(F.broadcast(ref)).filter(F.col("t") >= F.col("_ref") - cfg.window).drop("_ref")  # one row
    run = tracks.speed_summary(sequence.tail(recent, F.col("speed") > cfg.limit, cfg.max_gap), ["mmsi"])
    return run.filter(F.col("duration") >= cfg.min_seconds).withColumn("risk", F.when(F.col("max_speed") - cfg.limit >= cfg.high_excess, "high").otherwise("medium"))


@dataclass(frozen=True)
class LowSpeedConfig:
    default_limit: float | None = 1.5
    max_gap: float = 90.0
    still_speed: float = 0.5
    still_seconds: float = 300.0
    still_drift: float = 50.0
    min_points: int = 5
    min_seconds: float = 300.0


def low_speed(fixes: DataFrame, cfg: LowSpeedConfig = LowSpeedConfig()) -> DataFrame:
    """Vessels under way, eligible, yet below their zone's speed limit without having stopped.

    Fixes carry zone and zone_limit (null outside) and ``eligible``. A stop (slow, long enough, without drift from its start) resets the run.
    """
    ruled = fixes.withColumn("limit", F.coalesce("zone_limit", F.lit(cfg.default_limit).cast("double")))
    run = sequence.tail(ruled, F.col("eligible") & F.col("limit").isNotNull() & (F.col("speed") < F.col("limit")), cfg.max_gap, same=("zone", "limit"))
    still = sequence.islands(run, F.col("speed") <= cfg.still_speed)
    start = Window.partitionBy("mmsi", "island").orderBy("t")
    drift = geo.haversine(F.first("lon").over(start), F.first("lat").over(start), F.col("lon"), F.col("lat"))
    stops = still.withColumn("_drift", drift).groupBy("mmsi", "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("_drift").alias("d")).filter((F.col("b") - F.col("a") >= cfg.still_seconds) & (F.col("d") <= cfg.still_drift))
    last = stops.groupBy("mmsi").agg(F.max("b").alias("_stopped"))
    moving = run.join(last, "mmsi", "left").filter(F.col("_stopped").isNull() | (F.col("t") > F.col("_stopped")))
    found = tracks.speed_summary(moving, ["mmsi", "zone", "limit"])
    return found.filter((F.col("n_points") >= cfg.min_points) & (F.col("duration") >= cfg.min_seconds))


@dataclass(frozen=True)
class DeviationConfig:
    min_speed: float = 2.0
    max_gap: float = 90.0
    min_points: int = 5
    min_seconds: float = 120.0
    min_displacement: float = 500.0
    on_route: float = 750.0
    off_route: float = 1500.0
    high: float = 3000.0
    max_axis: float = 45.0
    min_coherence: float = 0.5
    off_points: int = 3
    off_seconds: float = 60.0


def deviation(fixes: DataFrame, routes: DataFrame, cfg: DeviationConfig = DeviationConfig(), search: float = 20_000.0, margin: float = 20_000.0) -> DataFrame:
    """Vessels that were on a route and have left it. Routes: lon, lat, axis, coherence (``spatial.route_grid``).

    Fixes outside the box of all routes, widened by ``margin`` metres, are not covered: nothing is known of them, so they are neither on a route nor off.
    """
    run = sequence.tail(fixes.filter("eligible"), F.col("speed") >= cfg.min_speed, cfg.max_gap)
    shape = tracks.shape(run, ["mmsi"], (F.max("t") - F.min("t")).alias("duration"))
    able = shape.filter((F.col("n_points") >= cfg.min_points) & (F.col("duration") >= cfg.min_seconds) & (F.col("displacement") >= cfg.min_displacement)).select("mmsi")
    track = run.join(able, "mmsi", "left_semi")
    found = spatial.nearest_listed(track, routes.select("lon", "lat", "axis", "coherence"), search, "_near")
    rated = found.select(*track.columns, "_near.distance", "_near.axis_b", "_near.coherence_b")
    axis_ok = (F.col("coherence_b") < cfg.min_coherence) | F.col("axis_b").isNull() | (geo.axial_angle_between(F.col("course"), F.col("axis_b")) <= cfg.max_axis)
    rated = rated.withColumn("distance", F.coalesce("distance", F.lit(search))).withColumn("on", (F.col("distance") <= cfg.on_route) & F.coalesce(axis_ok, F.lit(False)))
    box = F.broadcast(routes.agg(F.min("lon").alias("_w"), F.min("lat").alias("_s"), F.max("lon").alias("_e"), F.max("lat").alias("_n")))  # one row
    rated = rated.crossJoin(box).withColumn("_covered", geo.in_box(F.col("lon"), F.col("lat"), F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n"), margin)).drop("_w", "_s", "_e", "_n")
    seen = sequence.ever(rated, F.col("on"), "seen")
    away = sequence.tail(seen, F.col("seen") & F.coalesce("_covered", F.lit(False)) & (F.col("distance") >= cfg.off_route) & ~F.col("on"))
    found = away.groupBy("mmsi").agg(F.count("*").alias("n_points"), F.min("t").alias("off_since"), (F.max("t") - F.min("t")).alias("off_seconds"), F.max_by("distance", "t").alias("distance"))
    return found.filter((F.col("n_points") >= cfg.off_points) & (F.col("off_seconds") >= cfg.off_seconds)).withColumn("risk", F.when(F.col("distance") >= cfg.high, "high").otherwise("to verify"))


def fence_versions(history: DataFrame) -> DataFrame:
    """What a fence was when: fence, version, mode, vertices, from_t, until_t (null: still so), from its rows over time (fence, t, mode, vertices, and others).

    Another geometry begins a version; a row that changes only the name or the mode does not. Of a version the last row's mode counts.
    """
    shape = F.sha2(F.to_json("vertices"), 256)
    w = Window.partitionBy("fence").orderBy("t")
    runs = history.withColumn("_shape", shape).withColumn("_new", (~F.col("_shape").eqNullSafe(F.lag("_shape").over(w))).cast("int"))
    numbered = runs.withColumn("version", F.sum("_new").over(w) - 1)
    each = numbered.groupBy("fence", "version").agg(F.min("t").alias("from_t"), F.max_by("mode", "t").alias("mode"), F.min_by("vertices", "t").alias("vertices"))
    return each.withColumn("until_t", F.lead("from_t").over(Window.partitionBy("fence").orderBy("version"))).withColumn("from_t", F.when(F.col("version") > 0, F.col("from_t")))


def fence_crossings(fixes: DataFrame, fences: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """enter, exit and transit events of vessels at fences (fence, mode, vertices): mmsi, t, fence, direction.

    Between stable sides the boundary keeps the last one; a first stable side is only taken note of, unless the first fix was on the line: then it is an
    enter or an exit. A leg between two outside fixes that cuts the fence twice is a transit. With ``fence_versions`` each version of a
    fence (version, from_t, until_t) begins anew with a vessel's first fix in its time.
    Only legs near a fence are looked at: a vessel is outside wherever it has no row for it, and the start of such a leg has no event of its own.
    """
    own = [c for c in ("version", "from_t", "until_t") if c in fences.columns]
    keyed = fences.select("fence", "mode", "vertices", *own).withColumn("_fence", F.struct("fence", *own[:1]))
    west = F.array_min(F.transform("vertices", lambda v: v["lon"]))
    ringed = keyed.select("_fence", "mode", geo.edges(F.col("vertices")).alias("ring"), west.alias("_west"))
    near = spatial.legs_meeting(fixes, keyed, "_fence", tolerance)
    turned = F.when(F.col("lon") < F.col("_west") - 180, F.col("lon") + 360).when(F.col("lon") > F.col("_west") + 180, F.col("lon") - 360).otherwise(F.col("lon"))
    sided = near.join(ringed, "_fence").withColumn("lon", turned).withColumn("side", geo.side_of_fence(F.col("lon"), F.col("lat"), F.col("ring"), tolerance))
    by = ("mmsi", "_fence")
    stable = F.col("side") != "boundary"
    sided = sequence.carried(sided.withColumn("_at", F.struct("side", "lon", "lat")), "_at", stable, "_before", by)
    begun = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    on_line = F.first(F.col("is_first") & ~stable).over(begun)
    cuts = F.size(geo.crossing_places(F.col("_before.lon"), F.col("_before.lat"), F.col("lon"), F.col("lat"), F.col("ring")))
    near_leg = F.abs(F.col("lon") - F.col("_before.lon")) <= 180
    was = F.when(F.col("_before").isNotNull(), F.col("_before.side")).when(on_line, F.when(F.col("side") == "inside", "outside").otherwise("inside"))
    direction = (
        F.when(~stable | ~F.col("is_end") | was.isNull(), None).when((was == "outside") & (F.col("side") == "inside"), "enter")
        .when((was == "inside") & (F.col("side") == "outside"), "exit").when((was == "outside") & (F.col("side") == "outside") & near_leg & (cuts >= 2), "transit")
    )
    found = sided.withColumn("direction", direction).filter(F.col("direction").isNotNull())
    found = found.filter((F.col("direction") == "transit") | (F.col("mode") == "both") | (F.col("mode") == F.col("direction")))
    return found.select("mmsi", "t", F.col("_fence.fence").alias("fence"), *(F.col(f"_fence.{c}").alias(c) for c in own[:1]), "direction")


@dataclass(frozen=True)
class WanderingConfig:
    window: float = 1800.0
    max_gap: float = 300.0
    jump_metres: float = 500.0
    jump_knots: float = 80.0
    min_points: int = 10
    min_seconds: float = 1800.0
    max_diameter: float = 3000.0
    min_leg: float = 20.0
    min_path: float = 300.0
    min_speed: float = 0.5
    max_directness: float = 0.3
    min_turns: int = 4
    turn_degrees: float = 30.0
    turn_seconds: float = 30.0
    min_revisit: float = 0.4
    grid: float = 200.0
    monitored_only: bool = False
    min_area_share: float = 0.8
    normal_share: float = 0.8
    port_speed: float = 3.0
    port_diameter: float = 1000.0
    anchorage_speed: float = 2.0
    anchorage_diameter: float = 1500.0


#: What ``wandering`` takes of a fix besides its motion, where it is given.
PLACES = {"at_dock": "boolean", "port_name": "string", "authorised": "boolean", "legal": "boolean", "area": "string"}


def wandering(fixes: DataFrame, cfg: WanderingConfig = WanderingConfig()) -> DataFrame:
    """Segments of going back and forth: enough turns, and little progress or repeated visits, where that is not normal.

    Fixes may say where they are: at_dock, port_name, authorised (an anchorage), legal (an area of lawful work), area (a monitored one). A vessel at its dock, slow in a port
    basin, drifting in an anchorage it may use, or in a lawful area is normal; with ``monitored_only`` enough fixes must lie in monitored areas. ``area`` is the commonest of a segment.
    """
    newest = fixes.groupBy("mmsi").agg(F.max("t").alias("_newest"))
    given = fixes.withColumns({c: F.lit(None).cast(kind) for c, kind in PLACES.items() if c not in fixes.columns})
    recent = given.join(newest, "mmsi").filter(F.col("t") >= F.col("_newest") - cfg.window).drop("_newest")
    key = ["mmsi", "session"]
    clean = folds.without_jumps(sequence.sessions(recent, cfg.max_gap), key, cfg.jump_metres, cfg.jump_knots)
    raw = tracks.speed_summary(clean, key).join(tracks.diameter(clean, key), key)
    raw = raw.filter((F.col("n_points") >= cfg.min_points) & (F.col("duration") >= cfg.min_seconds) & (F.col("diameter") <= cfg.max_diameter) & (F.coalesce("mean_speed", F.lit(cfg.min_speed)) >= cfg.min_speed))
    raw = raw.join(_whereabouts(clean, key), key)
    c, slow = F.col, lambda most: F.coalesce(F.col("mean_speed") <= most, F.lit(False))
    normal = c("docked") | (c("in_port") & slow(cfg.port_speed) & (c("diameter") <= cfg.port_diameter)) | (c("lawful") >= cfg.normal_share)
    normal = normal | ((c("anchorage") >= cfg.normal_share) & slow(cfg.anchorage_speed) & (c("diameter") <= cfg.anchorage_diameter))
    raw = raw.filter(~normal & ((c("monitored") >= cfg.min_area_share) if cfg.monitored_only else F.lit(True))).drop("docked", "in_port", "lawful", "anchorage", "monitored")
    track = folds.thinned(clean.join(raw.select(*key), key, "left_semi"), cfg.min_leg, key)
    facts = tracks.shape(track, key).select(*key, "path", "displacement", "directness").join(folds.turns(track, key, cfg.turn_degrees, cfg.turn_seconds, cfg.min_speed), key).join(tracks.revisits(track, key, cfg.grid), key)
    support = (F.coalesce("directness", F.lit(1.0)) <= cfg.max_directness) | (F.col("revisit_ratio") >= cfg.min_revisit)
    return raw.join(facts, key).filter((F.col("path") >= cfg.min_path) & (F.col("n_turns") >= cfg.min_turns) & support)


def _whereabouts(fixes: DataFrame, key: list[str]) -> DataFrame:
    """Of each segment: docked and in_port by its last fix, the shares of fixes in lawful areas, anchorages and monitored areas, and the commonest of these."""
    share = lambda flag: F.avg(F.when(F.coalesce(flag, F.lit(False)), 1.0).otherwise(0.0))
    last = F.max_by(F.struct(F.coalesce("at_dock", F.lit(False)).alias("d"), F.col("port_name").isNotNull().alias("p")), "t")
    facts = fixes.groupBy(*key).agg(last.alias("_l"), share(F.col("legal")).alias("lawful"), share(F.col("authorised")).alias("anchorage"), share(F.col("area").isNotNull()).alias("monitored"), F.min("t").alias("_t"))
    area = tracks.most_frequent(fixes.filter(F.col("area").isNotNull()), key, "area")
    return facts.join(area, key, "left").select(*key, F.col("_l.d").alias("docked"), F.col("_l.p").alias("in_port"), "lawful", "anchorage", "monitored", "area")


def berth_facts(latest: DataFrame) -> DataFrame:
    """near_facility, facility, authorised and legal_area of each vessel's newest fix, from what a zone join found there, by precedence.

    latest: mmsi and, null where there is none, configured_facility, legal_berth (areas that are set up by hand), port_name (the report's), port_zone. A facility set up by hand comes before
    the report's port, that before a port zone; the coast alone is no facility. A berth is lawful in a legal area, then in a named port, then in a port zone.
    """
    c = F.col
    facility = F.coalesce("configured_facility", "port_name", "port_zone")
    legal = F.coalesce("legal_berth", "port_name", "port_zone")
    return latest.withColumns({"near_facility": facility.isNotNull(), "facility": facility, "authorised": legal.isNotNull(), "legal_area": legal, "by_hand": c("configured_facility").isNotNull()})


def parking(behavior: DataFrame, latest: DataFrame, underway: DataFrame, min_seconds: float = 1800.0, max_speed: float = 0.5, max_radius: float = 50.0, legal_limit: float = 0.0) -> DataFrame:
    """Vessels berthed too long where they may not, or beyond the limit where they may (0: none), and those that sail while 'moored'.

    latest: mmsi, near_facility, authorised (``berth_facts``).
    """
    berthed = behavior.filter((F.col("behavior") == "berthing") & (F.col("points") >= 3) & (F.col("duration") >= min_seconds) & (F.col("mean_speed") <= max_speed) & (F.col("radius") <= max_radius))
    judged = berthed.join(latest.filter("near_facility").select("mmsi", "authorised"), "mmsi")
    over = F.lit(legal_limit > 0) & (F.col("duration") > legal_limit)
    stay = judged.filter(~F.col("authorised") | over).select("mmsi", F.when(F.col("authorised"), "over time").otherwise("berthed").alias("reason"))
    return stay.unionByName(underway.select("mmsi", F.lit("moored under way").alias("reason")))


@dataclass(frozen=True)
class StayConfig:
    max_speed: float = 0.5
    max_gap: float = 300.0
    max_drift: float | None = None
    min_points: int = 3
    min_seconds: float = 300.0
    max_radius: float = 250.0


def stay_in(fixes: DataFrame, behavior: DataFrame, kinds: tuple[str, ...], same: tuple[str, ...], cfg: StayConfig) -> DataFrame:
    """Vessels of some behaviours whose latest stay has the same place columns throughout: the core of illegal anchoring and staying."""
    some = fixes.join(behavior.filter(F.col("behavior").isin(*kinds) & (F.col("points") >= cfg.min_points) & (F.col("radius") <= cfg.max_radius)).select("mmsi"), "mmsi", "left_semi")
    near = None if cfg.max_drift is None else geo.haversine(F.col("lon"), F.col("lat"), F.col("latest_lon"), F.col("latest_lat")) <= cfg.max_drift
    run = sequence.tail(some, (F.col("speed") <= cfg.max_speed) & F.col(same[0]).isNotNull(), cfg.max_gap, near, same)
    found = run.groupBy("mmsi", *same).agg(F.count("*").alias("n_points"), F.min("t").alias("since"), (F.max("t") - F.min("t")).alias("duration"))
    return found.filter((F.col("n_points") >= cfg.min_points) & (F.col("duration") >= cfg.min_seconds))


def port_operation(fixes: DataFrame) -> Column:
    """Normal work of a port: in a named port (port_name) or a port zone (in_port), as far as these columns are there, and not where anchoring is forbidden."""
    there = [F.col("port_name").isNotNull()] * ("port_name" in fixes.columns) + [F.coalesce("in_port", F.lit(False))] * ("in_port" in fixes.columns)
    port = F.lit(False)
    for c in there:
        port = port | c
    return port & ~F.col("state").eqNullSafe("prohibited")


def anchoring(fixes: DataFrame, behavior: DataFrame, cfg: StayConfig = StayConfig()) -> DataFrame:
    """Anchored outside authorised areas, but for docked vessels and the normal work of a port. Fixes carry state (prohibited, authorized, covered, outside) and place."""
    busy = F.coalesce("at_dock", F.lit(False)) | port_operation(fixes)
    open_ = fixes.filter(~busy).withColumn("state", F.when(F.col("state").isin("authorized", "outside"), None).otherwise(F.col("state")))
    found = stay_in(open_, behavior, ("anchoring",), ("state", "place"), cfg)
    return found.withColumn("risk", F.when(F.col("state") == "prohibited", "high").otherwise("medium"))


def staying(fixes: DataFrame, behavior: DataFrame, cfg: StayConfig = StayConfig(max_gap=180.0, max_drift=50.0, min_seconds=1800.0, max_radius=50.0)) -> DataFrame:
    """Staying or anchored in a forbidden area (column area)."""
    return stay_in(fixes, behavior, ("staying", "anchoring"), ("area",), cfg)


@dataclass(frozen=True)
class ContactConfig:
    base: float = 100.0
    most: float = 300.0
    max_speed: float = 20.0
    max_speed_gap: float = 1.0
    course_above: float | None = 1.0
    max_course_gap: float = 30.0
    min_frames: int = 3
    min_seconds: float = 120.0
    max_gap: float = 90.0


TRANSFER = ContactConfig()
BERTHING = ContactConfig(max_speed=2.0, max_speed_gap=0.5, course_above=None, min_frames=5, min_seconds=300.0)


def _reach(left: DataFrame, right: DataFrame, cfg: ContactConfig) -> float:
    """The largest ``geo.contact_distance`` that these vessels have, so that cells are no wider than the pairs need."""
    longest = left.select("length").unionByName(right.select("length")).agg(F.max("length")).first()[0]
    return min(max(cfg.base, 0.5 * (longest or 0.0) + 25), cfg.most)


def contacts(left: DataFrame, right: DataFrame, cfg: ContactConfig, once: bool = False) -> DataFrame:
    """Pairs side by side at similar slow speed, per frame; with ``once`` only those whose first number is the smaller. Both: frame, mmsi, t, lon, lat, speed, course, length.

    What is cheap to tell comes before the distance. Spark does not count the rows that cells add, so it is told to merge rather than broadcast a side.
    """
    slow = F.col("speed").between(0, cfg.max_speed)
    left, right = left.filter(slow), right.filter(slow)
    reach = _reach(left, right, cfg)
    pairs = spatial.near_pairs(left, right.hint("merge"), reach, ("frame",), exact=False)
    ok = (F.col("mmsi") < F.col("mmsi_b") if once else F.col("mmsi") != F.col("mmsi_b")) & (F.abs(F.col("speed") - F.col("speed_b")) <= cfg.max_speed_gap)
    ok = ok & (F.abs(F.col("lat") - F.col("lat_b")) <= math.degrees(reach * 1.001 / geo.EARTH_M))
    if cfg.course_above is not None:
        loose = (F.greatest("speed", "speed_b") < cfg.course_above) | F.col("course").isNull() | F.col("course_b").isNull()
        ok = ok & (loose | (geo.angle_between(F.col("course"), F.col("course_b")) <= cfg.max_course_gap))
    ok = ok & (F.col("distance") <= geo.contact_distance(F.col("length"), F.col("length_b"), cfg.base, cfg.most))
    return pairs.filter(ok).select("frame", F.greatest("t", "t_b").alias("t"), F.col("mmsi").alias("mmsi_a"), "mmsi_b", "distance", "speed", "speed_b")


def transfer_candidates(ships: DataFrame, cfg: ContactConfig = TRANSFER) -> DataFrame:
    return contacts(ships, ships, cfg, once=True)


def by_registry(ships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The home and the foreign vessels, by the country digits of their number; what is no ship station is neither."""
    own = ships.withColumn("_registry", registry(F.col("mmsi").cast("string")))
    home, foreign = (own.filter(F.col("_registry") == side).drop("_registry") for side in ("chinese", "foreign"))
    return home, foreign


def berthing_candidates(chinese: DataFrame, foreign: DataFrame, cfg: ContactConfig = BERTHING) -> DataFrame:
    return contacts(chinese, foreign, cfg)


def confirmed_contacts(candidates: DataFrame, cfg: ContactConfig) -> DataFrame:
    """Runs of frames long enough to count, ``confirmed_at``, when they became so, and ``speed``, the higher one at the last time. Pairs are dealt once; all that follows stays in its task."""
    by = ("mmsi_a", "mmsi_b")
    dealt = candidates.select(*by, "t", F.greatest("speed", "speed_b").alias("speed")).repartition(*by)
    frames = sequence.sessions(dealt.groupBy(*by, "t").agg(F.max("speed").alias("speed")), cfg.max_gap, by)
    run = Window.partitionBy(*by, "session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grown = frames.withColumn("_long", (F.count("*").over(run) >= cfg.min_frames) & (F.col("t") - F.min("t").over(run) >= cfg.min_seconds))
    runs = grown.groupBy(*by, "session").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("observations"), F.min(F.when(F.col("_long"), F.col("t"))).alias("confirmed_at"), F.max_by("speed", "t").alias("speed"))
    return runs.filter(F.col("confirmed_at").isNotNull()).withColumn("duration", F.col("last_seen") - F.col("first_seen"))


def alert_states(runs: DataFrame, now: float, max_gap: float) -> DataFrame:
    """``state`` of confirmed contacts at a reference time: new when it was seen first at that time, recovered when the pair has not been seen for
    longer than the gap, else continuing. runs: ``confirmed_contacts``, where confirmed_at is when a run became long enough."""
    state = F.when(F.lit(now) - F.col("last_seen") > max_gap, "recovered").when(F.col("confirmed_at") == F.col("last_seen"), "new").otherwise("continuing")
    return runs.withColumn("state", state)


def berthing(chinese: DataFrame, foreign: DataFrame, permits: DataFrame, cfg: ContactConfig = BERTHING) -> DataFrame:
    """Contacts without a permit. permits: mmsi_a, mmsi_b, valid_from, valid_until (null: open)."""
    found = berthing_candidates(chinese, foreign, cfg)
    allowed = temporal.valid_at(found.select("mmsi_a", "mmsi_b", "t"), permits, ["mmsi_a", "mmsi_b"], "valid_from", "valid_until").select("mmsi_a", "mmsi_b", "t").distinct()
    return confirmed_contacts(temporal.unmatched(found, allowed, ["mmsi_a", "mmsi_b", "t"]), cfg)


def transfer(ships: DataFrame, plans: DataFrame, cfg: ContactConfig = TRANSFER, slack: float = 0.1) -> DataFrame:
    """Confirmed contacts of ship stations against registered plans (mmsi_a < mmsi_b, starts_at, ends_at, max_speed): violation by the contact's last time.

    In time the plan with the highest speed counts, otherwise the one nearest in time: 'outside time', and 'too fast' too if that plan's speed is exceeded;
    'none registered' without a plan of the pair.
    """
    found = transfer_candidates(ships.filter(ship_mmsi(F.col("mmsi").cast("string")).isNotNull()), cfg)
    dated = confirmed_contacts(found, cfg).withColumnRenamed("last_seen", "t")
    inside = F.coalesce(F.col("t").between(F.col("starts_at"), F.col("ends_at")), F.lit(False))
    off = F.when(F.col("t") < F.col("starts_at"), F.col("starts_at") - F.col("t")).otherwise(F.col("t") - F.col("ends_at"))
    joined = dated.join(plans, ["mmsi_a", "mmsi_b"], "left").withColumns({"_in": inside, "_off": off})
    best = joined.groupBy("mmsi_a", "mmsi_b", "session", "first_seen", "t", "observations", "duration", "speed").agg(
        F.max(F.when(F.col("_in"), F.col("max_speed"))).alias("_valid"), F.min_by("max_speed", F.struct("_off", "starts_at", "max_speed")).alias("_near"), F.count("max_speed").alias("_plans"),
    ).withColumn("allowed", F.coalesce("_valid", "_near"))
    fast = F.when(F.col("speed") > F.col("allowed") + slack, "too fast")
    why = F.when(F.col("_plans") == 0, "none registered").otherwise(F.concat_ws(", ", F.when(F.col("_valid").isNull(), "outside time"), fast))
    return best.withColumn("violation", why).filter("violation <> ''").drop("_plans", "_valid", "_near")


@dataclass(frozen=True)
class DraggingConfig:
    slow: float = 1.0
    fast: float = 8.0
    speed_gap: float = 1.5
    course_gap: float = 20.0
    near: float = 100.0
    far: float = 2000.0
    margin: float = 500.0
    loose: float = 1.5
    window: float = 2700.0
    tolerance: float = 45.0
    min_points: int = 30
    min_seconds: float = 1800.0
    max_std: float = 250.0


def double_dragging(fixes: DataFrame, cfg: DraggingConfig = DraggingConfig()) -> DataFrame:
    """Pairs that tow together: candidates by their latest fixes, then aligned samples of the last 45 minutes."""
    newest = sequence.latest(fixes).filter(F.col("speed").between(cfg.slow, cfg.fast))
    near = spatial.near_pairs(newest.select("mmsi", "lon", "lat", "speed", "course"), newest.select("mmsi", "lon", "lat", "speed", "course"), cfg.far + cfg.margin).filter("mmsi < mmsi_b")
    close = (F.abs(F.col("speed") - F.col("speed_b")) <= cfg.speed_gap * cfg.loose) & (geo.angle_between(F.col("course"), F.col("course_b")) <= cfg.course_gap * cfg.loose)
    pairs = near.filter(close).select(F.col("mmsi").alias("mmsi_a"), "mmsi_b")
    ref = fixes.agg(F.max("t").alias("_ref"))
    recent = fixes.crossJoin(F.broadcast(ref)).filter(F.col("t") >= F.col("_ref") - cfg.window).drop("_ref")  # one row
    on, columns = ["mmsi_a", "mmsi_b"], ("lon", "lat", "speed", "course")
    side = lambda s: pairs.join(recent.select(F.col("mmsi").alias(f"mmsi_{s}"), "t", *columns), f"mmsi_{s}")
    both = temporal.align(side("a"), side("b"), on, cfg.tolerance, columns).withColumn("t", F.greatest("t_a", "t_b"))
    f = tracks.pair_features(both, on, cfg.near, cfg.far, cfg.slow, cfg.fast, cfg.course_gap, 30.0, cfg.speed_gap)
    return f.filter(
        (F.col("n_points") >= cfg.min_points) & (F.col("duration") >= cfg.min_seconds) & F.col("both_in_speed") & (F.col("in_range") >= 0.8) & (F.col("same_course") >= 0.8)
        & (F.col("lateral") >= 0.7) & (F.col("same_speed") >= 0.8) & (F.col("std_distance") <= cfg.max_std)
    )


def smuggling_risk(state: DataFrame) -> DataFrame:
    """score (0 to 100) and risk of fixes near the shore, from the facts of their voyage.

    state: night_departure, landed, at_dock, max_gap, draught_change, mismatch, length, max_speed.
    """
    part = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    c = F.col
    # Fixed values of the score: 40 for a voyage from an origin to the shore, and what each fact adds.
    score = F.least(
        F.lit(100),
        40 + part(c("night_departure"), 15) + part(c("landed"), 20) + part(c("at_dock"), 15) + part(c("max_gap") > 180, 15)
        + part(c("draught_change") >= 0.5, 15) + part(c("mismatch"), 10) + part((c("length") <= 50) & (c("max_speed") >= 15), 10),
    )
    scored = state.withColumn("score", score)
    return scored.withColumn("risk", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 60, "medium").otherwise("low"))


@dataclass(frozen=True)
class SmugglingConfig:
    max_gap: float = 180.0
    stay_seconds: float = 60.0
    stay_fixes: int = 3
    most_hours: float = 12.0
    landing_speed: float = 1.5
    landing_seconds: float = 300.0
    landing_fixes: int = 3
    night_start: int = 20
    night_end: int = 6
    utc_offset: float = 8.0


def voyages(fixes: DataFrame, cfg: SmugglingConfig = SmugglingConfig()) -> DataFrame:
    """The fixes near the shore of voyages from an origin zone, with the facts of their voyage so far.

    fixes: mmsi, t, speed, draught, length, nav_status, at_dock, iso3, flag, origin (zone or null), near_coast, near_port. A stay in one
    origin zone, without a long gap and long enough, then the first fix outside as the departure, then fixes near the coast; a port
    call, a fix in an origin, or too many hours end a voyage. All of it is windows over one vessel's fixes.
    """
    c, w = F.col, Window.partitionBy("mmsi").orderBy("t")
    inside = c("origin").isNotNull()
    marked = fixes.withColumns({"_gap": c("t") - F.lag("t").over(w), "_was": F.lag("origin").over(w)})
    # a new stay or a new leg outside begins here
    fresh = F.when(inside, ~c("origin").eqNullSafe(c("_was")) | (c("_gap") > cfg.max_gap)).otherwise(c("_was").isNotNull() | c("_gap").isNull())
    runs = marked.withColumn("_run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))
    run = Window.partitionBy("mmsi", "_run").orderBy("t")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    staged = runs.withColumns({
        "_nth": F.row_number().over(run), "_began": F.first("t").over(upto), "_fast": F.max("speed").over(upto),
        "_draught": F.first(F.when(c("draught") > 0, c("draught")), ignorenulls=True).over(upto),
    })
    stay = F.struct(c("origin"), (c("_nth") >= cfg.stay_fixes) & (c("t") - c("_began") >= cfg.stay_seconds), c("_fast"), c("_draught"))
    before = F.last(F.when(inside, stay), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    legs = staged.withColumn("_stay", before).filter(~inside & c("_stay").isNotNull()).filter(c("_stay.col2"))
    over = (c("_nth") > 1) & (F.coalesce("near_port", F.lit(False)) | (c("t") - c("_began") > cfg.most_hours * 3600))
    near = (c("_nth") > 1) & F.coalesce("near_coast", F.lit(False))
    lands = near & ((c("speed") <= cfg.landing_speed) | F.coalesce("at_dock", F.lit(False)) | F.coalesce(c("nav_status").isin(1, 5), F.lit(False)))
    legs = legs.withColumns({
        "_over": F.max(over).over(upto), "_break": F.sum(F.when(F.coalesce(lands, F.lit(False)), 0).otherwise(1)).over(upto), "_near": near, "_lands": F.coalesce(lands, F.lit(False)),
        "max_gap": F.max(F.when(c("_nth") > 1, c("_gap"))).over(upto), "max_speed": F.greatest("_fast", "_stay._fast"),
        "draught_change": F.coalesce(F.max(F.when((c("_nth") > 1) & (c("draught") > 0), F.abs(c("draught") - c("_stay._draught")))).over(upto), F.lit(0.0)),
    })
    landing = Window.partitionBy("mmsi", "_run", "_break").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    long_enough = (c("t") - F.first(F.when(c("_lands"), c("t")), ignorenulls=True).over(landing) >= cfg.landing_seconds) & (F.sum(c("_lands").cast("int")).over(landing) >= cfg.landing_fixes)
    facts = legs.withColumn("landed", c("_lands") & F.coalesce(long_enough, F.lit(False))).filter(c("_near") & ~c("_over"))
    return facts.select(
        "mmsi", "t", c("_stay.origin").alias("origin"), c("_began").alias("departed_at"), at_night(c("_began"), cfg.utc_offset, cfg.night_start, cfg.night_end).alias("night_departure"),
        "landed", F.coalesce("at_dock", F.lit(False)).alias("at_dock"), "max_gap", "draught_change", identity_mismatch(c("mmsi"), c("iso3"), c("flag")).alias("mismatch"), "length", "max_speed",
    )


def shore_flags(fixes: DataFrame, coast: DataFrame, ports: DataFrame, key: list[str], near_coast: float = 5000.0, near_port: float = 3000.0, size: float = 0.1) -> DataFrame:
    """Fixes with near_coast, near_port and port (the nearest within reach), from coast segments and port zones (``with_ring``) instead of given flags."""
    shore = spatial.nearest_segment(fixes, coast, key, near_coast, size).select(*key, F.lit(True).alias("near_coast"))
    port = spatial.nearest_zone(fixes, ports, key, near_port, size).select(*key, F.col("zone").alias("port"))
    rest = fixes.drop("near_coast", "near_port", "port")
    return rest.join(shore, key, "left").join(port, key, "left").withColumns({"near_coast": F.coalesce("near_coast", F.lit(False)), "near_port": F.col("port").isNotNull()})


def smuggling(fixes: DataFrame, cfg: SmugglingConfig = SmugglingConfig(), permits: DataFrame | None = None) -> DataFrame:
    """One row per voyage that reached the shore: n_shore, first and last shore fix, the highest score and when it came, its risk.

    permits: permit_id, mmsi, origin, port (null: any), valid_from, valid_until. Shore fixes that a permit covers are ``n_authorized`` and count for nothing else; a voyage
    with no others is left out. The port of a fix is that of the column ``port``, if there is one.
    """
    scored = smuggling_risk(voyages(fixes, cfg))
    if permits is None:
        marked = scored.withColumn("permit_id", F.lit(None).cast("long"))
    else:
        port = fixes.groupBy("mmsi", "t").agg(F.max("port").alias("port")) if "port" in fixes.columns else None
        asked = scored.join(port, ["mmsi", "t"], "left") if port is not None else scored.withColumn("port", F.lit(None).cast("string"))
        marked = temporal.best_valid(asked, permits, ["mmsi"], ["origin", "port"], "valid_from", "valid_until", "permit_id", ["permit_id"], ["mmsi", "t"])
    open_ = F.col("permit_id").isNull()
    only = lambda c: F.when(open_, c)
    best = F.max(only(F.struct("score", (-F.col("t")).alias("t"), "risk")))
    found = marked.groupBy("mmsi", "departed_at").agg(
        F.first("origin").alias("origin"), F.count_if(open_).alias("n_shore"), F.count_if(~open_).alias("n_authorized"), F.min(only(F.col("t"))).alias("first_shore"), F.max(only(F.col("t"))).alias("last_shore"), best.alias("_b"),
    ).filter("n_shore > 0")
    return found.select("mmsi", "departed_at", "origin", "n_shore", "n_authorized", "first_shore", "last_shore", F.col("_b.score").alias("score"), (-F.col("_b.t")).alias("scored_at"), F.col("_b.risk").alias("risk"))


def overload_state(boxes: DataFrame) -> DataFrame:
    """Per camera frame: overload, normal. boxes: camera, frame, kind (vessel, load_line), class_id, confidence."""
    line = F.col("kind") == "load_line"
    agg = boxes.groupBy("camera", "frame").agg(F.count_if(line).alias("_lines"), F.count_if(line & (F.col("class_id") != 0)).alias("_over"), F.count_if(F.col("kind") == "vessel").alias("_vessels"), F.max(F.when(line & (F.col("class_id") != 0), F.col("confidence"))).alias("confidence"))
    state = F.when(F.col("_lines") == 0, F.when(F.col("_vessels") > 0, "overload").otherwise("normal")).when(F.col("_over") > 0, "overload").otherwise("normal")
    return agg.select("camera", "frame", state.alias("state"), "confidence")


def underway_eligible(fixes: DataFrame, extra: Column | None = None) -> DataFrame:
    """``eligible``: not docked, no port, not in an authorised anchorage, and a status under way or unknown."""
    c = F.col
    ok = ~F.coalesce(c("at_dock"), F.lit(False)) & c("port_name").isNull() & ~F.coalesce(c("authorised"), F.lit(False)) & (c("nav_status").isNull() | c("nav_status").isin(0, 15))
    return fixes.withColumn("eligible", ok if extra is None else ok & extra)
