"""Spatial and pair joins, assignment and detectors on small scenarios."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequences import metres
from wakeline.functions.records import UNKNOWN_NAME
from wakeline.operators import behavior, events, spatial, temporal
from wakeline.plans import detectors, fusion


def square(name, x, y, half, **more):
    return {"zone": name, "vertices": [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)], **more}


def zone_frame(spark, zones):
    return spatial.with_ring(spark.createDataFrame([(z["zone"], z["vertices"]) for z in zones], "zone string, vertices array<struct<lon: double, lat: double>>"))


@pytest.mark.parametrize("lat", [0.0, 22.0, 58.0])
def test_pairs_equal_brute_force_at_any_latitude(spark, lat):
    rng = random.Random(lat)
    points = [(i, 113 + rng.uniform(0, 0.05), lat + rng.uniform(0, 0.05)) for i in range(120)]
    want = {(a[0], b[0]) for a, b in itertools.combinations(points, 2) if metres(a[1:], b[1:]) <= 600}
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    assert {(r["id"], r["id_b"]) for r in spatial.near_pairs(df, df, 600.0).filter("id < id_b").collect()} == want


def test_zone_joins(spark):
    zones = zone_frame(spark, [square("small", 113, 22, 0.01), square("large", 113, 22, 0.05), square("far", 114, 22, 0.01)])
    points = spark.createDataFrame([(1, 113.0, 22.0), (2, 113.04, 22.0), (3, 113.0501, 22.0), (4, 100.0, 0.0)], "id long, lon double, lat double")
    assert {(r["id"], r["zone"]) for r in spatial.in_zones(points, zones, 0.02).collect()} == {(1, "small"), (1, "large"), (2, "large")}
    best = {r["id"]: r["z"] for r in spatial.best_zone(points, zones, ["id"], (F.col("area"),), "z", 0.02).collect()}
    assert best == {1: "small", 2: "large", 3: None, 4: None}
    near = {r["id"]: (r["zone"], round(r["distance"])) for r in spatial.nearest_zone(points, zones, ["id"], 50.0, 0.02).collect()}
    assert near == {1: ("large", 0), 2: ("large", 0), 3: ("large", 10)}


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (1, 1), (4, 4)])
def test_least_cost_equals_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape)
        n, m = shape
        k = min(n, m)
        best = min(sum(cost[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        found = temporal.least_cost(cost)
        assert len(found) == k and sum(cost[i, j] for i, j in found) == pytest.approx(best)


def test_association_is_one_to_one(spark):
    ais = spark.createDataFrame([("a", 0, 113.0, 22.0, 10.0, 90.0), ("b", 0, 113.01, 22.0, 0.0, 0.0), ("late", -500, 113.0, 22.0, 0.0, 0.0), ("next", 60, 113.0, 22.0, 0.0, 0.0)], "target string, t long, lon double, lat double, speed double, course double")
    radar = spark.createDataFrame([(5, 1, 113.00025, 22.0), (5, 2, 113.0101, 22.0), (5, 3, 114.0, 22.0)], "frame long, plot long, lon double, lat double")
    got = fusion.associate(ais, radar, fusion.FusionConfig(max_age=60.0))
    assert {(r["plot"], r["target"]) for r in got.collect()} == {(1, "a"), (2, "b")}
    assert got.filter("target = 'a'").first()["cost"] < 0.01  # moved on for five seconds
    assert [r["plot"] for r in fusion.silent_targets(radar, got).collect()] == [3]
    assert {r["target"] for r in fusion.phantom_targets(fusion.states_at(ais, radar.select("frame"), 60.0), got).collect()} == set()


SHIP = "mmsi long, t long, lon double, lat double, speed double, course double, length double"


def test_collision_scenarios(spark):
    at = lambda m, x, course, speed=10.0, t=0: (m, t, 113 + x, 22.0, speed, course, 100.0)
    ships = [at(1, 0.0, 90.0), at(2, 0.025, 270.0), at(3, 0.5, 90.0), at(4, 0.53, 90.0), at(5, 0.8, 270.0), at(6, 0.83, 90.0), at(7, 0.01, 270.0, t=-500)]
    got = detectors.collision(spark.createDataFrame(ships, SHIP).withColumn("id", F.col("mmsi"))).collect()
    assert [(r["mmsi_a"], r["mmsi_b"], r["risk"]) for r in got] == [(1, 2, "high")]
    assert detectors.collision(spark.createDataFrame([], SHIP).withColumn("id", F.col("mmsi"))).count() == 0


@pytest.mark.parametrize("lat", [0.0, 60.0, 75.0, 89.5])
def test_near_pairs_anywhere_on_the_globe(spark, lat):
    rng = random.Random(int(lat))
    points = [(i, rng.choice([0.0, 179.99, -179.99, 37.0]) + rng.uniform(-0.02, 0.02) / max(math.cos(math.radians(lat)), 0.01), lat + rng.uniform(-0.02, 0.02)) for i in range(150)]
    points = [(i, (x + 180) % 360 - 180, y) for i, x, y in points]
    df = spark.createDataFrame(points, "k long, lon double, lat double")
    want = {(a[0], b[0]) for a in points for b in points if metres(a[1:], b[1:]) <= 800}
    got = [(r["k"], r["k_b"]) for r in spatial.near_pairs(df, df, 800.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_collision_looks_far_for_fast_vessels_only(spark):
    """Fast and slow ones meet, whichever has the larger number, also across 180 degrees."""
    rows = [(1, 0, 113.0, 22.0, 60.0, 90.0, 50.0), (2, 0, 113.2, 22.0, 0.5, 0.0, 50.0), (8, 0, 179.95, 10.0, 0.5, 0.0, 50.0), (7, 0, -179.9, 10.0, 40.0, 270.0, 50.0), (9, 0, 113.0, 22.3, 100.0, 0.0, 50.0), (10, 0, 113.0, 23.5, 3000.0, 180.0, 50.0)]
    got = detectors.collision(spark.createDataFrame(rows, SHIP).withColumn("id", F.col("mmsi"))).collect()
    assert sorted((r["mmsi_a"], r["mmsi_b"]) for r in got) == [(1, 2), (7, 8)]


def test_states_of_alerts(spark):
    runs = spark.createDataFrame([(1, 2, 90, 60), (1, 3, 90, 90), (1, 4, 10, 5)], "mmsi_a long, mmsi_b long, last_seen long, confirmed_at long")
    assert {r["mmsi_b"]: r["state"] for r in detectors.alert_states(runs, 100, 30).collect()} == {2: "continuing", 3: "new", 4: "recovered"}


def test_high_speed_bounds(spark):
    run = lambda m, speed, n, gap=60: [(m, 1000 - i * gap, 113.0, 22.0, speed, 0.0, 10.0) for i in range(n)]
    ships = run(1, 40.0, 6) + run(2, 30.0, 9) + run(3, 35.0, 5) + run(4, 31.0, 6) + run(5, 50.0, 6, 91)
    got = {r["mmsi"]: r["risk"] for r in detectors.high_speed(spark.createDataFrame(ships, SHIP)).collect()}
    assert got == {1: "high", 4: "medium"}  # 30 is no excess, four minutes are too short, 91 s is a gap


FIX = "mmsi long, t long, lon double, lat double, speed double, heading double, nav_status int, at_dock boolean, berthing_facility boolean, in_port_basin boolean"


def stay(m, n=6, speed=0.1, heading=10.0, nav=None, dock=False, facility=False, basin=False, turn=0.0, step=0.0):
    return [(m, 60 * i, 113.0 + step * i, 22.0, speed, heading + turn * i, nav, dock, facility, basin) for i in range(n)]


@pytest.mark.parametrize("rows, kind", [
    (stay(1, facility=True), "berthing"), (stay(1, basin=True, dock=True), "berthing"), (stay(1, basin=True, nav=5), "berthing"), (stay(1, nav=1), "anchoring"), (stay(1, turn=20.0), "anchoring"),
    (stay(1, facility=True, turn=20.0), "anchoring"), (stay(1), "staying"), (stay(1, n=2), "insufficient"), (stay(1, speed=5.0), "underway"), (stay(1, speed=0.8), "underway"), (stay(1, basin=True, nav=0), "staying"),
])
def test_behaviour(spark, rows, kind):
    assert behavior.classify(spark.createDataFrame(rows, FIX)).first()["behavior"] == kind


def test_fence_crossings(spark):
    fence = spark.createDataFrame([("f", "both", [(113.0, 22.0), (113.01, 22.0), (113.01, 22.01), (113.0, 22.01)])], "fence string, mode string, vertices array<struct<lon: double, lat: double>>")
    path = [112.99, 113.00001, 113.005, 113.02, 112.98]
    fixes = spark.createDataFrame([(1, i, x, 22.005) for i, x in enumerate(path)], "mmsi long, t long, lon double, lat double")
    got = sorted((r["t"], r["direction"]) for r in detectors.fence_crossings(fixes, fence).collect())
    assert got == [(2, "enter"), (3, "exit"), (4, "transit")]
    entries = detectors.fence_crossings(fixes, fence.withColumn("mode", F.lit("enter"))).collect()
    assert sorted(r["direction"] for r in entries) == ["enter", "transit"]


def test_crossings_after_time_far_away(spark):
    """A vessel leaves, sails far off and passes by later: what lies between makes no event, and a jump through the fence is a transit."""
    fence = spark.createDataFrame([("f", "both", [(113.0, 22.0), (113.01, 22.0), (113.01, 22.01), (113.0, 22.01)])], "fence string, mode string, vertices array<struct<lon: double, lat: double>>")
    path = [(113.005, 22.005), (113.02, 22.005), (114.0, 23.0), (112.9, 23.0), (112.9, 22.005), (112.95, 22.005), (113.05, 22.005), (113.05, 25.0)]
    fixes = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(path)], "mmsi long, t long, lon double, lat double")
    assert sorted((r["t"], r["direction"]) for r in detectors.fence_crossings(fixes, fence).collect()) == [(1, "exit"), (6, "transit")]


def test_transfer_and_plans(spark):
    frames = [(60 * i, m, 60 * i, 113.0 + 0.0001 * (m - 412000001), 22.0, 3.0, 90.0, 100.0) for i in range(4) for m in (412000001, 412000002)]
    ships = spark.createDataFrame(frames, "frame long, mmsi long, t long, lon double, lat double, speed double, course double, length double")
    plans = lambda rows: spark.createDataFrame([(412000000 + a, 412000000 + b, *rest) for a, b, *rest in rows], "mmsi_a long, mmsi_b long, starts_at long, ends_at long, max_speed double")
    why = lambda rows: [r["violation"] for r in detectors.transfer(ships, plans(rows)).collect()]
    assert why([]) == ["none registered"]
    assert why([(1, 2, 0, 100, 5.0)]) == ["outside time"]
    assert why([(1, 2, 0, 200, 2.0)]) == ["too fast"]
    assert why([(1, 2, 0, 200, 2.0), (1, 2, 0, 300, 5.0)]) == []
    assert why([(1, 2, 0, 100, 2.0), (1, 2, 9000, 9100, 9.0)]) == ["outside time, too fast"]  # the nearest plan's speed
    coast_station = ships.withColumn("mmsi", F.when(F.col("mmsi") == 412000002, F.lit(4120002)).otherwise(F.col("mmsi")))
    assert detectors.transfer(coast_station, plans([])).count() == 0


def test_berthing_permits(spark):
    frames = [(60 * i, m, 60 * i, 113.0 + 0.0001 * (m - 1), 22.0, 0.3, 90.0, 100.0) for i in range(6) for m in (1, 2)]
    ships = spark.createDataFrame(frames, "frame long, mmsi long, t long, lon double, lat double, speed double, course double, length double")
    home, other = ships.filter("mmsi = 1"), ships.filter("mmsi = 2")
    permits = lambda rows: spark.createDataFrame(rows, "mmsi_a long, mmsi_b long, valid_from long, valid_until long")
    assert detectors.berthing(home, other, permits([])).count() == 1
    assert detectors.berthing(home, other, permits([(1, 2, None, None)])).count() == 0
    assert detectors.berthing(home, other, permits([(1, 2, 1000, None)])).count() == 1


def test_voyage_from_origin_to_shore(spark):
    """Score and facts of a voyage; a port call ends it, a short stay starts none, and registries that differ count."""
    point = lambda m, t, origin=None, coast=False, port=False, speed=8.0, draught=5.0, iso="CHN": (m, t, speed, draught, 30.0, 0, False, iso, None, origin, coast, port)
    origin = lambda m: [point(m, 30 * i, "hk") for i in range(4)]
    noon = 4 * 3600  # UTC, so midday in the voyages' zone
    track = [(*r[:1], r[1] + noon, *r[2:]) for r in [*origin(1), point(1, 200), point(1, 300, coast=True, draught=5.6), point(1, 650, coast=True, speed=1.0), point(1, 800, coast=True, speed=1.0), point(1, 960, coast=True, speed=1.0, iso="HKG")]]
    port = [*origin(2), point(2, 200), point(2, 250, port=True), point(2, 300, coast=True)]
    short = [point(3, 0, "hk"), point(3, 300, coast=True), point(3, 400, coast=True)]
    names = "mmsi long, t long, speed double, draught double, length double, nav_status int, at_dock boolean, iso3 string, flag string, origin string, near_coast boolean, near_port boolean"
    df = spark.createDataFrame([(412000000 + r[0], *r[1:]) for r in track + port + short], names)
    got = detectors.voyages(df).orderBy("t").collect()
    assert [(r["mmsi"], r["t"] - noon, r["departed_at"] - noon, r["landed"], r["max_gap"], round(r["draught_change"], 3), r["mismatch"]) for r in got] == [
        (412000001, 300, 200, False, 100, 0.6, False), (412000001, 650, 200, False, 350, 0.6, False), (412000001, 800, 200, False, 350, 0.6, False), (412000001, 960, 200, True, 350, 0.6, True),
    ]
    best = detectors.smuggling(df).collect()
    assert [(r["n_shore"], r["score"], r["scored_at"] - noon, r["risk"]) for r in best] == [(4, 40 + 20 + 15 + 15 + 10, 960, "high")]
    night = detectors.voyages(df.withColumn("t", F.col("t") + 10 * 3600)).first()
    assert night["night_departure"] and not got[0]["night_departure"]


def test_overload_needs_three_frames(spark):
    boxes = [("c", i, "load_line", 1 if over else 0, 0.9) for i, over in enumerate([1, 1, 0, 1, 1, 1, 1])] + [("d", 0, "vessel", 0, 0.5)]
    state = detectors.overload_state(spark.createDataFrame(boxes, "camera string, frame long, kind string, class_id int, confidence double"))
    assert state.filter("camera = 'd'").first()["state"] == "overload"
    assert [(r["camera"], r["frame"]) for r in events.confirmed(state, ["camera"], "state", "frame", 3).collect()] == [("c", 5)]


def test_blacklist_name(spark):
    ships = spark.createDataFrame([("1", UNKNOWN_NAME), ("2", "B"), ("3", "C")], "mmsi string, name string")
    listed = spark.createDataFrame([("1", "listed"), ("2", "other")], "mmsi string, name string")
    assert {(r["mmsi"], r["name"]) for r in detectors.blacklist(ships, listed).collect()} == {("1", "listed"), ("2", "B")}


def test_double_dragging_finds_a_towing_pair(spark):
    rows = [(m, 60 * i + (m - 1) * 10, 113.0 + 0.0005 * i, 22.0 + 0.003 * (m - 1), 3.0, 90.0) for i in range(40) for m in (1, 2)]
    rows += [(3, 60 * i, 113.0 + 0.0005 * i, 22.5, 3.0, 90.0) for i in range(40)]
    df = spark.createDataFrame(rows, "mmsi long, t long, lon double, lat double, speed double, course double")
    assert [(r["mmsi_a"], r["mmsi_b"]) for r in detectors.double_dragging(df).collect()] == [(1, 2)]


def test_wandering_square_but_not_straight(spark):
    loop = [(0, 0), (0.003, 0), (0.003, 0.003), (0, 0.003)]
    rows = [(1, 120 * i, 113.0 + loop[i % 4][0], 22.0 + loop[i % 4][1], 5.0, [90.0, 0.0, 270.0, 180.0][i % 4]) for i in range(17)]
    rows += [(2, 120 * i, 113.0 + 0.001 * i, 22.0, 5.0, 90.0) for i in range(17)]
    df = spark.createDataFrame(rows, "mmsi long, t long, lon double, lat double, speed double, course double")
    assert [r["mmsi"] for r in detectors.wandering(df).collect()] == [1]


def test_deviation_after_route(spark):
    routes = spark.createDataFrame([(113.0 + 0.002 * i, 22.0, 90.0, 1.0) for i in range(100)], "lon double, lat double, axis double, coherence double")
    off = [0.0] * 6 + [0.02, 0.025, 0.03, 0.035]
    rows = [(1, 60 * i, 113.01 + 0.004 * i, 22.0 + dy, 10.0, 90.0, True) for i, dy in enumerate(off)] + [(2, 60 * i, 113.01 + 0.004 * i, 22.0, 10.0, 90.0, True) for i in range(10)]
    df = spark.createDataFrame(rows, "mmsi long, t long, lon double, lat double, speed double, course double, eligible boolean")
    assert [(r["mmsi"], r["risk"]) for r in detectors.deviation(df, routes).collect()] == [(1, "high")]


def test_nearest_of_lists_equals_nearest_point(spark):
    """Near and far targets, equal distances and none at all, also across 180 degrees; a point stays one row."""
    rng = random.Random(6)
    spot = lambda: ((rng.choice([179.999, 20.0, -179.999]) + rng.uniform(-0.03, 0.03) + 180) % 360 - 180, 10 + rng.uniform(-0.03, 0.03))
    points = spark.createDataFrame([(i, *spot()) for i in range(150)] + [(999, 0.0, 0.0), (1000, 50.0, 0.0)], "id long, lon double, lat double")
    targets = spark.createDataFrame([(*spot(), float(i)) for i in range(60)] + [(50.001, 0.0, 2.0), (49.999, 0.0, 1.0), (50.0, 0.001, 1.0)], "lon double, lat double, axis double")
    found = spatial.nearest_listed(points, targets, 2000.0, "m")
    assert found.count() == 152
    want = {r["id"]: (r["distance"], r["lon_b"], r["lat_b"], r["axis_b"]) for r in spatial.nearest_point(points, targets, ["id"], 2000.0).collect()}
    assert {r["id"]: tuple(r["m"]) for r in found.filter("m is not null").collect()} == want and 50 < len(want) < 152


def test_parking_anchoring_and_staying(spark):
    rows = [(m, 60 * i, 113.0, 22.0, 0.1, 10.0 + turn * i, nav, False, m == 1, False) for m, turn, nav in ((1, 0.0, None), (2, 0.0, 1), (3, 0.0, None)) for i in range(40)]
    fixes = spark.createDataFrame(rows, FIX)
    kinds = behavior.classify(fixes)
    assert {r["mmsi"]: r["behavior"] for r in kinds.collect()} == {1: "berthing", 2: "anchoring", 3: "staying"}
    latest = spark.createDataFrame([(1, True, False), (2, True, False)], "mmsi long, near_facility boolean, authorised boolean")
    assert [(r["mmsi"], r["reason"]) for r in detectors.parking(kinds, latest, fixes.limit(0)).collect()] == [(1, "berthed")]
    assert detectors.parking(kinds, latest.withColumn("authorised", F.lit(True)), fixes.limit(0)).count() == 0
    placed = fixes.withColumns({"state": F.lit("prohibited"), "place": F.lit("x"), "area": F.lit("zone")})
    assert [(r["mmsi"], r["risk"]) for r in detectors.anchoring(placed, kinds).collect()] == [(2, "high")]
    assert detectors.anchoring(placed.withColumn("state", F.lit("outside")), kinds).count() == 0
    assert sorted(r["mmsi"] for r in detectors.staying(placed, kinds).collect()) == [2, 3]


def test_contacts_equal_brute_force_and_are_not_broadcast(spark):
    """Cells are as wide as the longest vessel needs, each pair of ``once`` comes once, runs have the speed of their last time, and no side is broadcast for looking small."""
    rng = random.Random(8)
    rows = [(f, m, f, 113 + rng.uniform(0, 0.004), 22 + rng.uniform(0, 0.004), rng.uniform(0, 3), rng.choice([0.0, 90.0, None]), rng.choice([30.0, 400.0, None])) for f in (0, 60, 120) for m in range(40)]
    ships = spark.createDataFrame(rows, "frame long, mmsi long, t long, lon double, lat double, speed double, course double, length double")
    near = lambda a, b: metres(a[3:5], b[3:5]) <= min(max(100.0, 0.5 * max(a[7] or 0, b[7] or 0) + 25), 300.0) and abs(a[5] - b[5]) <= 1.0
    turn = lambda a, b: max(a[5], b[5]) < 1 or a[6] is None or b[6] is None or a[6] == b[6]
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and near(a, b) and turn(a, b))
    found = detectors.transfer_candidates(ships)
    assert sorted((r["frame"], r["mmsi_a"], r["mmsi_b"]) for r in found.collect()) == want and len(want) > 100
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    short = ships.withColumn("length", F.lit(30.0))
    assert detectors._reach(short, short, detectors.TRANSFER) == 100.0 and detectors._reach(ships, ships.limit(0), detectors.TRANSFER) == 225.0
    runs = detectors.confirmed_contacts(found, detectors.ContactConfig(min_frames=2, min_seconds=60.0))
    last = {(r["mmsi_a"], r["mmsi_b"], r["last_seen"]): r["speed"] for r in runs.collect()}
    fast = {(a, b, f): max(x[5] for x in rows if x[0] == f and x[1] in (a, b)) for a, b, f in last}
    assert last and last == fast
