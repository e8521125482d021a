"""Cells of several levels, legs of any length, fence versions and ties against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import sequence, spatial
from wakeline.plans import detectors

RING = "array<struct<lon: double, lat: double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_wide_zones_and_zones_beyond_180(spark):
    rng = random.Random(3)
    boxes = {"small": (113.0, 22.0, 113.01, 22.01), "wide": (100.0, 10.0, 120.0, 25.0), "ocean": (-40.0, -60.0, 140.0, 60.0), "dateline": (178.0, -5.0, 183.5, 5.0), "all": (-180.0, -90.0, 180.0, 90.0)}
    zones = spatial.with_ring(spark.createDataFrame([(k, box(*v)) for k, v in boxes.items()], f"zone string, vertices {RING}"))
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [(1000 + i, rng.choice([113.005, 113.0105, 179.5, -178.0, -176.4]), rng.choice([22.005, 0.0])) for i in range(40)]
    want = {(i, k) for i, x, y in points for k, (x0, y0, x1, y1) in boxes.items() if y0 <= y <= y1 and any(x0 <= x + d <= x1 for d in (-360, 0, 360))}
    got = spatial.in_zones(spark.createDataFrame(points, "id long, lon double, lat double"), zones, 0.02)
    assert sorted((r["id"], r["zone"]) for r in got.collect()) == sorted(want)
    spread = spatial._box_cells(zones.select("zone", *(F.col(c).alias(n) for c, n in (("min_lon", "_x0"), ("max_lon", "_x1"), ("min_lat", "_y0"), ("max_lat", "_y1")))).withColumn("_level", spatial._level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), spatial.LEVELS)))
    assert max(r["count"] for r in spread.groupBy("zone").count().collect()) <= (spatial.MOST_CELLS + 2) ** 2
    assert spatial.in_zones(spark.createDataFrame([], "id long, lon double, lat double"), zones.limit(0), 0.02).count() == 0


def test_legs_of_any_length(spark):
    """Short and long legs, glitches to (0, 0), and legs across 180 degrees: those that cut a zone's box are found, and a leg has few cells."""
    rng = random.Random(4)
    boxes = {f"z{k}": (x, y, x + w, y + w) for k, (x, y, w) in enumerate([(113.0, 22.0, 0.01), (113.2, 22.1, 0.3), (50.0, 10.0, 12.0), (-179.0, 0.0, 1.0), (178.5, 3.0, 1.0), (0.5, 0.2, 0.05)])}
    zones = spark.createDataFrame([(k, box(*v)) for k, v in boxes.items()], f"fence string, vertices {RING}")
    track = [(0, 113.0, 22.0)]
    for t in range(1, 400):
        kind = rng.random()
        x, y = track[-1][1:]
        track.append((t, 0.0, 0.0) if kind < 0.1 else (t, rng.uniform(-180, 180), rng.uniform(-60, 60)) if kind < 0.3 else (t, rng.choice([179.0, -179.5]), rng.uniform(-1, 4)) if kind < 0.5 else (t, min(180.0, x + rng.uniform(-0.02, 0.02)), y + rng.uniform(-0.02, 0.02)))
    fixes = spark.createDataFrame([(1, *p) for p in track], "mmsi long, t long, lon double, lat double")

    def cuts(a, b, bounds):  # a leg as a thousand points is too coarse: clip it by the box's four sides
        (x0, y0), (x1, y1) = a, b
        x1 += 360 if x1 - x0 < -180 else -360 if x1 - x0 > 180 else 0
        for d in (-360, 0, 360):
            low, high = 0.0, 1.0
            for p, q, lo, hi in ((x0 + d, x1 - x0, bounds[0], bounds[2]), (y0, y1 - y0, bounds[1], bounds[3])):
                if q == 0:
                    low, high = (low, high) if lo <= p <= hi else (1.0, 0.0)
                else:
                    low, high = max(low, min((lo - p) / q, (hi - p) / q)), min(high, max((lo - p) / q, (hi - p) / q))
            if low <= high:
                return True
        return False

    want = {(t, k) for (_, *a), (t, *b) in zip(track, track[1:]) for k, v in boxes.items() if cuts(a, b, v)}
    met = {(r["t"], r["fence"]) for r in spatial.legs_meeting(fixes, zones, "fence", 0.0).filter("is_end").collect()}
    assert want <= met and len(want) > 40
    legs = fixes.select("mmsi", "t", F.lit(0.0).alias("_plon"), F.lit(0.0).alias("_plat"), F.col("lon").alias("_elon"), "lat")
    most = spatial.leg_cells(legs, [14]).groupBy("t").count().agg(F.max("count")).first()[0]
    assert most <= 4 * (spatial.MOST_CELLS + 2)


def plain_crossings(track, ring, tolerance=10.0, spans=((None, None),)):
    """One vessel and one fence, version by version, as a loop over its fixes; sides by Spark's geometry."""
    out = []
    for version, (since, until) in enumerate(spans):
        before = None  # stable side
        first = True
        for t, side in track[version]:
            if (since is not None and t < since) or (until is not None and t >= until):
                continue
            if first:
                first, on_line = False, side == "boundary"
                before = None if on_line else side
                continue
            if side == "boundary":
                continue
            if before is None:
                out.append((t, version, "enter" if side == "inside" else "exit"))
            elif before != side:
                out.append((t, version, "enter" if side == "inside" else "exit"))
            before = side
    return sorted(out)


def test_first_fix_on_the_line(spark):
    fence = spark.createDataFrame([("f", "both", box(113.0, 22.0, 113.01, 22.01))], f"fence string, mode string, vertices {RING}")
    for path, want in (
        ([113.0, 113.005, 113.02], [(1, "enter"), (2, "exit")]), ([113.0, 112.98, 113.005], [(1, "exit"), (2, "enter")]), ([113.0, 113.0, 113.005], [(2, "enter")]), ([113.0, 113.0, 112.9], [(2, "exit")]),
        ([113.005, 113.0, 113.005], []), ([112.9, 113.0, 112.9], []), ([113.0], []),
    ):
        fixes = spark.createDataFrame([(1, i, x, 22.005) for i, x in enumerate(path)], "mmsi long, t long, lon double, lat double")
        assert sorted((r["t"], r["direction"]) for r in detectors.fence_crossings(fixes, fence).collect()) == want, path


def test_versions_of_a_fence(spark):
    """Another geometry begins anew, another name or mode does not."""
    rng = random.Random(5)
    small, large = box(113.0, 22.0, 113.01, 22.01), box(113.0, 22.0, 113.03, 22.01)
    history = [("f", 0, "both", "old name", small), ("f", 50, "both", "new name", small), ("f", 100, "both", "new name", large), ("f", 200, "both", "new name", small)]
    versions = detectors.fence_versions(spark.createDataFrame(history, f"fence string, t long, mode string, name string, vertices {RING}"))
    assert sorted((r["version"], r["from_t"], r["until_t"]) for r in versions.collect()) == [(0, None, 100), (1, 100, 200), (2, 200, None)]
    track = [(t, rng.choice([112.99, 113.0, 113.005, 113.02, 113.03, 113.2])) for t in range(0, 300, 3)]
    fixes = spark.createDataFrame([(1, t, x, 22.005) for t, x in track], "mmsi long, t long, lon double, lat double")
    rows = spark.createDataFrame([(t, x) for t, x in track], "t long, x double")
    sides = []
    for ring in (small, large, small):
        e = geo.edges(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring)))
        sides.append([(r["t"], r["s"]) for r in rows.select("t", geo.side_of_fence(F.col("x"), F.lit(22.005), e, 10.0).alias("s")).orderBy("t").collect()])
    got = detectors.fence_crossings(fixes, versions).filter("direction <> 'transit'")
    want = plain_crossings(sides, None, spans=((None, 100), (100, 200), (200, None)))
    assert sorted((r["t"], r["version"], r["direction"]) for r in got.collect()) == want and len(want) > 20


def test_crossing_beyond_180_degrees(spark):
    fence = spark.createDataFrame([("f", "both", box(179.5, 0.0, 180.5, 1.0))], f"fence string, mode string, vertices {RING}")
    path = [178.0, 179.9, -179.8, -179.0, 179.0]
    fixes = spark.createDataFrame([(1, i, x, 0.5) for i, x in enumerate(path)], "mmsi long, t long, lon double, lat double")
    assert sorted((r["t"], r["direction"]) for r in detectors.fence_crossings(fixes, fence).collect()) == [(1, "enter"), (3, "exit"), (4, "transit")]


@pytest.mark.parametrize("flip", [False, True])
def test_first_of_equal_times(spark, flip):
    """Two reports of one time: the first to come counts, in whatever order the rows lie."""
    toward, away = (1, 100, 113.0, 22.0, 10.0, 90.0, 50.0, 1), (1, 100, 113.0, 22.0, 10.0, 270.0, 50.0, 2)
    other = (2, 100, 113.02, 22.0, 10.0, 270.0, 50.0, 3)
    names = "mmsi long, t long, lon double, lat double, speed double, course double, length double, id long"
    rows = [toward, away, other][:: -1 if flip else 1]
    assert detectors.collision(spark.createDataFrame(rows, names)).count() == 1
    swapped = [(*r[:-1], {1: 2, 2: 1}.get(r[-1], r[-1])) for r in rows]
    assert detectors.collision(spark.createDataFrame(swapped, names)).count() == 0
    with pytest.raises(ValueError):
        sequence.latest(spark.createDataFrame(rows, names), last_wins=False)


def test_a_place_between_two_zones_and_zones_at_the_edge_of_the_radius(spark):
    """Fix 84700 of sf0.1 lies as far from one zone as from the other but for the last bits, which decide as in the SQL; up to the very radius a zone is found."""
    hexagon = lambda k: [((113500000 + k * 40000 + 500 + (15000 + k * 400) / 2 * i) / 1e6, (22000500 + (300 + k % 7 * 60) * j) / 1e6) for i, j in ((-2, 0), (-1, 1), (1, 1), (2, 0), (1, -1), (-1, -1))]
    zones = spatial.with_ring(spark.createDataFrame([(f"NATION_{k}", hexagon(k)) for k in (11, 12)], f"zone string, vertices {RING}"))
    lon, lat = (113500000 + 1446 % 100 * 10000 + 84700 * 7919 % 1000) / 1e6, (22000000 + 84700 * 104729 % 1000) / 1e6
    got = spatial.nearest_zone(spark.createDataFrame([(84700, lon, lat)], "id long, lon double, lat double"), zones, ["id"], 300.0, 0.02).first()
    assert (got["zone"], round(got["distance"], 3)) == ("NATION_12", 46.853)
    flat = spatial.with_ring(spark.createDataFrame([("low", box(113.0, 22.0, 113.01, 22.01)), ("high", box(10.0, 86.0, 10.01, 86.001))], f"zone string, vertices {RING}"))
    up = 299.9 / (math.radians(1) * geo.EARTH_M)
    beside = spark.createDataFrame([(1, 113.005, 22.01 + up), (2, 113.01 + up / math.cos(math.radians(22.005)), 22.005), (3, 10.01 + up / math.cos(math.radians(86.0005)), 86.0005)], "id long, lon double, lat double")
    assert {r["id"]: round(r["distance"], 1) for r in spatial.nearest_zone(beside, flat, ["id"], 300.0, 0.02).collect()} == {1: 299.9, 2: 299.9, 3: 299.9}
