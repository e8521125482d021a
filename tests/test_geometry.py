from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wakeline.functions import geo, records


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points))


SQUARE = ((0, 0), (2, 0), (2, 2), (0, 2))


def test_distances_and_bearings(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert value(spark, geo.haversine(*lit(0, 0, 1, 0))) == pytest.approx(math.radians(1) * geo.EARTH_M)
    assert value(spark, geo.haversine(*lit(0, 0, 180, 0))) == pytest.approx(math.pi * geo.EARTH_M)
    assert value(spark, geo.bearing(*lit(0, 0, 0, 1))) == pytest.approx(0)
    assert value(spark, geo.bearing(*lit(0, 0, -1, 0))) == pytest.approx(270)
    assert value(spark, geo.angle_between(F.lit(350.0), F.lit(20.0))) == 30
    assert value(spark, geo.axial_angle_between(F.lit(10.0), F.lit(190.0))) == 0
    assert value(spark, geo.mean_course(F.lit(350.0), F.lit(10.0))) % 360 == pytest.approx(0, abs=1e-9)
    assert value(spark, geo.mean_course(F.lit(90.0), F.lit(270.0))) == 90


@pytest.mark.parametrize("point, inside, open_inside", [((1, 1), True, True), ((3, 1), False, False), ((2, 1), True, False), ((0, 0), True, True), ((1, 2), True, False), ((-1, 0), False, False)])
def test_polygon_edges(spark, point, inside, open_inside):
    at = [F.lit(float(v)) for v in point]
    edges = geo.edges(ring(*SQUARE))
    assert value(spark, geo.in_polygon(*at, edges)) is inside
    assert value(spark, geo.in_polygon(*at, edges, boundary=False)) is open_inside


def test_fence_sides_and_legs(spark):
    edges = geo.edges(ring((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01)))
    side = lambda x, y: value(spark, geo.side_of_fence(F.lit(x), F.lit(y), edges, 10.0))
    assert (side(0.005, 0.005), side(0.00005, 0.005), side(0.02, 0.005)) == ("inside", "boundary", "outside")
    through = geo.crossing_places(F.lit(-0.01), F.lit(0.005), F.lit(0.02), F.lit(0.005), edges)
    corner = geo.crossing_places(F.lit(-0.01), F.lit(-0.01), F.lit(0.0), F.lit(0.0), edges)
    assert len(value(spark, through)) == 2
    assert len(value(spark, corner)) == 1  # two edges touched at one place


def test_closest_approach(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    head_on = geo.closest_approach(*lit(1000, 0, -10, 0))
    assert [value(spark, head_on[k]) for k in ("tcpa", "dcpa", "closing")] == [100, 0, True]
    still = geo.closest_approach(*lit(3, 4, 0, 0))
    assert [value(spark, still[k]) for k in ("dcpa", "closing")] == [5, False]
    assert value(spark, geo.closest_approach(*lit(1000, 0, 10, 0))["closing"]) is False


def test_coordinates_round_trip(spark):
    x, y = geo.to_gcj02(F.lit(113.7), F.lit(22.4))
    assert value(spark, geo.haversine(F.lit(113.7), F.lit(22.4), x, y)) == pytest.approx(600, abs=400)
    bx, by = geo.from_gcj02(x, y)
    assert value(spark, geo.haversine(F.lit(113.7), F.lit(22.4), bx, by)) < 0.01
    assert value(spark, geo.to_gcj02(F.lit(2.0), F.lit(48.0))[0]) == 2.0


def test_circle_and_measures(spark):
    vertices = geo.circle(F.lit(113.0), F.lit(22.0), F.lit(1000.0))
    first = value(spark, vertices)[18]
    assert value(spark, geo.haversine(F.lit(113.0), F.lit(22.0), F.lit(first["lon"]), F.lit(first["lat"]))) == pytest.approx(1000, abs=1e-3)
    assert value(spark, geo.ring_area(geo.edges(ring(*SQUARE)))) == 4
    assert value(spark, geo.bounds(ring(*SQUARE))["max_lat"]) == 2
    assert value(spark, geo.dms(F.lit(22), F.lit(30), F.lit(36))) == pytest.approx(22.51)


@pytest.mark.parametrize("headings, arc", [([350.0, 10.0], 20.0), ([0.0, 90.0, 180.0], 180.0), ([10.0], None), ([], None), ([5.0, 5.0, None], 0.0)])
def test_heading_arc(spark, headings, arc):
    df = spark.createDataFrame([(headings,)], "h array<double>")
    assert df.select(geo.heading_arc(F.col("h")).alias("v")).first()["v"] == arc


@pytest.mark.parametrize("text, n", [("POLYGON((0 0, 1 0, 1 1, 0 0))", 3), ("[[0,0],[1,0],[1,1]]", 3), ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', 3), ("nothing", None), ("1 2 3", None),
    ("0 0; 1 0; 1,1", 3), ("((0, 0), (1, 0), (1, 1))", 3), ("polygon (( 0 0,1 0,1 1,0 1,0 0 ))", 4), ("POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", None), ("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))", None),
    ("POLYGON((0 0 1, 1 0 1, 1 1 1, 0 0 1))", None), ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}', None), ('{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}', None),
    ("[[0,0],[1,0,5],[1,1]]", None), ("[[0,0],[true,0],[1,1]]", None), ("", None)])
def test_rings_from_text(spark, text, n):
    got = value(spark, geo.parse_ring(F.lit(text)))
    assert (len(got) if got else None) == n


@pytest.mark.parametrize("points, fault", [
    (SQUARE, None), (((0, 0), (1, 1)), "too few vertices"), (((0, 0), (200, 0), (1, 1)), "out of range"), (((0, 0), (0, 0), (1, 0), (1, 1)), "repeated neighbour"),
    (((0, 0), (2, 2), (2, 0), (0, 3)), "edges cross"), (((0, 0), (4, 0), (4, 4), (2, 0), (0, 4)), "edges cross"), (((0, 0), (1, 0), (100, 50), (-100, 50)), "crosses the antimeridian"), (((0, 0), (2, 2), (2, 0), (0, 2)), "no area"), (((0, 0), (1, 0), (2, 0)), "no area"), (((-170, 0), (170, 0), (0, 5)), "crosses the antimeridian"),
])
def test_ring_faults(spark, points, fault):
    assert value(spark, geo.ring_fault(ring(*points))) == fault


def test_coercion(spark):
    df = spark.createDataFrame([Row(x="1.9"), Row(x="NaN"), Row(x="inf"), Row(x="abc"), Row(x=None), Row(x=" -2.7 ")])
    assert [r[0] for r in df.select(records.finite(F.col("x"))).collect()] == [1.9, None, None, None, None, -2.7]
    assert [r[0] for r in df.select(records.whole(F.col("x"))).collect()] == [1, None, None, None, None, -2]
    flags = spark.createDataFrame([Row(x=v) for v in ("1", "Yes", "是", "no", "", None)])
    assert [r[0] for r in flags.select(records.truth(F.col("x"))).collect()] == [True, True, True, False, None, None]


def test_identity_mismatch(spark):
    rows = [("412000001", "HKG", None), ("412000001", "", "Hong Kong"), ("412000001", "CHN", "HKG"), ("477000001", None, "中国"), ("477000001", "hkg", ""), ("235000001", "CHN", ""), ("412000001", "GBR", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "m string, i string, f string")
    assert [r[0] for r in df.select(records.identity_mismatch(F.col("m"), F.col("i"), F.col("f"))).collect()] == [True, True, False, True, False, False, False, False]


def test_flags_of_missing_and_invalid_values(spark):
    rows = [("412000001", "1", "22", "5", "90", "10", "0"), ("412000001", "1", "22", None, "360", "", "-128"), ("412000001", "1", "91", "5", "1", "1", "1"), ("41", "1", "2", "5", "1", "1", "1")]
    got = records.normalise(spark.createDataFrame(rows, "mmsi string, lon string, lat string, speed string, course string, heading string, rot string")).collect()
    assert [r["quality_flags"] for r in got] == [[], ["speed_unavailable", "course_unavailable", "heading_unavailable", "rot_unavailable"]]


def test_distance_of_a_missing_point_is_missing(spark):
    assert value(spark, geo.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert value(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))) == pytest.approx(3.141592653589793 * geo.EARTH_M)


def test_identity_and_kind(spark):
    got = spark.createDataFrame([Row(m=v) for v in ("412000001", "477000001", "112000001", "41200000", None)])
    assert [r[0] for r in got.select(records.registry(F.col("m"))).collect()] == ["chinese", "foreign", None, None, None]
    assert [r[0] for r in got.select(records.valid_mmsi(F.col("m"))).collect()] == ["412000001", "477000001", "112000001", None, None]
    assert value(spark, records.pair_key(F.lit("9"), F.lit("10"))) == "10:9"
    assert value(spark, records.safe_cell(F.lit("=1+1"))) == "'=1+1"


@pytest.mark.parametrize("raw", ["1700000000", "1700000000000", "1700000000000000", "1700000000000000000", "2023-11-14 22:13:20"])
def test_event_time_units(spark, raw):
    assert value(spark, F.unix_timestamp(records.event_time(F.lit(raw)))) == 1700000000


@pytest.mark.parametrize("hour, start, end, night", [(23, 22, 5, True), (4, 22, 5, True), (5, 22, 5, False), (12, 8, 18, True), (7, 3, 3, True)])
def test_night(spark, hour, start, end, night):
    assert value(spark, records.at_night(F.lit((hour - 8) * 3600 + 86400), 8, start, end)) is night


def test_overridden_configurations():
    from wakeline.plans.config import overridden
    from wakeline.plans.detectors import WanderingConfig

    cfg = overridden(WanderingConfig(), {"min_turns": 6.0, "max_directness": 7, "min_path": -3})
    assert (cfg.min_turns, cfg.max_directness, cfg.min_path, cfg.grid) == (6, 1.0, 0.0, 200.0)
    for bad in ({"nothing": 1}, {"grid": "x"}, {"grid": float("nan")}, {"grid": True}):
        with pytest.raises(ValueError):
            overridden(WanderingConfig(), bad)
