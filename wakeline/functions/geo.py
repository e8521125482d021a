"""Geometry on the sphere and in local planes, as Column expressions that stay inside code generation.

Angles are degrees, distances metres. Polygons are arrays of struct(lon, lat); the closing vertex is not repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KNOT_MPS = 0.514444
METRES_PER_DEGREE = 111_320.0
PARALLEL = 1e-12  # square degrees: legs whose cross product is smaller don't cross


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2))  # no number where rounding makes a larger than 1; null if a coordinate is


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest turn between two headings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def axial_angle_between(a: Column, b: Column) -> Column:
    """Between two undirected axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def mean_course(a: Column, b: Column) -> Column:
    """Direction halfway between two courses; the first course if they are opposite."""
    x, y = F.cos(F.radians(a)) + F.cos(F.radians(b)), F.sin(F.radians(a)) + F.sin(F.radians(b))
    return F.when((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12), F.pmod(a, F.lit(360.0))).otherwise(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))


def local_offset(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north metres from an origin, equirectangular."""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M


def dead_reckon(lon: Column, lat: Column, speed_knots: Column, course: Column, seconds: Column) -> tuple[Column, Column]:
    """Position after sailing on at constant speed and course."""
    run = speed_knots * KNOT_MPS * seconds
    north, east = run * F.cos(F.radians(course)), run * F.sin(F.radians(course))
    return lon + F.degrees(east / (EARTH_M * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-9)))), lat + F.degrees(north / EARTH_M)


def closest_approach(x: Column, y: Column, vx: Column, vy: Column) -> dict[str, Column]:
    """Of relative position (m) and velocity (m/s): time to and distance at the closest point, and whether they close in."""
    speed2 = vx * vx + vy * vy
    still = speed2 < 1e-12
    tcpa = F.when(still, F.lit(0.0)).otherwise(-(x * vx + y * vy) / speed2)
    dcpa = F.when(still, F.hypot(x, y)).otherwise(F.hypot(x + vx * tcpa, y + vy * tcpa))
    return {"tcpa": tcpa, "dcpa": dcpa, "relative_speed": F.sqrt(speed2), "closing": ~still & (x * vx + y * vy < 0)}


def contact_distance(length_a: Column, length_b: Column, base: float, most: float) -> Column:
    """How close two hulls count as side by side: grows with the longer one, within base and most."""
    longest = F.greatest(F.coalesce(length_a, F.lit(0.0)), F.coalesce(length_b, F.lit(0.0)))
    return F.least(F.greatest(F.lit(base), 0.5 * longest + 25), F.lit(most))


def safety_distance(length_a: Column, length_b: Column, warning: float, buffer: float) -> Column:
    return F.greatest(F.lit(warning), (F.coalesce(length_a, F.lit(0.0)) + F.coalesce(length_b, F.lit(0.0))) / 2 + buffer)


def edges(vertices: Column) -> Column:
    """array of struct(x1, y1, x2, y2), the last edge closing the ring."""
    turned = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    return F.zip_with(vertices, turned, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))


def crosses_ray(lon: Column, lat: Column, e: Column) -> Column:
    """Whether the ray to the east of the point crosses an edge (half-open in latitude)."""
    up = (e["y1"] > lat) != (e["y2"] > lat)
    return up & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(up, e["y2"] - e["y1"]).otherwise(1.0) + e["x1"])


def on_edge(lon: Column, lat: Column, e: Column, slack: float = 1e-12) -> Column:
    cross = (lon - e["x1"]) * (e["y2"] - e["y1"]) - (lat - e["y1"]) * (e["x2"] - e["x1"])
    return (F.abs(cross) <= slack) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def in_polygon(lon: Column, lat: Column, ring: Column, boundary: bool = True) -> Column:
    """Ray casting over ``edges``; points on the boundary count as inside if ``boundary``, else as the ray decides."""
    inside = F.size(F.filter(ring, lambda e: crosses_ray(lon, lat, e))) % 2 == 1
    return (inside | F.exists(ring, lambda e: on_edge(lon, lat, e))) if boundary else inside


def segment_distance(lon: Column, lat: Column, e: Column) -> Column:
    """Point to segment in the point's tangent plane; term by term what the SQL says, as places between two zones are told apart by the last bits."""
    k, c = math.radians(1) * EARTH_M, F.cos(F.radians(lat))
    ax, ay = (e["x1"] - lon) * k * c, (e["y1"] - lat) * k
    dx, dy = (e["x2"] - e["x1"]) * k * c, (e["y2"] - e["y1"]) * k
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(length2 > 0, length2).otherwise(1.0)))).otherwise(0.0)
    x, y = ax + along * dx, ay + along * dy
    return F.sqrt(x * x + y * y)


def ring_distance(lon: Column, lat: Column, ring: Column) -> Column:
    return F.array_min(F.transform(ring, lambda e: segment_distance(lon, lat, e)))


def side_of_fence(lon: Column, lat: Column, ring: Column, tolerance: float) -> Column:
    """'inside', 'outside', or 'boundary' within the tolerance of an edge."""
    return F.when(ring_distance(lon, lat, ring) <= tolerance, "boundary").when(in_polygon(lon, lat, ring), "inside").otherwise("outside")


def crossing_places(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ring: Column) -> Column:
    """Distinct places (fraction of the way, 10 digits) where a leg crosses a ring; two or more mean it passed through."""

    def place(e: Column) -> Column:
        rx, ry, sx, sy = lon2 - lon1, lat2 - lat1, e["x2"] - e["x1"], e["y2"] - e["y1"]
        det = rx * sy - ry * sx
        safe = F.when(F.abs(det) > PARALLEL, det).otherwise(F.lit(1.0))
        t, u = ((e["x1"] - lon1) * sy - (e["y1"] - lat1) * sx) / safe, ((e["x1"] - lon1) * ry - (e["y1"] - lat1) * rx) / safe
        return F.when((F.abs(det) > PARALLEL) & t.between(0, 1) & u.between(0, 1), F.round(t, 10))

    return F.array_distinct(F.array_compact(F.transform(ring, place)))


def ring_area(ring: Column) -> Column:
    """Shoelace area in square degrees."""
    return F.abs(F.aggregate(ring, F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def bounds(vertices: Column) -> dict[str, Column]:
    lons, lats = F.transform(vertices, lambda v: v["lon"]), F.transform(vertices, lambda v: v["lat"])
    return {"min_lon": F.array_min(lons), "max_lon": F.array_max(lons), "min_lat": F.array_min(lats), "max_lat": F.array_max(lats)}


def circle(lon: Column, lat: Column, radius: Column, sides: int = 72) -> Column:
    """A great-circle circle as vertices."""
    d, phi = radius / EARTH_M, F.radians(lat)

    def vertex(i: Column) -> Column:
        a = F.radians(i * (360.0 / sides))
        y = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(a))
        x = F.radians(lon) + F.atan2(F.sin(a) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(y))
        return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), vertex)


def rectangle(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(at(min_lon, min_lat), at(max_lon, min_lat), at(max_lon, max_lat), at(min_lon, max_lat))


def in_box(lon: Column, lat: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, margin: float = 0.0) -> Column:
    """Inside a box widened by a margin in metres."""
    widen = margin / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    up = margin / METRES_PER_DEGREE
    return lon.between(min_lon - widen, max_lon + widen) & lat.between(min_lat - up, max_lat + up)


def dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + minutes / 60.0 + seconds / 3600.0


def heading_arc(headings: Column) -> Column:
    """Smallest arc that holds all headings: 360 less the largest gap between neighbours round the circle; null below two."""
    turned = F.sort_array(F.transform(F.filter(headings, lambda h: h.isNotNull()), lambda h: F.pmod(h.cast("double"), F.lit(360.0))))
    ahead = F.concat(F.slice(turned, 2, F.greatest(F.size(turned) - 1, F.lit(0))), F.transform(F.slice(turned, 1, 1), lambda h: h + 360))
    return F.when(F.size(turned) >= 2, 360 - F.array_max(F.zip_with(turned, ahead, lambda a, b: b - a)))


# Fixed values of the Krasovsky ellipsoid, which the offset of GCJ-02 is defined on.
_KRASOVSKY_A, _KRASOVSKY_EE = 6378245.0, 0.00669342162296594323


def _gcj_shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    wave = lambda v, *parts: sum((F.sin(v * (f * math.pi)) * a for a, f in parts[1:]), F.sin(v * (parts[0][1] * math.pi)) * parts[0][0]) * (2.0 / 3.0)
    common = wave(x, (20.0, 6.0), (20.0, 2.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common + wave(y, (20.0, 1.0), (40.0, 1 / 3)) + wave(y, (160.0, 1 / 12), (320.0, 1 / 30))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common + wave(x, (20.0, 1.0), (40.0, 1 / 3)) + wave(x, (150.0, 1 / 12), (300.0, 1 / 30))
    phi = F.radians(lat)
    magic = 1 - _KRASOVSKY_EE * F.sin(phi) * F.sin(phi)
    return east * 180.0 / (_KRASOVSKY_A / F.sqrt(magic) * F.cos(phi) * math.pi), north * 180.0 / (_KRASOVSKY_A * (1 - _KRASOVSKY_EE) / (magic * F.sqrt(magic)) * math.pi)


def to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 to GCJ-02 inside the offset's rectangle, unchanged outside."""
    inside = lon.between(72.004, 137.8347) & lat.between(0.8293, 55.8271)
    dx, dy = _gcj_shift(lon, lat)
    return F.when(inside, lon + dx).otherwise(lon), F.when(inside, lat + dy).otherwise(lat)


def from_gcj02(lon: Column, lat: Column, rounds: int = 5) -> tuple[Column, Column]:
    """The inverse by fixed-point rounds; five leave well under a millimetre."""

    def closer(at: Column, _: Column) -> Column:
        gx, gy = to_gcj02(at["lon"], at["lat"])
        return F.struct((at["lon"] + (lon - gx)).alias("lon"), (at["lat"] + (lat - gy)).alias("lat"))

    start = F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, closer)
    return found["lon"], found["lat"]


def _pairs(points: Column) -> Column:
    """array of struct(lon, lat) from an array of arrays; null unless each has exactly two numbers."""
    ok = F.forall(points, lambda p: F.coalesce((F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))
    return F.when(ok, F.transform(points, lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat"))))


def _numbers(rows: Column, separator: str) -> Column:
    return F.transform(rows, lambda r: F.transform(F.split(F.trim(r), separator), lambda x: F.trim(x).try_cast("double")))


def parse_ring(text: Column) -> Column:
    """Vertices of a 2-D polygon of one ring, the closing vertex dropped; null for anything else.

    Taken: WKT POLYGON, a GeoJSON Polygon, a list of pairs in brackets, or lines (or semicolons) of two numbers. Holes, several
    polygons, a third dimension and truth values as numbers are refused.
    """
    plain = F.trim(text)
    wkt = F.regexp_extract(plain, r"(?is)^POLYGON\s*\(\s*\(([^()]*)\)\s*\)$", 1)
    feature = F.from_json(plain, "type string, coordinates array<array<array<double>>>", {"allowNonNumericNumbers": "false"})
    rings = feature["coordinates"]
    listed = F.from_json(F.translate(plain, "()", "[]"), "array<array<double>>", {"allowNonNumericNumbers": "false"})
    lines = F.filter(F.split(plain, r"[;；\n]+"), lambda r: F.trim(r) != "")
    points = (
        F.when(plain.rlike("(?i)^POLYGON"), F.when(wkt != "", _pairs(_numbers(F.split(wkt, ","), r"\s+"))))
        .when(plain.startswith("{"), F.when((feature["type"] == "Polygon") & (F.size(rings) == 1), _pairs(rings[0])))
        .when(plain.rlike(r"^[\[(]"), _pairs(listed))
        .otherwise(_pairs(_numbers(lines, r"[\s,，]+")))
    )
    closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(F.size(points) > 0, F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, slack: float) -> Column:
    """1 left, -1 right, 0 straight on."""
    cross = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(F.abs(cross) <= slack, 0).when(cross > 0, 1).otherwise(-1)


def segments_meet(e: Column, f: Column) -> Column:
    """Whether two segments cross or touch, ends included."""
    turn = lambda s, x, y, slack: _turn(s["x1"], s["y1"], s["x2"], s["y2"], x, y, slack)

    def touches(s: Column, x: Column, y: Column) -> Column:
        wide = lambda a, b, v: v.between(F.least(a, b) - 1e-10, F.greatest(a, b) + 1e-10)
        return (turn(s, x, y, 1e-12) == 0) & wide(s["x1"], s["x2"], x) & wide(s["y1"], s["y2"], y)

    apart = lambda s, o: turn(s, o["x1"], o["y1"], 1e-12) != turn(s, o["x2"], o["y2"], 1e-12)
    ends = [touches(e, f["x1"], f["y1"]), touches(e, f["x2"], f["y2"]), touches(f, e["x1"], e["y1"]), touches(f, e["x2"], e["y2"])]
    return (apart(e, f) & apart(f, e)) | ends[0] | ends[1] | ends[2] | ends[3]


def ring_fault(vertices: Column, most: int = 500) -> Column:
    """Why vertices make no valid polygon, or null: number, range, repeated neighbours, width, no area, edges that cross or touch."""
    ring, n = edges(vertices), F.size(vertices)
    distinct = F.size(F.array_distinct(vertices))
    lons = F.transform(vertices, lambda v: v["lon"])
    at = lambda i: F.element_at(ring, i + 1)
    later = lambda i: F.sequence(i + 2, n - F.when(i == 0, 2).otherwise(1))  # noqa: E731  edges that share no vertex with edge i
    meets = F.exists(F.sequence(F.lit(0), n - 3), lambda i: F.when(i + 2 <= n - F.when(i == 0, 2).otherwise(1), F.exists(later(i), lambda j: segments_meet(at(i), at(j)))).otherwise(False))
    strange = lambda v: v["lon"].isNull() | v["lat"].isNull() | F.isnan(v["lon"]) | F.isnan(v["lat"]) | ~v["lon"].between(-180, 180) | ~v["lat"].between(-90, 90)
    return (
        F.when(vertices.isNull(), "too few vertices")
        .when(n > most, "too many vertices")
        .when(F.exists(vertices, strange), "out of range")
        .when((n < 3) | (distinct < 3), "too few vertices")
        .when(F.exists(ring, lambda e: (e["x1"] == e["x2"]) & (e["y1"] == e["y2"])), "repeated neighbour")
        .when(F.array_max(lons) - F.array_min(lons) > 180, "crosses the antimeridian")
        .when(ring_area(ring) <= 1e-12, "no area")
        .when(meets, "edges cross")
    )
