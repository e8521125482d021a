"""Queries on places: zones, fences, routes and nearby vessels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial, temporal
from . import detectors
from .catalogue import query
from .tables import CROSSES_SQL, FIXES_SQL, INSIDE_SQL, ON_EDGE_SQL, WALK_SQL, ZONES_SQL, R, distance_sql, fixes, read, rounded, walk, zones

CELL = 0.02
_BOTH = f"{FIXES_SQL}, {ZONES_SQL}"


@query(f"WITH {_BOTH} SELECT id, zone FROM {INSIDE_SQL}")
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_zones(fixes(spark, sf_dir), zones(spark, sf_dir), CELL).select("id", "zone")


_AREA_SQL = "areas AS (SELECT zone, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY zone)"


@query(f"""WITH {_BOTH}, {_AREA_SQL}, h AS (SELECT i.id, i.zone, row_number() OVER (PARTITION BY i.id ORDER BY round(a.area * 1e9), i.zone) AS nth
  FROM {INSIDE_SQL} i JOIN areas a USING (zone))
SELECT f.id, h.zone AS smallest FROM fixes f LEFT JOIN h ON h.id = f.id AND h.nth = 1""")
def zone_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containing zone of the smallest area, ties by name."""
    f = fixes(spark, sf_dir).select("id", "lon", "lat")
    return spatial.best_zone(f, zones(spark, sf_dir), ["id"], (F.round(F.col("area") * 1e9), F.col("zone")), "smallest", CELL).select("id", "smallest")


@query(f"WITH {_BOTH}, h AS {INSIDE_SQL} SELECT f.id, (SELECT arg_max(h.zone, h.kind * 100 - h.rank) FROM h WHERE h.id = f.id) AS ruled FROM fixes f")
def zone_speed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containing zone of the highest limit (its kind stands for it); of equal ones the first."""
    return spatial.best_zone(fixes(spark, sf_dir).select("id", "lon", "lat"), zones(spark, sf_dir), ["id"], (-F.col("kind"), F.col("rank")), "ruled", CELL).select("id", "ruled")


@query(f"""WITH {_BOTH}, h AS {INSIDE_SQL} SELECT f.id, CASE WHEN bool_or(h.kind = 0) THEN 'prohibited' WHEN bool_or(h.kind IN (1, 2)) THEN 'authorized'
  WHEN bool_or(h.kind IS NOT NULL) THEN 'covered' ELSE 'outside' END AS state
FROM fixes f LEFT JOIN h ON h.id = f.id GROUP BY f.id""")
def zone_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).select("id", "lon", "lat")
    kinds = spatial.in_zones(f, zones(spark, sf_dir), CELL).groupBy("id").agg(F.max(F.col("kind") == 0).alias("p"), F.max(F.col("kind").isin(1, 2)).alias("a"), F.lit(True).alias("c"))
    state = F.when(F.col("p"), "prohibited").when(F.col("a"), "authorized").when(F.col("c"), "covered").otherwise("outside")
    return f.join(kinds, "id", "left").select("id", state.alias("state"))


_SEGMENT_DISTANCE_SQL = """(SELECT p.id, e.zone, sqrt(pow(ax + k * dx, 2) + pow(ay + k * dy, 2)) AS d FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0,
  least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS k FROM
  (SELECT p.id, e.zone, (e.x1 - p.lon) * 111194.92664455874 * cos(radians(p.lat)) AS ax, (e.y1 - p.lat) * 111194.92664455874 AS ay,
  (e.x2 - e.x1) * 111194.92664455874 * cos(radians(p.lat)) AS dx, (e.y2 - e.y1) * 111194.92664455874 AS dy
   FROM fixes p CROSS JOIN edges e)) q)""".replace("SELECT p.id, e.zone, sqrt", "SELECT q.id, q.zone, sqrt")


@query(f"WITH {_BOTH} SELECT id, round(min(d), 3) AS distance FROM {_SEGMENT_DISTANCE_SQL} GROUP BY id HAVING min(d) <= 300")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = zones(spark, sf_dir).select(F.explode("ring").alias("e")).select("e.*")
    return spatial.nearest_segment(fixes(spark, sf_dir), segments, ["id"], 300.0, CELL).withColumn("distance", F.round("distance", 3))


@query(f"""WITH {_BOTH}, h AS {INSIDE_SQL}, d AS (SELECT s.id, s.zone, CASE WHEN any_value(h.zone) IS NULL THEN min(s.d) ELSE 0e0 END AS d
  FROM {_SEGMENT_DISTANCE_SQL} s LEFT JOIN h ON h.id = s.id AND h.zone = s.zone GROUP BY s.id, s.zone)
SELECT id, zone, round(d, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, zone) AS rn FROM d WHERE d <= 300)
  WHERE rn = 1""")
def nearest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_zone(fixes(spark, sf_dir), zones(spark, sf_dir), ["id"], 300.0, CELL).withColumn("distance", F.round("distance", 3))


@query(f"WITH {ZONES_SQL} SELECT kind, count(DISTINCT zone) AS n FROM edges GROUP BY kind")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT n_nationkey AS k, n_name AS name FROM nation), c AS (SELECT n_nationkey * 2 AS k, 'changed ' || n_name AS name,
  n_nationkey % 3 <> 0 AS is_active FROM nation)
SELECT coalesce(c.k, b.k) AS k, CASE WHEN c.k IS NOT NULL THEN c.name ELSE b.name END AS name FROM b FULL JOIN c ON b.k = c.k WHERE c.k IS NULL
  OR c.is_active""")
def zone_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    changes = n.select((F.col("n_nationkey") * 2).alias("k"), F.concat(F.lit("changed "), "n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    return spatial.override(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), changes, "k")


def _fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).select(F.col("zone").alias("fence"), F.when(F.col("rank") % 2 == 0, "both").otherwise("enter").alias("mode"), "vertices")


# Pairs of a fix and a fence: those where a leg that ends or begins at the fix has a box that meets the fence's, a little widened.
_MOVES_SQL = """box AS (SELECT zone, any_value(rank) AS rank, min(x1) - 0.0002e0 AS bx0, max(x1) + 0.0002e0 AS bx1, min(y1) - 0.0002e0 AS by0,
  max(y1) + 0.0002e0 AS by1 FROM edges GROUP BY zone),
legs AS MATERIALIZED (SELECT mmsi, t, id, lon, lat, row_number() OVER w AS nth, coalesce(lag(lon) OVER w, lon) AS plon, coalesce(lag(lat) OVER w, lat) AS plat,
  coalesce(lead(lon) OVER w, lon) AS nlon, coalesce(lead(lat) OVER w, lat) AS nlat FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
near AS MATERIALIZED (SELECT l.*, b.zone, b.rank FROM legs l JOIN box b ON (least(lon, plon) <= bx1 AND greatest(lon, plon) >= bx0 AND least(lat, plat) <= by1
  AND greatest(lat, plat) >= by0) OR (least(lon, nlon) <= bx1 AND greatest(lon, nlon) >= bx0 AND least(lat, nlat) <= by1 AND greatest(lat, nlat) >= by0)),
parts AS (SELECT p.mmsi, p.t, p.zone, p.rank, p.nth, p.lon, p.lat, CASE WHEN {crosses} THEN 1 ELSE 0 END AS hit, {on_edge} AS edge,
  (e.x1 - p.lon) * 111194.92664455874 * cos(radians(p.lat)) AS ax, (e.y1 - p.lat) * 111194.92664455874 AS ay,
  (e.x2 - e.x1) * 111194.92664455874 * cos(radians(p.lat)) AS dx, (e.y2 - e.y1) * 111194.92664455874 AS dy FROM near p JOIN edges e ON e.zone = p.zone),
sides AS MATERIALIZED (SELECT mmsi, t, zone, any_value(rank) AS rank, any_value(nth) AS nth, any_value(lon) AS lon, any_value(lat) AS lat,
  CASE WHEN min(sqrt(pow(ax + k * dx, 2) + pow(ay + k * dy, 2))) <= 10 THEN 'boundary' WHEN sum(hit) % 2 = 1 OR bool_or(edge) THEN 'inside' ELSE 'outside' END AS side
  FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS k FROM parts)
  GROUP BY mmsi, t, zone),
held AS (SELECT *, count(*) FILTER (side <> 'boundary') OVER w AS n_stable, first_value(side = 'boundary' AND nth = 1) OVER x AS on_line FROM sides
  WINDOW w AS (PARTITION BY mmsi, zone ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x AS (PARTITION BY mmsi, zone ORDER BY t)),
moves AS (SELECT h.*, b.lon AS plon, b.lat AS plat, coalesce(b.side, CASE WHEN h.on_line THEN CASE WHEN h.side = 'inside' THEN 'outside' ELSE 'inside' END END) AS was
  FROM held h LEFT JOIN (SELECT *, n_stable + 1 AS place FROM held WHERE side <> 'boundary') b ON b.mmsi = h.mmsi AND b.zone = h.zone AND b.place = h.n_stable)""".format(crosses=CROSSES_SQL, on_edge=ON_EDGE_SQL)
_LEG_SQL = """cuts AS (SELECT mmsi, t, zone, count(DISTINCT round(tt, 10)) AS n FROM (SELECT m.mmsi, m.t, m.zone, rx * sy - ry * sx AS det,
  ((e.x1 - plon) * sy - (e.y1 - plat) * sx) / nullif(rx * sy - ry * sx, 0) AS tt,
  ((e.x1 - plon) * ry - (e.y1 - plat) * rx) / nullif(rx * sy - ry * sx, 0) AS uu
  FROM (SELECT *, lon - plon AS rx, lat - plat AS ry FROM moves WHERE was = 'outside' AND side = 'outside') m JOIN (SELECT *, x2 - x1 AS sx,
  y2 - y1 AS sy FROM edges) e ON e.zone = m.zone) m WHERE abs(det) > 1e-12 AND tt BETWEEN 0 AND 1 AND uu BETWEEN 0 AND 1 GROUP BY mmsi, t, zone)"""


@query(f"""WITH {WALK_SQL}, {ZONES_SQL}, {_MOVES_SQL}, {_LEG_SQL},
e AS (SELECT m.mmsi, m.t, m.zone AS fence, CASE WHEN side = 'inside' AND was = 'outside' THEN 'enter' WHEN side = 'outside'
  AND was = 'inside' THEN 'exit' WHEN side = 'outside' AND was = 'outside' AND c.n >= 2 THEN 'transit' END AS direction,
  CASE WHEN rank % 2 = 0 THEN 'both' ELSE 'enter' END AS mode FROM moves m LEFT
  JOIN cuts c ON c.mmsi = m.mmsi AND c.t = m.t AND c.zone = m.zone)
SELECT mmsi, t, fence, direction FROM e WHERE direction IS NOT NULL AND (direction = 'transit' OR mode = 'both' OR mode = direction)""")
def fence_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.fence_crossings(walk(spark, sf_dir), _fences(spark, sf_dir))


@query(f"""WITH {FIXES_SQL}, g AS (SELECT CAST(floor(lon / 0.0002e0) AS BIGINT) AS cell_x, CAST(floor(lat / 0.0002e0) AS BIGINT) AS cell_y, * FROM fixes)
SELECT cell_x, cell_y, count(*) AS n, {R.format("avg(lon)")} AS lon, {R.format("avg(lat)")} AS lat,
  round(((degrees(atan2(sum(sin(radians(course * 2))), sum(cos(radians(course * 2))))) / 2 + 360) % 180) + 3.1e-8, 4) AS axis,
  {R.format("sqrt(pow(sum(sin(radians(course * 2))), 2) + pow(sum(cos(radians(course * 2))), 2)) / count(course)")} AS coherence FROM g
  GROUP BY cell_x, cell_y HAVING count(*) >= 3""")
def route_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spatial.route_grid(fixes(spark, sf_dir), 0.0002, 3)
    return g.select("cell_x", "cell_y", "n", rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"), F.round(F.col("axis") + 3.1e-8, 4).alias("axis"), rounded(F.col("coherence")).alias("coherence"))


@query(f"""WITH {WALK_SQL}, r AS (SELECT n_nationkey AS k, 113500000 / 1e6 + CAST(n_nationkey AS DOUBLE) * 1500 / 1e6 AS lon,
  22000000 / 1e6 + CAST(n_nationkey % 5 AS DOUBLE) * 3000 / 1e6 AS lat FROM nation)
SELECT id, round(d, 3) AS distance FROM (SELECT f.id, min({distance_sql("f", "r")}) AS d FROM fixes f CROSS JOIN r GROUP BY f.id) WHERE d <= 400""")
def route_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    points = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.lit(113500000) / 1e6 + k * 1500 / 1e6).alias("lon"), (F.lit(22000000) / 1e6 + (F.col("n_nationkey") % 5).cast("double") * 3000 / 1e6).alias("lat"))
    return spatial.nearest_point(walk(spark, sf_dir).select("id", "lon", "lat"), points, ["id"], 400.0).select("id", F.round("distance", 3).alias("distance"))


@query(f"""WITH {WALK_SQL}, r AS (SELECT n_nationkey AS k, 113500000 / 1e6 + CAST(n_nationkey AS DOUBLE) * n_nationkey * 4000 / 1e6 AS lon,
  22000000 / 1e6 + CAST(n_nationkey % 5 AS DOUBLE) * 90000 / 1e6 AS lat FROM nation WHERE n_nationkey > 2)
SELECT id, round(d, 3) AS distance FROM (SELECT f.id, min({distance_sql("f", "r")}) AS d FROM fixes f CROSS JOIN r GROUP BY f.id)""")
def nearest_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance to the nearest of some far points, without a radius."""
    k = F.col("n_nationkey").cast("double")
    points = read(spark, sf_dir, "nation").filter("n_nationkey > 2").select(F.col("n_nationkey").alias("k"), (F.lit(113500000) / 1e6 + k * F.col("n_nationkey") * 4000 / 1e6).alias("lon"), (F.lit(22000000) / 1e6 + (F.col("n_nationkey") % 5).cast("double") * 90000 / 1e6).alias("lat"))
    return spatial.nearest_anywhere(walk(spark, sf_dir).select("id", "lon", "lat"), points, ["id"], 500.0).select("id", F.round("distance", 3).alias("distance"))


_CPA_SQL = f"""l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, id) AS rn FROM fixes) WHERE rn = 1), s AS (SELECT * FROM l WHERE
  (SELECT max(t) FROM l) - t <= 1200),
p AS (SELECT mmsi, length, lon + degrees(run * sin(radians(course)) / (6371000e0 * greatest(abs(cos(radians(lat))), 1e-9))) AS lon,
  lat + degrees(run * cos(radians(course)) / 6371000e0) AS lat, speed * 0.514444e0 * sin(radians(course)) AS vx,
  speed * 0.514444e0 * cos(radians(course)) AS vy
  FROM (SELECT *, speed * 0.514444e0 * ((SELECT max(t) FROM s) - t) AS run FROM s)),
q AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, radians(b.lon - a.lon) * 6371000e0 * cos(radians((a.lat + b.lat) / 2)) AS x,
  radians(b.lat - a.lat) * 6371000e0 AS y, b.vx - a.vx AS vx, b.vy - a.vy AS vy, greatest(300e0, (a.length + b.length) / 2 + 50) AS safety FROM p a
  JOIN p b ON a.mmsi < b.mmsi),
c AS (SELECT *, vx * vx + vy * vy AS v2, -(x * vx + y * vy) / nullif(vx * vx + vy * vy, 0) AS tcpa FROM q), d AS (SELECT *, sqrt(pow(x + vx * tcpa,
  2) + pow(y + vy * tcpa, 2)) AS dcpa FROM c WHERE v2 >= 1e-12 AND x * vx + y * vy < 0)"""


@query(f"""WITH {WALK_SQL}, {_CPA_SQL} SELECT mmsi_a, mmsi_b, round(tcpa, 3) AS tcpa, round(dcpa, 3) AS dcpa, CASE WHEN (tcpa <= 300 AND dcpa <= 150)
  OR sqrt(x * x + y * y) <= 100 THEN 'high' ELSE 'medium' END AS risk
FROM d WHERE tcpa BETWEEN 0 AND 900 AND sqrt(v2) >= 0.2 AND dcpa <= safety""")
def collision_cpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third vessel repeats its newest report, a little later by id and on another course, which must not count."""
    w = walk(spark, sf_dir)
    again = w.filter("mmsi % 3 = 0").withColumns({"id": F.col("id") + 100_000_000, "course": F.pmod(F.col("course") + 180, F.lit(360.0))})
    found = detectors.collision(w.unionByName(again), detectors.CollisionConfig(max_age=1200.0))
    return found.select("mmsi_a", "mmsi_b", F.round("tcpa", 3).alias("tcpa"), F.round("dcpa", 3).alias("dcpa"), "risk")


def _framed(df: DataFrame) -> DataFrame:
    return df.select(F.col("t").alias("frame"), "mmsi", "t", "lon", "lat", "speed", "course", "length")


_TURN_SQL = "least((abs(a.course - b.course)) % 360, 360 - (abs(a.course - b.course)) % 360)"


@query(f"""WITH {WALK_SQL} SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.t, round({distance_sql("a", "b")}, 3) AS distance FROM fixes a JOIN fixes b ON a.t = b.t
  AND a.mmsi < b.mmsi
WHERE a.speed <= 20 AND b.speed <= 20 AND abs(a.speed - b.speed) <= 1 AND (greatest(a.speed, b.speed) < 1 OR {_TURN_SQL} <= 30)
  AND {distance_sql("a", "b")} <= least(greatest(100e0, 0.5e0 * greatest(a.length, b.length) + 25), 300e0)""")
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.transfer_candidates(_framed(walk(spark, sf_dir))).select("mmsi_a", "mmsi_b", "t", F.round("distance", 3).alias("distance"))


_BERTH_SQL = f"""berths AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.t, {distance_sql("a", "b")} AS distance FROM fixes a JOIN fixes b ON a.t = b.t
  AND a.mmsi % 2 = 0 AND b.mmsi % 2 = 1
WHERE a.speed <= 2 AND b.speed <= 2 AND abs(a.speed - b.speed) <= 0.5e0 AND {distance_sql("a", "b")} <= least(greatest(100e0,
  0.5e0 * greatest(a.length, b.length) + 25), 300e0))"""


_ABROAD = 477_000_000 - 412_000_000


def _flagged(df: DataFrame) -> DataFrame:
    """Vessels of odd numbers get those of another country."""
    return _framed(df.withColumn("mmsi", F.col("mmsi") + F.col("mmsi") % 2 * _ABROAD))


def _berths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.berthing_candidates(*detectors.by_registry(_flagged(walk(spark, sf_dir))))
    return found.withColumn("mmsi_b", F.col("mmsi_b") - _ABROAD)


@query(f"WITH {WALK_SQL}, {_BERTH_SQL} SELECT mmsi_a, mmsi_b, t, round(distance, 3) AS distance FROM berths")
def berthing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _berths(spark, sf_dir).select("mmsi_a", "mmsi_b", "t", F.round("distance", 3).alias("distance"))


@query(f"""WITH {WALK_SQL}, {_BERTH_SQL} SELECT mmsi_a, mmsi_b, t FROM berths b WHERE NOT EXISTS (SELECT 1 FROM supplier s
  WHERE 412000000 + s_suppkey * 2 = mmsi_a AND (s_suppkey % 3 = 0 OR t >= 1200) AND (s_suppkey % 3 = 1 OR t <= 3000))""")
def permit_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    permits = read(spark, sf_dir, "supplier").select((F.lit(412000000) + k * 2).cast("long").alias("mmsi_a"), F.when(k % 3 != 0, 1200).alias("valid_from"), F.when(k % 3 != 1, 3000).alias("valid_until"))
    found = _berths(spark, sf_dir).select("mmsi_a", "mmsi_b", "t")
    allowed = temporal.valid_at(found, permits, ["mmsi_a"], "valid_from", "valid_until").select("mmsi_a", "mmsi_b", "t").distinct()
    return temporal.unmatched(found, allowed, ["mmsi_a", "mmsi_b", "t"])


@query(f"""WITH {WALK_SQL}, {_BERTH_SQL}, d AS (SELECT DISTINCT mmsi_a, mmsi_b, t FROM berths), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi_a,
  mmsi_b ORDER BY t) > 90 THEN 1 ELSE 0 END AS b FROM d), s AS (SELECT *, sum(b) OVER (PARTITION BY mmsi_a, mmsi_b
  ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT mmsi_a, mmsi_b, min(t) AS first_seen, max(t) AS last_seen, count(*) AS observations FROM s GROUP BY mmsi_a, mmsi_b, k HAVING count(*) >= 2
  AND max(t) - min(t) >= 60""")
def berthing_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = detectors.ContactConfig(max_speed=2.0, max_speed_gap=0.5, course_above=None, min_frames=2, min_seconds=60.0)
    return detectors.confirmed_contacts(_berths(spark, sf_dir), cfg).select("mmsi_a", "mmsi_b", "first_seen", "last_seen", "observations")


_PLANS_SQL = "plans AS (SELECT CAST(412000000 + s_suppkey AS BIGINT) AS mmsi_a, CAST(412000000 + s_suppkey + 7 * (s_suppkey % 9) AS BIGINT) AS mmsi_b, s_suppkey % 5 * 300 AS starts_at, s_suppkey % 5 * 300 + 3000 AS ends_at, CAST(s_suppkey % 4 AS DOUBLE) / 2 AS max_speed FROM supplier WHERE s_suppkey % 9 > 0)"
_TRANSFERS_SQL = f"""found AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.t, greatest(a.speed, b.speed) AS speed FROM fixes a JOIN fixes b ON a.t = b.t
  AND a.mmsi < b.mmsi
  WHERE a.speed <= 20 AND b.speed <= 20 AND abs(a.speed - b.speed) <= 1 AND {distance_sql("a", "b")} <= least(greatest(100e0,
  0.5e0 * greatest(a.length, b.length) + 25), 300e0)),
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY t) > 90 THEN 1 ELSE 0 END AS g FROM found),
numbered_runs AS (SELECT *, sum(g) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM gaps),
runs AS (SELECT mmsi_a, mmsi_b, k, min(t) AS first_seen, max(t) AS t, count(*) AS observations, arg_max(speed, t) AS speed FROM numbered_runs
  GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(t) - min(t) >= 60)"""


@query(f"""WITH {WALK_SQL}, {_PLANS_SQL}, {_TRANSFERS_SQL},
j AS (SELECT r.mmsi_a, r.mmsi_b, r.first_seen, r.t, any_value(r.observations) AS observations, any_value(r.speed) AS speed, count(p.max_speed) AS n,
  max(CASE WHEN r.t BETWEEN p.starts_at AND p.ends_at THEN p.max_speed END) AS valid, arg_min(p.max_speed, CASE WHEN r.t < p.starts_at THEN p.starts_at - r.t ELSE r.t - p.ends_at END) AS near
  FROM runs r LEFT JOIN plans p ON p.mmsi_a = r.mmsi_a AND p.mmsi_b = r.mmsi_b GROUP BY 1, 2, 3, 4)
SELECT mmsi_a, mmsi_b, first_seen, t AS last_seen, observations, violation FROM (SELECT *, CASE WHEN n = 0 THEN 'none registered' ELSE concat_ws(', ',
  CASE WHEN valid IS NULL THEN 'outside time' END, CASE WHEN speed > coalesce(valid, near) + 0.1e0 THEN 'too fast' END) END AS violation FROM j) WHERE violation <> ''""")
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts at sea against registered plans."""
    k = F.col("s_suppkey")
    plans = read(spark, sf_dir, "supplier").filter(k % 9 > 0).select(
        (F.lit(412000000) + k).cast("long").alias("mmsi_a"), (F.lit(412000000) + k + 7 * (k % 9)).cast("long").alias("mmsi_b"), (k % 5 * 300).alias("starts_at"), (k % 5 * 300 + 3000).alias("ends_at"), ((k % 4).cast("double") / 2).alias("max_speed"),
    )
    cfg = detectors.ContactConfig(course_above=None, min_frames=2, min_seconds=60.0)
    return detectors.transfer(_framed(walk(spark, sf_dir)), plans, cfg).select("mmsi_a", "mmsi_b", "first_seen", F.col("t").alias("last_seen"), "observations", "violation")


@query(f"""WITH {WALK_SQL}, {_BERTH_SQL}, open AS (SELECT DISTINCT mmsi_a, mmsi_b, t FROM berths b WHERE NOT EXISTS (SELECT 1 FROM customer c
  WHERE 412000000 + c_custkey * 2 = mmsi_a AND mmsi_a + 2 * (c_custkey % 4) + 1 = mmsi_b AND (c_custkey % 3 = 0 OR t >= 600))),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY t) > 90 THEN 1 ELSE 0 END AS b FROM open), s AS (SELECT *,
  sum(b) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
n AS (SELECT *, count(*) OVER x >= 2 AND t - min(t) OVER x >= 60 AS enough FROM s WINDOW x AS (PARTITION BY mmsi_a, mmsi_b, k
  ORDER BY t ROWS UNBOUNDED PRECEDING)),
r AS (SELECT mmsi_a, mmsi_b, min(t) AS first_seen, max(t) AS last_seen, count(*) AS observations, min(CASE WHEN enough THEN t END) AS confirmed_at
  FROM n GROUP BY mmsi_a, mmsi_b, k)
SELECT mmsi_a, mmsi_b, first_seen, last_seen, observations, confirmed_at, CASE WHEN (SELECT max(t) FROM fixes) - last_seen > 1200 THEN 'recovered'
  WHEN confirmed_at = last_seen THEN 'new' ELSE 'continuing' END AS state FROM r WHERE confirmed_at IS NOT NULL""")
def berthing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of home and foreign vessels without a permit, with the state of their alert at the newest time."""
    w = _flagged(walk(spark, sf_dir))
    k, home = F.col("c_custkey"), (F.lit(412000000) + F.col("c_custkey") * 2).cast("long")
    permits = read(spark, sf_dir, "customer").select(home.alias("mmsi_a"), (home + 2 * (k % 4) + 1 + _ABROAD).alias("mmsi_b"), F.when(k % 3 != 0, 600).alias("valid_from"), F.lit(None).cast("int").alias("valid_until"))
    cfg = detectors.ContactConfig(max_speed=2.0, max_speed_gap=0.5, course_above=None, min_frames=2, min_seconds=60.0)
    runs = detectors.berthing(*detectors.by_registry(w), permits, cfg).withColumn("mmsi_b", F.col("mmsi_b") - _ABROAD)
    now = w.agg(F.max("t")).first()[0]
    return detectors.alert_states(runs, now or 0, 1200.0).select("mmsi_a", "mmsi_b", "first_seen", "last_seen", "observations", "confirmed_at", "state")


@query("""WITH p AS (SELECT c_custkey, CAST(8000 + c_custkey % 3000 AS BIGINT) AS t FROM customer), i AS (SELECT o_custkey, o_orderkey,
  CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 90 AS b, o_totalprice FROM orders)
SELECT c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM p
  JOIN i ON i.o_custkey = p.c_custkey AND t BETWEEN a AND b) WHERE rn = 1""")
def plan_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plans valid at a time the one of the highest limit; orders stand for plans."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    plans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", day.alias("starts"), (day + 90).alias("ends"), "o_totalprice")
    asked = read(spark, sf_dir, "customer").select("c_custkey", (F.lit(8000) + F.col("c_custkey") % 3000).cast("long").alias("t"))
    valid = temporal.valid_at(asked, plans, ["c_custkey"], "starts", "ends")
    return valid.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query(f"""WITH {FIXES_SQL} SELECT id, round(6371000e0 * sqrt(pow(radians(lon - 113.5e0) * cos(radians(22e0)), 2) + pow(radians(lat - 22e0), 2)), 3) AS offset,
  round((degrees(atan2(sin(radians(lon - 113.5e0)) * cos(radians(lat)), cos(radians(22e0)) * sin(radians(lat)) - sin(radians(22e0)) *
  cos(radians(lat)) * cos(radians(lon - 113.5e0)))) + 360) % 360, 4) AS bearing FROM fixes""")
def offsets_and_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat, lon0, lat0 = F.col("lon"), F.col("lat"), F.lit(113.5), F.lit(22.0)
    x, y = geo.local_offset(lon, lat, lon0, lat0)
    return fixes(spark, sf_dir).select("id", F.round(F.hypot(x, y), 3).alias("offset"), F.round(geo.bearing(lon0, lat0, lon, lat), 4).alias("bearing"))


@query(f"""WITH {FIXES_SQL}, {ZONES_SQL}
SELECT e.zone, any_value(e.rank) AS rank, {R.format("abs(sum(e.x1 * e.y2 - e.x2 * e.y1)) / 2 * 1e6")} AS area_e6, {R.format("min(e.x1)")} AS min_lon,
  {R.format("max(e.x1)")} AS max_lon FROM edges e GROUP BY e.zone""")
def zone_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).select("zone", "rank", rounded(F.col("area") * 1e6).alias("area_e6"), rounded(F.col("min_lon")).alias("min_lon"), rounded(F.col("max_lon")).alias("max_lon"))
