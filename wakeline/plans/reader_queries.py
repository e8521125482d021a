"""Queries on what readers and small expressions do: aliases, bounded loads, needed buckets, rings from text, boxes, circles, night, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, records
from ..operators import spatial
from ..sources import files
from . import detectors
from .catalogue import query
from .place_queries import CELL
from .tables import CROSSES_SQL, FIXES_SQL, ZONES_SQL, R, fixes, read, rounded, zones


@query("""SELECT CAST(412000000 + user_id AS VARCHAR) AS mmsi, CAST(event_id % 100 AS VARCHAR) AS lon, CAST(event_id % 50 AS VARCHAR) AS lat, CASE
  WHEN event_id % 3 = 0 THEN '7' ELSE CAST(event_id % 20 AS VARCHAR) END AS speed,
  CAST(event_id % 360 AS VARCHAR) AS heading, CAST(event_id % 28 AS INT) AS msg_type, CAST(event_id % 9 AS DOUBLE) + 0.5e0 AS draught,
  CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE END AS at_dock, CAST(1700000000 + event_id AS DOUBLE) AS t FROM events""")
def canonical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns under other names, as text, times in milliseconds, and a first alias that is blank in most rows."""
    e = F.col("event_id")
    raw = read(spark, sf_dir, "events").select(
        (F.lit(412000000) + F.col("user_id")).cast("string").alias("MMSI"), (e % 100).cast("string").alias("Y"), (e % 50).cast("string").alias("X"), F.when(e % 3 == 0, "7").otherwise(" ").alias("Speed"), (e % 20).cast("string").alias("sog"),
        (e % 360).cast("string").alias("true_heading"), (e % 28).cast("string").alias("message_type"), F.concat((e % 9).cast("string"), F.lit(".5")).alias("draft"), F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "0").alias("at_dock"),
        ((F.lit(1700000000) + e) * 1000).cast("string").alias("time"),
    )
    return files.canonical(raw).select("mmsi", "lon", "lat", "speed", "heading", "msg_type", "draught", "at_dock", "t")


@query(f"""WITH {FIXES_SQL}, p AS (SELECT mmsi, t // 120 * 120 AS t, id FROM fixes WHERE t >= 600), c AS (SELECT mmsi FROM p GROUP BY mmsi ORDER BY min(t),
  mmsi LIMIT 40)
SELECT mmsi, t, max(id) AS seq FROM p WHERE mmsi IN (SELECT mmsi FROM c) GROUP BY mmsi, t""")
def bounded_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty vessels from a time on, one row per vessel and time."""
    coarse = fixes(spark, sf_dir).select("mmsi", (F.floor(F.col("t") / 120) * 120).cast("long").alias("t"), F.col("id").alias("seq"))
    return files.bounded(coarse.filter("t >= 600"), first_vessels=40)


@query(f"""WITH {FIXES_SQL}, w AS (SELECT s_suppkey AS event, CAST(412000000 + s_suppkey AS BIGINT) AS mmsi, CAST(s_suppkey % 7 * 300 AS BIGINT) AS a,
  CAST(s_suppkey % 7 * 300 + 600 AS BIGINT) AS b FROM supplier)
SELECT w.event, f.mmsi, f.t FROM w JOIN fixes f ON f.mmsi = w.mmsi AND f.t BETWEEN w.a AND w.b""")
def needed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes within windows, through the time buckets that the windows need."""
    k = F.col("s_suppkey")
    windows = read(spark, sf_dir, "supplier").select(k.alias("event"), (F.lit(412000000) + k).cast("long").alias("mmsi"), (k % 7 * 300).cast("long").alias("start"), (k % 7 * 300 + 600).cast("long").alias("end"))
    return files.in_needed_buckets(fixes(spark, sf_dir).select("mmsi", "t"), windows).select("event", "mmsi", "t")


@query("""SELECT o_orderkey, (CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 613 + 28800) % 86400 // 3600 >= 20
  OR (CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 613 + 28800) % 86400 // 3600 < 6 AS night FROM orders""")
def at_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp("o_orderdate") + F.col("o_orderkey") * 613
    return read(spark, sf_dir, "orders").select("o_orderkey", records.at_night(t, 8.0, 20, 6).alias("night"))


@query("""SELECT c_custkey, coalesce(stated <> expected, FALSE) AS differs
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'HKG' WHEN 1 THEN 'CHN' END AS stated, CASE c_custkey % 4 WHEN 0 THEN 'HKG' WHEN 1 THEN 'CHN'
  WHEN 2 THEN 'CHN' END AS expected FROM customer)""")
def identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated registry, by code or by flag, against the country digits."""
    k = F.col("c_custkey")
    mmsi = F.when(k % 4 == 0, "477").when(k % 4 == 1, "412").when(k % 4 == 2, "414").otherwise("235")
    iso3, flag = F.when(k % 3 == 0, "hkg").otherwise(""), F.when(k % 3 == 1, "China").when(k % 3 == 2, "GBR")
    found = records.identity_mismatch(F.concat(mmsi, F.lit("000001")), iso3, flag)
    return read(spark, sf_dir, "customer").select("c_custkey", found.alias("differs"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%9%' OR lower(c_mktsegment) LIKE '%9%'")
def text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").filter(records.matches_text("9", "c_name", "c_mktsegment")).select("c_custkey")


@query(f"""WITH {FIXES_SQL} SELECT id, NOT at_dock AND id % 10 <> 0 AND id % 8 <> 0 AND (nav_status IS NULL OR nav_status IN (0, 15)) AS eligible FROM fixes""")
def eligible_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    f = fixes(spark, sf_dir).withColumns({"port_name": F.when(k % 10 == 0, "port"), "authorised": F.when(k % 8 == 0, True)})
    return detectors.underway_eligible(f).select("id", "eligible")


@query(f"""WITH {ZONES_SQL} SELECT rank, CASE kind WHEN 0 THEN 6 WHEN 2 THEN 6 WHEN 4 THEN 6 END AS n_vertices, CASE WHEN kind IN (1, 3) THEN 'too few vertices'
  WHEN kind = 4 AND rank % 2 = 1 THEN 'edges cross' END AS fault FROM (SELECT DISTINCT rank, kind FROM zone_corners)""")
def rings_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings written as WKT, GeoJSON or lines are read again; one with a hole and a collection are refused, as is one whose corners are swapped."""
    z = zones(spark, sf_dir).select("rank", "kind", F.col("vertices").alias("v"))
    swapped = F.concat(F.slice("v", 1, 1), F.slice("v", 3, 1), F.slice("v", 2, 1), F.slice("v", 4, 3))
    corners = F.when((F.col("kind") == 4) & (F.col("rank") % 2 == 1), swapped).otherwise(F.col("v"))
    pair = lambda gap: F.transform("c", lambda p: F.concat_ws(gap, p["lon"].cast("string"), p["lat"].cast("string")))
    closed = F.concat(pair(" "), F.slice(pair(" "), 1, 1))
    wkt = F.array_join(closed, ", ")
    json = F.array_join(F.transform("c", lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))), ",")
    text = (
        F.when(F.col("kind") == 0, F.concat(F.lit("POLYGON (("), wkt, F.lit("))"))).when(F.col("kind") == 1, F.concat(F.lit("POLYGON (("), wkt, F.lit("), (1 1, 2 1, 2 2, 1 1))")))
        .when(F.col("kind") == 2, F.concat(F.lit('{"type": "Polygon", "coordinates": [['), json, F.lit("]]}"))).when(F.col("kind") == 3, F.concat(F.lit("MULTIPOLYGON ((("), wkt, F.lit(")))"))).otherwise(F.array_join(pair(", "), "; "))
    )
    parsed = z.withColumn("c", corners).select("rank", geo.parse_ring(text).alias("ring"))
    return parsed.select("rank", F.when(F.col("ring").isNotNull(), F.size("ring")).cast("long").alias("n_vertices"), geo.ring_fault(F.col("ring")).alias("fault"))


@query(f"WITH {FIXES_SQL}, {ZONES_SQL} SELECT p.id, e.zone FROM fixes p CROSS JOIN edges e GROUP BY p.id, e.zone HAVING sum(CAST({CROSSES_SQL} AS INT)) % 2 = 1")
def strictly_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that hold a fix, the boundary as the ray decides."""
    return spatial.in_zones(fixes(spark, sf_dir), zones(spark, sf_dir), CELL, boundary=False).select("id", "zone")


@query(f"""WITH {FIXES_SQL}, {ZONES_SQL}, b AS (SELECT zone, min(x1) AS x0, max(x1) AS xx, min(y1) AS y0, max(y1) AS yy FROM edges GROUP BY zone)
SELECT f.id, b.zone FROM fixes f JOIN b ON f.lon BETWEEN x0 - 200 / (111320e0 * greatest(cos(radians(f.lat)), 0.1e0))
  AND xx + 200 / (111320e0 * greatest(cos(radians(f.lat)), 0.1e0)) AND f.lat BETWEEN y0 - 200 / 111320e0 AND yy + 200 / 111320e0""")
def box_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in the boxes of zones, widened by two hundred metres."""
    near = spatial.near_zones(fixes(spark, sf_dir).select("id", "lon", "lat"), zones(spark, sf_dir), CELL, 250.0)
    box = (F.col(c) for c in ("lon", "lat", "min_lon", "min_lat", "max_lon", "max_lat"))
    return near.filter(geo.in_box(*box, margin=200.0)).select("id", "zone")


@query(f"""WITH c AS (SELECT s_suppkey AS k, s_suppkey % 90 + (s_suppkey % 60) / 60e0 + (s_suppkey % 50) / 3600e0 AS lon, radians(s_suppkey % 60) AS phi,
  (500 + s_suppkey % 1000) / 6371000e0 AS d FROM supplier),
v AS (SELECT k, i, lon, phi, d, radians(i * 5) AS a, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(radians(i * 5))) AS y FROM c,
  generate_series(0, 71) g(i))
SELECT k, i, {R.format("lon + degrees(atan2(sin(a) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(y)))")} AS lon, {R.format("degrees(y)")} AS lat FROM v""")
def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of 72 corners around points given in degrees, minutes and seconds."""
    k = F.col("s_suppkey")
    centre = read(spark, sf_dir, "supplier").select(k.alias("k"), geo.dms(k % 90, k % 60, k % 50).alias("lon"), (k % 60).cast("double").alias("lat"), (k % 1000 + 500).cast("double").alias("r"))
    corners = centre.select("k", F.posexplode(geo.circle(F.col("lon"), F.col("lat"), F.col("r"))).alias("i", "v"))
    return corners.select("k", F.col("i").cast("long").alias("i"), rounded(F.col("v.lon")).alias("lon"), rounded(F.col("v.lat")).alias("lat"))


_WAVE = "(20 * sin({0} * 6 * pi()) + 20 * sin({0} * 2 * pi())) * 2 / 3"


@query(f"""WITH {FIXES_SQL}, o AS (SELECT id, lon, lat, lon - 105 AS x, lat - 35 AS y, 1 - 0.00669342162296594323e0 * pow(sin(radians(lat)), 2) AS m FROM fixes),
s AS (SELECT *, -100 + 2 * x + 3 * y + 0.2e0 * y * y + 0.1e0 * x * y + 0.2e0 * sqrt(abs(x)) + {_WAVE.format("x")} + (20 * sin(y * pi()) + 40 * sin(y
  / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS north,
  300 + x + 2 * y + 0.1e0 * x * x + 0.1e0 * x * y + 0.1e0 * sqrt(abs(x)) + {_WAVE.format("x")} + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 /
  3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS east FROM o)
SELECT id, {R.format("lon + east * 180 / (6378245e0 / sqrt(m) * cos(radians(lat)) * pi())")} AS lon,
  {R.format("lat + north * 180 / (6378245e0 * (1 - 0.00669342162296594323e0) / (m * sqrt(m)) * pi())")} AS lat, 0e0 AS off FROM s""")
def shifted_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in the shifted system, and how far off they are after going back (millimetres, rounded to none)."""
    x, y = geo.to_gcj02(F.col("lon"), F.col("lat"))
    there = fixes(spark, sf_dir).select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    bx, by = geo.from_gcj02(F.col("x"), F.col("y"))
    back = there.withColumns({"bx": bx, "by": by})
    off = F.abs(F.round(geo.haversine(F.col("lon"), F.col("lat"), F.col("bx"), F.col("by")), 3))
    return back.select("id", rounded(F.col("x")).alias("lon"), rounded(F.col("y")).alias("lat"), off.alias("off"))


@query(f"WITH {FIXES_SQL} SELECT id, least(abs(course - heading) % 180, 180 - abs(course - heading) % 180) AS axis_gap, {R.format('CASE WHEN abs(course - heading) = 180 THEN course ELSE (degrees(atan2(sin(radians(course)) + sin(radians(heading)), cos(radians(course)) + cos(radians(heading)))) + 360) % 360 END')} AS middle FROM fixes")
def course_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle between course and heading as axes, and the direction halfway between them."""
    a, b = F.col("course"), F.col("heading")
    return fixes(spark, sf_dir).select("id", geo.axial_angle_between(a, b).alias("axis_gap"), rounded(geo.mean_course(a, b)).alias("middle"))
