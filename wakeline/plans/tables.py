"""Vessel relations derived from the given tables, and the same relations as SQL for the oracles.

``events`` becomes position reports: a user is a vessel, its events in time order are fixes one minute apart, with a pause of two more minutes after every ninth; positions, speeds and
courses are integer functions of the ids, scaled once, so that two engines compute the same bits. ``nation`` becomes zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spatial


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column) -> Column:
    """Six digits, moved off the ties that decimal input makes likely."""
    return F.round(c + F.lit(3.1e-8), 6)


R = "round({} + 3.1e-8, 6)"

_STATUS = (("signup", 0), ("error", 1), ("click", 5), ("view", 15))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def _motion(df: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    status = F.when(F.col("event_type") == _STATUS[0][0], _STATUS[0][1])
    for kind, code in _STATUS[1:]:
        status = status.when(F.col("event_type") == kind, code)
    return df.select(
        (F.lit(412000000) + u).cast("long").alias("mmsi"), (F.col("seq") * 60 + F.floor(F.col("seq") / 9) * 120).cast("long").alias("t"), e.alias("id"), (F.col("lon_e6").cast("double") / 1e6).alias("lon"), (F.col("lat_e6").cast("double") / 1e6).alias("lat"),
        F.round(F.col("value") * 100).cast("long").alias("v"), (F.round(F.col("value") * 100) / 4000.0).alias("speed"), ((e * 37) % 360).cast("double").alias("course"), ((e * 53) % 360).cast("double").alias("heading"),
        status.cast("int").alias("nav_status"), (e % 7 == 0).alias("at_dock"), (20 + u % 180).cast("double").alias("length"), "event_type",
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports scattered a hundred metres around each vessel's place."""
    e, u = F.col("event_id"), F.col("user_id")
    return _motion(_numbered(spark, sf_dir).withColumns({"lon_e6": F.lit(113500000) + (u % 100) * 10000 + (e * 7919) % 1000, "lat_e6": F.lit(22000000) + (e * 104729) % 1000}))


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports along a random walk of some forty metres a minute."""
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e, u = F.col("event_id"), F.col("user_id")
    return _motion(_numbered(spark, sf_dir).withColumns({
        "lon_e6": F.lit(113500000) + (u % 10) * 3000 + F.sum((e * 7919) % 801 - 400).over(w), "lat_e6": F.lit(22000000) + (u % 7) * 3000 + F.sum((e * 104729) % 801 - 400).over(w),
    }))


def _motion_sql(lon: str, lat: str) -> str:
    return f"""SELECT CAST(412000000 + user_id AS BIGINT) AS mmsi, CAST(seq * 60 + seq // 9 * 120 AS BIGINT) AS t, event_id AS id,
  CAST({lon} AS DOUBLE) / 1e6 AS lon, CAST({lat} AS DOUBLE) / 1e6 AS lat, CAST(round(value * 100) AS BIGINT) AS v,
  round(value * 100) / 4000e0 AS speed,
  CAST((event_id * 37) % 360 AS DOUBLE) AS course, CAST((event_id * 53) % 360 AS DOUBLE) AS heading,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 5 WHEN 'view' THEN 15 END AS nav_status,
  event_id % 7 = 0 AS at_dock, CAST(20 + user_id % 180 AS DOUBLE) AS length, event_type FROM numbered"""


NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
FIXES_SQL = f"{NUMBERED_SQL}, fixes AS ({_motion_sql('113500000 + (user_id % 100) * 10000 + (event_id * 7919) % 1000', '22000000 + (event_id * 104729) % 1000')})"
_SUM = "sum((event_id * {}) % 801 - 400) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
WALK_SQL = f"{NUMBERED_SQL}, fixes AS ({_motion_sql('113500000 + (user_id % 10) * 3000 + ' + _SUM.format(7919), '22000000 + (user_id % 7) * 3000 + ' + _SUM.format(104729))})"

_AROUND = ((-2, 0), (-1, 1), (1, 1), (2, 0), (1, -1), (-1, -1))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five hexagons, neighbours overlapping: zone, rank, vertices, with ring and bounds."""
    k = F.col("n_nationkey").cast("long")
    cx, dx, dy = F.lit(113500000) + k * 40000 + 500, 15000 + k * 400, 300 + k % 7 * 60
    vertex = lambda i, j: F.struct(((cx + dx / 2 * i).cast("double") / 1e6).alias("lon"), ((F.lit(22000500) + dy * j).cast("double") / 1e6).alias("lat"))
    return spatial.with_ring(read(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), k.alias("rank"), F.col("n_regionkey").cast("long").alias("kind"), F.array(*(vertex(i, j) for i, j in _AROUND)).alias("vertices")))


ZONES_SQL = f"""zone_corners AS (
  SELECT n_name AS zone, CAST(n_nationkey AS BIGINT) AS rank, CAST(n_regionkey AS BIGINT) AS kind, c.i,
    CAST(113500000 + CAST(n_nationkey AS BIGINT) * 40000 + 500 + (15000 + n_nationkey * 400) / 2 * c.x AS DOUBLE) / 1e6 AS x,
    CAST(22000500 + (300 + n_nationkey % 7 * 60) * c.y AS DOUBLE) / 1e6 AS y
  FROM nation, (VALUES {', '.join(f'({n}, {i}, {j})' for n, (i, j) in enumerate(_AROUND))}) c(i, x, y)),
edges AS (SELECT a.zone, a.rank, a.kind, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM zone_corners a JOIN zone_corners b ON a.zone = b.zone
  AND b.i = (a.i + 1) % 6)"""

_CHORD_SQL = "pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
HAVERSINE_SQL = f"2 * 6371000e0 * asin(sqrt(CASE WHEN {_CHORD_SQL} > 1 THEN 1e0 ELSE {_CHORD_SQL} END))"


def distance_sql(a: str, b: str, suffix_a: str = "", suffix_b: str = "") -> str:
    return HAVERSINE_SQL.format(lon1=f"{a}.lon{suffix_a}", lat1=f"{a}.lat{suffix_a}", lon2=f"{b}.lon{suffix_b}", lat2=f"{b}.lat{suffix_b}")


CROSSES_SQL = "((e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (CASE WHEN e.y1 = e.y2 THEN 1e0 ELSE e.y2 - e.y1 END) + e.x1)"
ON_EDGE_SQL = "(abs((p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1)) <= 1e-12 AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"
INSIDE_SQL = f"(SELECT p.id, e.zone, any_value(e.rank) AS rank, any_value(e.kind) AS kind FROM fixes p CROSS JOIN edges e GROUP BY p.id, e.zone HAVING sum(CAST({CROSSES_SQL} AS INT)) % 2 = 1 OR bool_or({ON_EDGE_SQL}))"
SEGMENT_SQL = """hypot((e.x1 - p.lon) * 111194.92664455873 * cos(radians(p.lat)) + k * (e.x2 - e.x1) * 111194.92664455873 * cos(radians(p.lat)), (e.y1 - p.lat) * 111194.92664455873 + k * (e.y2 - e.y1) * 111194.92664455873)"""
