"""Queries on events and their trajectories, sensor association, and the composite detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import behavior, events, lifecycle, sequence, spatial, temporal, tracks
from . import detectors, fusion
from .catalogue import query
from .place_queries import CELL
from .record_queries import NEAR_LATEST_SQL, tail_sql
from .tables import FIXES_SQL, HAVERSINE_SQL, INSIDE_SQL, WALK_SQL, ZONES_SQL, R, distance_sql, fixes, read, rounded, walk, zones


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for detections: the kind is the feature, the user the target."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("feature_id"), F.col("event_id").alias("detection_id"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("detected_at"), F.round(F.col("value") * 100).cast("long").alias("v"))


_DETECTIONS_SQL = "det AS (SELECT user_id, event_type AS feature_id, event_id AS detection_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS detected_at, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


@query(f"""WITH {_DETECTIONS_SQL} SELECT sha256(user_id || chr(31) || feature_id) AS event_key, user_id, feature_id, min(detected_at) AS first_detected_at,
  max(detected_at) AS last_detected_at, count(*) AS occurrences,
  arg_max(v, detected_at * 1000000 + detection_id) AS v, arg_max(detection_id, detected_at * 1000000 + detection_id) AS detection_id FROM det
  GROUP BY user_id, feature_id""")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.deduplicated(_detections(spark, sf_dir), ["user_id", "feature_id"], ["v", "detection_id"])
    return found.withColumn("event_key", events.event_key("user_id", "feature_id"))


@query(f"""WITH {_DETECTIONS_SQL}, parts AS (SELECT user_id, feature_id, min(detected_at) AS a, max(detected_at) AS b, count(*) AS n FROM det GROUP BY 1, 2)
SELECT user_id, feature_id, a AS first_detected_at, b AS last_detected_at, n AS occurrences, (SELECT arg_max(v, detected_at * 1000000 + detection_id)
  FROM det d WHERE d.user_id = p.user_id AND d.feature_id = p.feature_id) AS v FROM parts p""")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged one after the other give what one batch gives."""
    d = _detections(spark, sf_dir)
    early, late = (events.deduplicated(d.filter(c), ["user_id", "feature_id"], ["v"]) for c in ("detected_at < 1704500000", "detected_at >= 1704500000"))
    return events.upsert(early, late, ["user_id", "feature_id"], ["v"])


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM events WHERE props LIKE '%1%' GROUP BY event_type")
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_share(events.search(read(spark, sf_dir, "events"), text="1", columns=("props",)), ["event_type"])


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def event_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.child_counts(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_orders")


@query(f"WITH {_DETECTIONS_SQL} SELECT user_id, min(detected_at) AS first_t, max(detected_at) AS last_t FROM det GROUP BY user_id")
def event_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).groupBy("user_id").agg(F.min("detected_at").alias("first_t"), F.max("detected_at").alias("last_t"))


@query(f"WITH {_DETECTIONS_SQL} SELECT user_id, v // 1000 AS band, min(detection_id) AS detection_id FROM det GROUP BY 1, 2")
def duplicates_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).select("user_id", F.floor(F.col("v") / 1000).cast("long").alias("band"), "detection_id")
    return events.keep_one(d, ["user_id", "band"], "detection_id")


@query(f"""WITH {_DETECTIONS_SQL}, i AS (SELECT user_id, detected_at AS a, detected_at + v AS b FROM det), r AS (SELECT *, max(b) OVER (PARTITION BY user_id
  ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a,
  b ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT user_id, min(a) AS group_start, max(b) AS group_end, count(*) AS n FROM g GROUP BY user_id, k""")
def event_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).select("user_id", F.col("detected_at").alias("a"), (F.col("detected_at") + F.col("v")).alias("b"))
    return sequence.merged_intervals(d, "a", "b", 10000, ("user_id",))


@query(f"WITH {_DETECTIONS_SQL} SELECT user_id, detection_id, detected_at FROM det ORDER BY detected_at DESC, detection_id DESC LIMIT 50")
def trajectory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.newest_page(_detections(spark, sf_dir).select("user_id", "detection_id", "detected_at"), 50, "detected_at", "detection_id")


@query(f"WITH {_DETECTIONS_SQL} SELECT user_id, detection_id FROM det ORDER BY detected_at DESC, detection_id LIMIT 20 OFFSET 40")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir)
    return events.page(d, [F.desc("detected_at"), F.col("detection_id")], 3, 20).select("user_id", "detection_id")


@query(f"""WITH {_DETECTIONS_SQL}, n AS (SELECT count(*) AS n FROM det WHERE feature_id = 'view') SELECT n AS count, CAST(least(7, greatest(1, (n + 19) // 20)) AS INT) AS page, 20 AS page_size,
  CAST(greatest(1, (n + 19) // 20) AS INT) AS total_pages, least(7, greatest(1, (n + 19) // 20)) > 1 AS has_previous, 7 < greatest(1, (n + 19) // 20) AS has_next FROM n""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list says of its seventh page besides its rows."""
    return events.page_facts(_detections(spark, sf_dir).filter("feature_id = 'view'"), 7, 20)


@query(f"WITH {_DETECTIONS_SQL} SELECT user_id, detection_id, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, detection_id DESC) AS rn FROM det) WHERE rn <= 5")
def recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest few rows of each target."""
    d = _detections(spark, sf_dir).withColumn("t", F.col("detected_at") * 1000000 + F.col("detection_id"))
    return sequence.bounded_history(d, 1e18, 5, "detection_id", by=("user_id",)).select("user_id", "detection_id", "detected_at")


@query(f"""WITH {FIXES_SQL} SELECT mmsi, t FROM fixes WHERE v > 8000 UNION SELECT mmsi, t FROM fixes WHERE nav_status = 5""")
def union_of_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    return f.filter("v > 8000").select("mmsi", "t").union(f.filter("nav_status = 5").select("mmsi", "t")).distinct()


@query(f"WITH {FIXES_SQL} (SELECT t FROM fixes WHERE v > 20000 INTERSECT SELECT t FROM fixes WHERE nav_status = 5)")
def common_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    return f.filter("v > 20000").select("t").intersect(f.filter("nav_status = 5").select("t"))


@query(f"WITH {FIXES_SQL} (SELECT t FROM fixes WHERE nav_status = 5 EXCEPT SELECT t FROM fixes WHERE v > 20000)")
def missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    return f.filter("nav_status = 5").select("t").subtract(f.filter("v > 20000").select("t"))


@query("SELECT o_orderkey, l_orderkey IS NOT NULL AS shipped FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey WHERE o_totalprice > 400000")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a larger relation, as an outer semi-join flag."""
    returned = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_hit", F.lit(True))
    return read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_orderkey").join(returned, "o_orderkey", "left").select("o_orderkey", F.col("_hit").isNotNull().alias("shipped"))


@query(f"""WITH {_DETECTIONS_SQL}, e AS (SELECT user_id, feature_id, max(detected_at) AS last_detected_at, count(*) AS occurrences FROM det GROUP BY 1, 2)
SELECT user_id, feature_id, last_detected_at, occurrences FROM e WHERE feature_id = 'error' AND CAST(user_id AS VARCHAR) LIKE '%1%'
  AND last_detected_at >= 1704067200 AND last_detected_at < 1706659200 ORDER BY last_detected_at DESC, user_id LIMIT 20""")
def violation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of an event search by feature, target text and time."""
    found = events.deduplicated(_detections(spark, sf_dir), ["user_id", "feature_id"], ["v"]).select("user_id", "feature_id", "last_detected_at", "occurrences")
    hits = events.search(found, "error", "1", ("user_id",), F.lit(1704067200), F.lit(1706659200))
    return events.page(hits, [F.desc("last_detected_at"), F.col("user_id")], 1, 20)


@query(f"""WITH {WALK_SQL}, e AS (SELECT c_custkey % 150 AS k, c_custkey AS event FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
SELECT DISTINCT f.mmsi, f.t, f.lon, f.lat FROM fixes f JOIN e ON f.mmsi = 412000000 + e.k WHERE f.t BETWEEN 600 AND 3000 ORDER BY f.t DESC,
  f.mmsi DESC LIMIT 50""")
def ship_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the vessels of some events, distinct, the newest fifty in time order."""
    chosen = read(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select((F.lit(412000000) + F.col("c_custkey") % 150).cast("long").alias("mmsi"))
    points = walk(spark, sf_dir).filter(F.col("t").between(600, 3000)).join(chosen, "mmsi", "left_semi").select("mmsi", "t", "lon", "lat").distinct()
    return events.newest_page(points, 50, tie="mmsi")


@query(f"""WITH {FIXES_SQL} SELECT seconds, count(*) AS n FROM (SELECT CASE WHEN id % 30 = 27 THEN 180e0 WHEN id % 30 IN (18, 19) THEN CASE
  WHEN s <= 2 THEN 180e0 WHEN s <= 14 THEN 30e0 WHEN s <= 23 THEN CASE WHEN turning THEN 5e0 ELSE 15e0 END ELSE 5e0 END
  WHEN nav_status IN (1, 5) AND s <= 3 THEN 180e0 WHEN s <= 14 THEN CASE WHEN turning THEN round(10e0 / 3, 3) ELSE 10e0 END WHEN s <= 23 THEN CASE
  WHEN turning THEN 2e0 ELSE 6e0 END ELSE 2e0 END AS seconds FROM (SELECT *, speed * 8 AS s, id % 3 = 0 AS turning FROM fixes)) GROUP BY seconds""")
def reporting_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    rate = records.reporting_interval(F.col("id") % 30, F.col("speed") * 8, F.col("nav_status"), F.when(F.col("id") % 3 == 0, 4.0))
    return f.groupBy(F.round(rate, 3).alias("seconds")).agg(F.count("*").alias("n"))


@query(f"""WITH {WALK_SQL}, c AS (SELECT mmsi, t, CASE nav_status WHEN 0 THEN 'enter' WHEN 1 THEN 'exit' ELSE 'none' END AS d FROM fixes), x AS (SELECT mmsi, t,
  (SELECT min(o.t) FROM c o WHERE o.mmsi = c.mmsi AND o.t > c.t AND o.d = 'exit' AND o.t - c.t <= 86400) AS leave FROM c WHERE d = 'enter'),
f AS (SELECT mmsi, min(t) AS t FROM x GROUP BY mmsi), k AS (SELECT x.mmsi, x.leave FROM x JOIN f ON f.mmsi = x.mmsi AND f.t = x.t) SELECT p.mmsi, p.t
  FROM fixes p JOIN k ON k.mmsi = p.mmsi WHERE k.leave IS NULL OR p.t <= k.leave""")
def trimmed_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points up to the exit that follows each vessel's first entry."""
    w = walk(spark, sf_dir)
    kind = F.when(F.col("nav_status") == 0, "enter").when(F.col("nav_status") == 1, "exit").otherwise("none")
    cut = events.cutoff(w.select("mmsi", "t", kind.alias("direction"), F.lit("f").alias("fence")))
    first = events.keep_one(cut.filter("direction = 'enter'").select("mmsi", "t", "leaves_at"), ["mmsi"], "t").select("mmsi", "leaves_at")
    return events.trimmed(w.select("mmsi", "t").join(first.select("mmsi"), "mmsi", "left_semi"), first, ["mmsi"])


@query(f"""WITH {ZONES_SQL} SELECT rank, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' AS head, list_concat(list({{'x': x1, 'y': y1}} ORDER BY i),
  [{{'x': first(x1 ORDER BY i), 'y': first(y1 ORDER BY i)}}]).list_transform(lambda p: CAST(round(p.x * 1e6) AS BIGINT) || ' ' || CAST(round(p.y * 1e6) AS BIGINT)).array_to_string(',') AS ring FROM edges GROUP BY rank""")
def zone_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features: how they begin, and the points of their ring in millionths of a degree."""
    z = zones(spark, sf_dir).select("rank", "zone", "vertices")
    feature = events.geojson(z)
    parsed = F.from_json("feature", "geometry struct<coordinates: array<array<array<double>>>>, properties struct<rank: bigint>")
    return feature.select(parsed.alias("p"), F.substring("feature", 1, 63).alias("head")).select(F.col("p.properties.rank").alias("rank"), "head", F.array_join(F.transform(F.col("p.geometry.coordinates")[0], lambda v: F.concat_ws(" ", *(F.round(v[i] * 1e6).cast("long").cast("string") for i in (0, 1)))), ",").alias("ring"))


@query(f"""WITH {FIXES_SQL}, d AS (SELECT mmsi, nav_status AS status, t FROM fixes WHERE v > 4000), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi, status ORDER BY t) > 600
  THEN 1 ELSE 0 END AS b FROM d), r AS (SELECT *, sum(b) OVER (PARTITION BY mmsi, status ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
a AS (SELECT mmsi, status, k, min(t) AS first_seen, max(t) AS last_seen, count(*) AS observations FROM r GROUP BY 1, 2, 3), n AS (SELECT max(t) AS now FROM d)
SELECT mmsi, status, first_seen, last_seen, observations, CASE WHEN over THEN 'recovered' WHEN first_seen = last_seen AND last_seen = now THEN 'new' ELSE 'continuing' END AS state,
  CASE WHEN over THEN CAST(last_seen + 600 AS DOUBLE) END AS ended_at FROM (SELECT *, lead(first_seen) OVER (PARTITION BY mmsi, status ORDER BY k) IS NOT NULL OR now - last_seen > 600 AS over FROM a, n)""")
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of fast reports by vessel and status: those that go on over reports in between, and those that are over."""
    found = fixes(spark, sf_dir).filter("v > 4000").select("mmsi", F.col("nav_status").alias("status"), "t")
    return lifecycle.alerts(found, ["mmsi", "status"], 600.0).withColumn("ended_at", F.col("ended_at").cast("double"))


# --- association of two sensors -------------------------------------------------------------------------------------


def _ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eleventh report has no speed and each thirteenth no course."""
    k = F.col("id")
    return fixes(spark, sf_dir).select(F.col("mmsi").alias("target"), "t", "lon", "lat", F.when(k % 11 != 0, F.col("speed")).alias("speed"), F.when(k % 13 != 0, F.col("course")).alias("course"))


def _radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar sees every vessel half a minute after its report, a little aside; each fifth plot is half a kilometre off, where nobody reports from."""
    aside = F.when(F.col("id") % 5 == 0, 0.005).otherwise(0.0002)
    return fixes(spark, sf_dir).select((F.col("t") + 30).alias("frame"), F.col("id").alias("plot"), (F.col("lon") + aside).alias("lon"), "lat", F.col("mmsi").alias("truth"))


_AIS_SQL = """ais AS (SELECT mmsi AS target, t, lon, lat, CASE WHEN id % 11 <> 0 THEN speed END AS speed, CASE WHEN id % 13 <> 0 THEN course END AS course FROM fixes),
radar AS MATERIALIZED (SELECT t + 30 AS frame, id AS plot, lon + CASE WHEN id % 5 = 0 THEN 0.005e0 ELSE 0.0002e0 END AS lon, lat, mmsi AS truth FROM fixes)"""
_STATES_SQL = f"""{_AIS_SQL}, steps AS (SELECT *, lead(t) OVER w AS until, radians(lon - lag(lon) OVER w) * 6371000e0 * cos(radians(lag(lat) OVER w)) / nullif(t - lag(t) OVER w, 0) AS x,
  radians(lat - lag(lat) OVER w) * 6371000e0 / nullif(t - lag(t) OVER w, 0) AS y, lag(speed) OVER w * 0.514444e0 * sin(radians(lag(course) OVER w)) AS px,
  lag(speed) OVER w * 0.514444e0 * cos(radians(lag(course) OVER w)) AS py FROM ais WINDOW w AS (PARTITION BY target ORDER BY t)),
reports AS MATERIALIZED (SELECT target, t, lon, lat, until, coalesce(speed * 0.514444e0 * sin(radians(course)), x, 0e0) AS east, coalesce(speed * 0.514444e0 * cos(radians(course)), y, 0e0) AS north,
  coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0e0) AS rate FROM steps),
served AS (SELECT *, unnest(generate_series(t // 180, CASE WHEN until < t + 180 THEN until ELSE t + 180 END // 180)) AS bucket FROM reports),
st AS MATERIALIZED (SELECT frame, target, frame - t AS age, lon + degrees(east * (frame - t) / (6371000e0 * greatest(abs(cos(radians(lat))), 1e-9))) AS lon,
  lat + degrees(north * (frame - t) / 6371000e0) AS lat, rate * (frame - t) AS sigma FROM (SELECT DISTINCT frame, frame // 180 AS bucket FROM radar) f JOIN served a USING (bucket)
  WHERE a.t <= f.frame AND f.frame - a.t <= 180 AND (a.until IS NULL OR f.frame < a.until))"""
_GATE = fusion.FusionConfig(gate=300.0, max_age=180.0)


@query(f"WITH {FIXES_SQL}, {_STATES_SQL} SELECT frame, target, age, {R.format('lon')} AS lon, {R.format('lat')} AS lat, round(sigma, 3) AS sigma FROM st")
def asof_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = fusion.states_at(_ais(spark, sf_dir), _radar(spark, sf_dir).select("frame"), 180.0)
    return states.select("frame", "target", F.col("age").cast("long").alias("age"), rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"), F.round("sigma", 3).alias("sigma"))


_CANDIDATES_SQL = f"""cand AS MATERIALIZED (SELECT * FROM (SELECT r.frame, r.plot, s.target, {distance_sql('r', 's')} AS distance, 300 + 3 * sigma AS gate, 500 + sigma AS scale
  FROM radar r JOIN st s ON s.frame = r.frame) WHERE distance < gate)"""


@query(f"WITH {FIXES_SQL}, {_STATES_SQL}, {_CANDIDATES_SQL} SELECT frame, plot, target, round(distance, 3) AS distance, round(gate, 3) AS gate, {R.format('1 - exp(-distance / scale)')} AS cost FROM cand")
def gated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots and targets within the gate of the pair, which grows with the target's uncertainty."""
    found = fusion.candidates(_ais(spark, sf_dir), _radar(spark, sf_dir), 180.0, _GATE)
    return found.select("frame", "plot", "target", F.round("distance", 3).alias("distance"), F.round("gate", 3).alias("gate"), rounded(F.col("cost")).alias("cost"))


@query(f"WITH {FIXES_SQL}, {_STATES_SQL}, {_CANDIDATES_SQL} SELECT r.frame, r.plot FROM radar r ANTI JOIN cand c ON c.frame = r.frame AND c.plot = r.plot")
def unmatched_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar plots that no reported vessel could explain."""
    return fusion.without_gate(_ais(spark, sf_dir), _radar(spark, sf_dir), _GATE)


@query(f"WITH {FIXES_SQL}, {_STATES_SQL}, {_CANDIDATES_SQL} SELECT s.frame, s.target FROM st s ANTI JOIN cand c ON c.frame = s.frame AND c.target = s.target")
def unmatched_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported vessels for which there is no plot near."""
    return fusion.without_plot(_ais(spark, sf_dir), _radar(spark, sf_dir), _GATE)


@query()
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best one-to-one association; tested against all permutations."""
    return fusion.associate(_ais(spark, sf_dir), _radar(spark, sf_dir), _GATE)


@query()
def ais_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar plots that the association leaves over; the association is no SQL."""
    return fusion.left_plots(_ais(spark, sf_dir), _radar(spark, sf_dir), _GATE)


@query()
def spoofed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported vessels that the association leaves over."""
    return fusion.left_states(_ais(spark, sf_dir), _radar(spark, sf_dir), _GATE)


@query(f"""WITH {FIXES_SQL}, {_STATES_SQL}, {_CANDIDATES_SQL}, p AS (SELECT DISTINCT frame, plot, target FROM cand), t AS (SELECT r.frame, r.plot,
  r.truth AS target FROM radar r),
c AS (SELECT (SELECT count(*) FROM p JOIN t USING (frame, plot, target)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt)
  SELECT tp, np - tp AS fp, nt - tp AS fn, {R.format("tp / np")} AS precision, {R.format("tp / nt")} AS recall FROM c""")
def gate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the gate alone tells the vessels. A pair comes once and knows its plot's vessel, so it is counted where it is made."""
    radar = _radar(spark, sf_dir)
    pairs = fusion.candidates(_ais(spark, sf_dir), radar, 180.0, _GATE, ("truth",))
    counts = pairs.agg(F.count_if(F.col("target") == F.col("truth")).alias("tp"), F.count("*").alias("n")).crossJoin(radar.agg(F.count("*").alias("true")))  # one row each
    q = counts.select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"), F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "true").alias("recall"))
    return _rounded_quality(q)


@query()
def association_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the association does."""
    return _quality(spark, sf_dir, assignment(spark, sf_dir))


def _quality(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    truth = _radar(spark, sf_dir).select("frame", "plot", F.col("truth").alias("target"))
    q = temporal.quality(found, truth, ["frame", "plot", "target"])
    return _rounded_quality(q)


def _rounded_quality(q: DataFrame) -> DataFrame:
    return q.select("tp", "fp", "fn", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


# --- detectors -------------------------------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str):
    """What a zone join adds to each vessel's newest fix: zones of kind 3 are port basins, of kind 4 berthing facilities."""

    def add(newest: DataFrame) -> DataFrame:
        hits = spatial.in_zones(newest.select("id", "lon", "lat"), zones(spark, sf_dir), CELL).groupBy("id").agg(F.max(F.col("kind") == 3).alias("in_port_basin"), F.max(F.col("kind") == 4).alias("berthing_facility"))
        return newest.join(hits, "id", "left")

    return add


def _behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.classify(fixes(spark, sf_dir), _CFG, _places(spark, sf_dir))


_CFG = behavior.BehaviorConfig(max_gap=90.0, stay_speed=0.9)
_STAY_SQL = tail_sql(FIXES_SQL + ", " + ZONES_SQL, "speed <= 1", 90, NEAR_LATEST_SQL, "mmsi, 1 AS x").rsplit("SELECT mmsi, 1 AS x", 1)[0]
_BEHAVIOR_SQL = f"""{_STAY_SQL}, c AS (SELECT *, avg(lon) OVER (PARTITION BY mmsi) AS clon, avg(lat) OVER (PARTITION BY mmsi) AS clat, lag(lon) OVER (PARTITION BY mmsi
  ORDER BY t) AS plon, lag(lat) OVER (PARTITION BY mmsi ORDER BY t) AS plat,
  lead(heading) OVER (PARTITION BY mmsi ORDER BY heading) AS nh, min(heading) OVER (PARTITION BY mmsi) AS lo FROM tail),
facts AS (SELECT mmsi, count(*) AS points, max(t) - min(t) AS duration, avg(speed) AS mean_speed,
  max({HAVERSINE_SQL.format(lon1="lon", lat1="lat", lon2="clon", lat2="clat")}) AS radius,
  coalesce(sum({HAVERSINE_SQL.format(lon1="plon", lat1="plat", lon2="lon", lat2="lat")}), 0) AS path,
  {HAVERSINE_SQL.format(lon1="arg_min(lon, t)", lat1="arg_min(lat, t)", lon2="arg_max(lon, t)", lat2="arg_max(lat, t)")} AS displacement, CASE
  WHEN count(*) >= 2 THEN 360 - max(coalesce(nh, lo + 360) - heading) END AS arc,
  count(*) FILTER (nav_status = 1) / count(*) AS anchored, count(*) FILTER (nav_status = 5) / count(*) AS moored, count(nav_status) AS statuses
  FROM c GROUP BY mmsi),
z AS (SELECT id, bool_or(kind = 3) AS basin, bool_or(kind = 4) AS facility FROM {INSIDE_SQL} GROUP BY id),
n AS (SELECT f.mmsi, f.speed, f.at_dock, coalesce(z.basin, FALSE) AS basin, coalesce(z.facility, FALSE) AS facility FROM (SELECT *,
  row_number() OVER (PARTITION BY mmsi ORDER BY t DESC) AS rn FROM fixes) f LEFT JOIN z ON z.id = f.id WHERE rn = 1),
s AS (SELECT n.*, facts.* EXCLUDE (mmsi), coalesce(arc >= 45, FALSE) OR (radius >= 10 AND path >= greatest(50, 4 * radius) AND CASE
  WHEN path > 1e-6 THEN displacement / path ELSE 1 END <= 0.35e0) AS swing, anchored >= 0.6e0 AS at_anchor, points < 2 OR arc <= 25 AS stable FROM n
  LEFT JOIN facts ON facts.mmsi = n.mmsi),
b AS (SELECT *, CASE WHEN points IS NULL THEN CASE WHEN speed > 1 THEN 'underway' ELSE 'insufficient' END WHEN points < 3 THEN 'insufficient'
  WHEN mean_speed > 0.9e0 OR radius > 250 THEN 'underway'
  WHEN ((facility OR (basin AND at_dock)) AND stable AND NOT at_anchor AND NOT swing) OR (basin AND stable AND NOT at_anchor AND NOT swing
  AND (at_dock OR moored >= 0.6e0 OR statuses = 0)) THEN 'berthing' WHEN at_anchor OR swing THEN 'anchoring' ELSE 'staying' END AS behavior FROM s)"""


@query(f"{_BEHAVIOR_SQL} SELECT mmsi, behavior, coalesce(points, 0) >= 3 AS qualified, coalesce(points, 0) AS points, coalesce(duration, 0) AS duration, round(radius, 3) AS radius, round(path, 3) AS path, arc AS heading_arc FROM b")
def behavior_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _behavior(spark, sf_dir)
    return found.select("mmsi", "behavior", "qualified", F.col("points").cast("long").alias("points"), F.col("duration").cast("long").alias("duration"), F.round("radius", 3).alias("radius"), F.round("path", 3).alias("path"), "heading_arc")


@query("""SELECT CAST(412000000 + c_custkey AS BIGINT) AS mmsi, CASE WHEN c_custkey % 4 = 0 THEN s_name ELSE c_name END AS name, s_suppkey FROM customer
  JOIN supplier ON s_suppkey * 3 = c_custkey""")
def blacklist_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ships = read(spark, sf_dir, "customer").select((F.lit(412000000) + k).cast("long").alias("mmsi"), F.when(k % 4 == 0, records.UNKNOWN_NAME).otherwise(F.col("c_name")).alias("name"))
    listed = read(spark, sf_dir, "supplier").select((F.lit(412000000) + F.col("s_suppkey") * 3).cast("long").alias("mmsi"), F.col("s_name").alias("name"), "s_suppkey")
    return detectors.blacklist(ships, listed).select("mmsi", "name", "s_suppkey")


_RECENT = "t >= (SELECT max(t) FROM fixes) - 2400 AND speed <= 102.2e0"


@query(f"""SELECT mmsi, n AS n_points, duration, max_v, CASE WHEN max_v / 4000 - 0.3e0 >= 2 THEN 'high' ELSE 'medium' END AS risk
  FROM ({tail_sql(FIXES_SQL, "speed > 0.3e0", 90, where=_RECENT)}) WHERE duration >= 120""")
def high_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.high_speed(fixes(spark, sf_dir), detectors.HighSpeedConfig(limit=0.3, window=2400.0, min_seconds=120.0, high_excess=2.0))
    return found.select("mmsi", "n_points", "duration", F.round(F.col("max_speed") * 4000).cast("long").alias("max_v"), "risk")


@query(f"""WITH {FIXES_SQL}, {ZONES_SQL}, h AS {INSIDE_SQL}, u AS (SELECT f.*, (SELECT arg_max(h.zone, h.kind * 100 - h.rank) FROM h WHERE h.id = f.id) AS zone,
  (SELECT max(h.kind) FROM h WHERE h.id = f.id) AS kind FROM fixes f),
r AS (SELECT *, coalesce(2e0 + kind, 1.5e0) AS lim, NOT at_dock AND coalesce(nav_status IN (0, 15, 1, 5), TRUE) AS ok FROM u),
l AS (SELECT *, lead(t) OVER w AS nt, last_value(zone) OVER x AS lz, last_value(lim) OVER x AS ll FROM r WINDOW w AS (PARTITION BY mmsi ORDER BY t),
  x AS (PARTITION BY mmsi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, max(CASE WHEN NOT (ok AND speed < lim) OR coalesce(nt - t > 90, FALSE) OR zone IS DISTINCT FROM lz OR lim <> ll THEN t
  ELSE -1 END) OVER (PARTITION BY mmsi) AS brk FROM l), tail AS (SELECT * FROM m WHERE t > brk),
i AS (SELECT *, sum(CASE WHEN speed > 0.5e0 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM tail),
d AS (SELECT mmsi, t, island, {HAVERSINE_SQL.format(lon1="flon", lat1="flat", lon2="lon", lat2="lat")} AS drift FROM (SELECT *,
  first_value(lon) OVER (PARTITION BY mmsi, island ORDER BY t) AS flon, first_value(lat) OVER (PARTITION BY mmsi, island ORDER BY t) AS flat FROM i
  WHERE speed <= 0.5e0)),
s AS (SELECT mmsi, max(b) AS stopped FROM (SELECT mmsi, island, max(t) AS b FROM d GROUP BY 1, 2 HAVING max(t) - min(t) >= 60 AND max(drift) <= 80)
  GROUP BY mmsi)
SELECT tail.mmsi, tail.zone, count(*) AS n_points, max(t) - min(t) AS duration, max(v) AS max_v FROM tail LEFT JOIN s ON s.mmsi = tail.mmsi
  WHERE stopped IS NULL OR t > stopped GROUP BY tail.mmsi, tail.zone HAVING count(*) >= 2 AND max(t) - min(t) >= 60""")
def low_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    z = zones(spark, sf_dir)
    hits = spatial.in_zones(f.select("id", "lon", "lat"), z, CELL).groupBy("id").agg(F.min_by("zone", F.struct(-F.col("kind"), F.col("rank"))).alias("zone"), (F.max("kind") + 2.0).alias("zone_limit"))
    ok = ~F.col("at_dock") & F.coalesce(F.col("nav_status").isin(0, 15, 1, 5), F.lit(True))
    cfg = detectors.LowSpeedConfig(still_seconds=60.0, still_drift=80.0, min_points=2, min_seconds=60.0)
    found = detectors.low_speed(f.join(hits, "id", "left").withColumn("eligible", ok), cfg)
    return found.select("mmsi", "zone", "n_points", "duration", F.round(F.col("max_speed") * 4000).cast("long").alias("max_v"))


@query(f"""WITH {_BEHAVIOR_SQL.removeprefix("WITH ")}, k AS (SELECT i.id, arg_min(i.zone, i.rank) AS place FROM {INSIDE_SQL} i GROUP BY i.id), a AS (SELECT f.*,
  k.place FROM fixes f JOIN b ON b.mmsi = f.mmsi AND b.behavior IN ('anchoring', 'staying') AND b.points >= 3 AND b.radius <= 250 LEFT
  JOIN k ON k.id = f.id),
o AS (SELECT *, lead(t) OVER w AS nxt, last_value(place) OVER x AS lp FROM a WINDOW w AS (PARTITION BY mmsi ORDER BY t), x AS (PARTITION BY mmsi
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, max(CASE WHEN NOT speed <= 1 OR place IS NULL OR place IS DISTINCT FROM lp OR coalesce(nxt - t > 300, FALSE) THEN t
  ELSE -1 END) OVER (PARTITION BY mmsi) AS brk2 FROM o)
SELECT mmsi, place, count(*) AS n_points, min(t) AS since, max(t) - min(t) AS duration FROM u WHERE t > brk2 GROUP BY mmsi, place
  HAVING count(*) >= 3 AND max(t) - min(t) >= 120""")
def illegal_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored or staying in one place: the trimming that illegal anchoring and staying share."""
    cfg = detectors.StayConfig(max_speed=1.0, min_seconds=120.0)
    return detectors.stay_in(_in_place(spark, sf_dir, "place"), _behavior(spark, sf_dir), ("anchoring", "staying"), ("place",), cfg)


def _in_place(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixes with the first zone that holds them."""
    f = fixes(spark, sf_dir)
    place = spatial.in_zones(f.select("id", "lon", "lat"), zones(spark, sf_dir), CELL).groupBy("id").agg(F.min_by("zone", "rank").alias(name))
    return f.join(place, "id", "left")


_STAY_RUN_SQL = """, o AS (SELECT *, lead(t) OVER w AS nxt, last_value(place) OVER x AS lp, last_value(state) OVER x AS ls, last_value(lon) OVER x AS llon2,
  last_value(lat) OVER x AS llat2 FROM a WINDOW w AS (PARTITION BY mmsi ORDER BY t), x AS (PARTITION BY mmsi
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, max(CASE WHEN NOT speed <= 1 OR {null} IS NULL OR place IS DISTINCT FROM lp OR state IS DISTINCT FROM ls OR coalesce(nxt - t > 300,
  FALSE) {far} THEN t ELSE -1 END) OVER (PARTITION BY mmsi) AS brk2 FROM o)"""
_PLACE_SQL = f"k AS (SELECT i.id, arg_min(i.zone, i.rank) AS place, CASE WHEN bool_or(i.kind = 0) THEN 'prohibited' WHEN bool_or(i.kind IN (1, 2)) THEN 'authorized' ELSE 'covered' END AS state, bool_or(i.kind = 3) AS in_port FROM {INSIDE_SQL} i GROUP BY i.id)"


@query(f"""WITH {_BEHAVIOR_SQL.removeprefix("WITH ")}, {_PLACE_SQL}, a AS (SELECT f.*, k.place, CASE WHEN k.state = 'authorized' THEN NULL
  ELSE k.state END AS state FROM fixes f JOIN b ON b.mmsi = f.mmsi AND b.behavior = 'anchoring' AND b.points >= 3 AND b.radius <= 250 LEFT
  JOIN k ON k.id = f.id WHERE NOT f.at_dock AND NOT (coalesce(k.in_port, FALSE) AND k.state <> 'prohibited'))
{_STAY_RUN_SQL.format(null="state", far="")}
SELECT mmsi, state, place, count(*) AS n_points, max(t) - min(t) AS duration, CASE WHEN state = 'prohibited' THEN 'high' ELSE 'medium' END AS risk
  FROM u WHERE t > brk2 GROUP BY mmsi, state, place HAVING count(*) >= 2 AND max(t) - min(t) >= 60""")
def anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored outside authorised areas; the state of a fix follows from the kinds of its zones."""
    f = fixes(spark, sf_dir)
    kind = F.col("kind")
    state = F.when(F.max(kind == 0), "prohibited").when(F.max(kind.isin(1, 2)), "authorized").otherwise("covered")
    placed = spatial.in_zones(f.select("id", "lon", "lat"), zones(spark, sf_dir), CELL).groupBy("id").agg(F.min_by("zone", "rank").alias("place"), state.alias("state"), F.max(kind == 3).alias("in_port"))
    states = f.join(placed, "id", "left").withColumn("state", F.coalesce("state", F.lit("outside")))
    cfg = detectors.StayConfig(max_speed=1.0, min_points=2, min_seconds=60.0)
    found = detectors.anchoring(states, _behavior(spark, sf_dir).filter("points >= 3"), cfg)
    return found.select("mmsi", "state", "place", "n_points", "duration", "risk")


@query(f"""WITH {_BEHAVIOR_SQL.removeprefix("WITH ")}, {_PLACE_SQL}, a AS (SELECT f.*, k.place, 1 AS state FROM fixes f JOIN b ON b.mmsi = f.mmsi
  AND b.behavior IN ('anchoring', 'staying') AND b.points >= 2 AND b.radius <= 250 LEFT JOIN k ON k.id = f.id)
{_STAY_RUN_SQL.format(null="place", far="OR NOT " + HAVERSINE_SQL.format(lon1="lon", lat1="lat", lon2="llon2", lat2="llat2") + " <= 120")}
SELECT mmsi, place AS area, count(*) AS n_points, min(t) AS since, max(t) - min(t) AS duration FROM u WHERE t > brk2 GROUP BY mmsi, place
  HAVING count(*) >= 2 AND max(t) - min(t) >= 60""")
def staying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staying or anchored in a forbidden area."""
    cfg = detectors.StayConfig(max_speed=1.0, max_drift=120.0, min_points=2, min_seconds=60.0)
    return detectors.staying(_in_place(spark, sf_dir, "area"), _behavior(spark, sf_dir), cfg)


@query(f"""WITH {_BEHAVIOR_SQL.removeprefix("WITH ")}, f2 AS (SELECT mmsi, arg_max(id, t) % 3 <> 0 AS near_facility, arg_max(id, t) % 4 = 0 AS authorised
  FROM fixes GROUP BY mmsi),
moor AS (SELECT *, lead(t) OVER (PARTITION BY mmsi ORDER BY t) AS nt2 FROM fixes), moor2 AS (SELECT *, max(CASE WHEN NOT coalesce(nav_status = 5,
  FALSE) OR coalesce(nt2 - t > 1200, FALSE) THEN t ELSE -1 END) OVER (PARTITION BY mmsi) AS last5 FROM moor)
SELECT b.mmsi, 'berthed' AS reason FROM b JOIN f2 ON f2.mmsi = b.mmsi WHERE b.behavior = 'berthing' AND points >= 3 AND duration >= 60
  AND mean_speed <= 0.9e0 AND radius <= 250 AND near_facility AND NOT authorised
UNION ALL SELECT mmsi, 'moored under way' AS reason FROM moor2 WHERE t > last5 GROUP BY mmsi HAVING count(*) >= 2 AND max(t) - min(t) >= 60
  AND avg(speed) >= 0.5e0""")
def parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Berthed too long where it is not allowed, or sailing while 'moored'."""
    f = fixes(spark, sf_dir)
    latest = sequence.latest(f).select("mmsi", (F.col("id") % 3 != 0).alias("near_facility"), (F.col("id") % 4 == 0).alias("authorised"))
    sails = behavior.moored_underway(f, min_points=2, min_seconds=60.0, min_speed=0.5, min_path=0.0)
    return detectors.parking(_behavior(spark, sf_dir), latest, sails, min_seconds=60.0, max_speed=0.9, max_radius=250.0)


_MOORED_SQL = tail_sql(WALK_SQL, "nav_status = 5", 1200, columns="mmsi, count(*) AS n, max(t) - min(t) AS duration, avg(speed) AS s, min(t) AS a")


@query(f"SELECT mmsi, n AS n_points, duration FROM ({_MOORED_SQL}) WHERE n >= 2 AND duration >= 60 AND s >= 0.5e0")
def moored_underway(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = behavior.moored_underway(walk(spark, sf_dir), min_points=2, min_seconds=60.0, min_speed=0.5, min_path=0.0)
    return found.select("mmsi", "n_points", "duration")


@query(f"""WITH RECURSIVE {WALK_SQL}, l AS (SELECT mmsi // 2 AS pair, list(t ORDER BY t) AS la FROM fixes WHERE mmsi % 2 = 0 GROUP BY 1), r AS
  (SELECT mmsi // 2 AS pair, list(t + 20 + id % 5 * 15 ORDER BY t + 20 + id % 5 * 15) AS lb FROM fixes WHERE mmsi % 2 = 1 GROUP BY 1),
p AS (SELECT pair, la, lb, 1 AS i, 1 AS j, CAST(NULL AS BIGINT) AS t_a, CAST(NULL AS BIGINT) AS t_b FROM l JOIN r USING (pair) UNION ALL
  SELECT pair, la, lb, CASE WHEN abs(d) <= 45 OR d < 0 THEN i + 1 ELSE i END, CASE WHEN abs(d) <= 45 OR d > 0 THEN j + 1 ELSE j END, CASE
  WHEN abs(d) <= 45 THEN la[i] END, CASE WHEN abs(d) <= 45 THEN lb[j] END FROM (SELECT *, la[i] - lb[j] AS d FROM p WHERE i <= len(la)
  AND j <= len(lb)))
SELECT pair, t_a, t_b FROM p WHERE t_a IS NOT NULL""")
def double_drag_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of the samples of two vessels' tracks."""
    w = walk(spark, sf_dir)
    pair = F.floor(F.col("mmsi") / 2).alias("pair")
    odd = w.filter("mmsi % 2 = 1").select(pair, (F.col("t") + 20 + F.col("id") % 5 * 15).alias("t"))
    return temporal.align(w.filter("mmsi % 2 = 0").select(pair, "t"), odd, ["pair"], 45)


@query(f"""WITH {WALK_SQL}, p AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.t, a.speed AS sa, b.speed AS sb, a.course AS ca, b.course AS cb,
  {distance_sql("a", "b")} AS d FROM fixes a JOIN fixes b ON b.mmsi = a.mmsi + 10 AND b.t = a.t)
SELECT mmsi_a, mmsi_b, count(*) AS n_points, max(t) - min(t) AS duration, round(avg(d), 3) AS mean_distance, round(coalesce(stddev_samp(d), 0),
  3) AS std_distance, {R.format("count(*) FILTER (d BETWEEN 100 AND 2000) / count(*)")} AS in_range,
  {R.format("count(*) FILTER (least(abs(ca - cb) % 360, 360 - abs(ca - cb) % 360) <= 20) / count(*)")} AS same_course,
  {R.format("count(*) FILTER (abs(sa - sb) <= 1.5e0) / count(*)")} AS same_speed, {R.format("corr(sa, sb)")} AS speed_correlation FROM p
  GROUP BY mmsi_a, mmsi_b""")
def double_drag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = walk(spark, sf_dir)
    columns = ("lon", "lat", "speed", "course")
    a = w.select((F.col("mmsi") + 10).alias("mmsi_b"), F.col("mmsi").alias("mmsi_a"), "t", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = w.select(F.col("mmsi").alias("mmsi_b"), "t", *(F.col(c).alias(f"{c}_b") for c in columns))
    f = tracks.pair_features(a.join(b, ["mmsi_b", "t"]), ["mmsi_a", "mmsi_b"])
    return f.select("mmsi_a", "mmsi_b", "n_points", "duration", F.round("mean_distance", 3).alias("mean_distance"), F.round("std_distance", 3).alias("std_distance"), *(rounded(F.col(c)).alias(c) for c in ("in_range", "same_course", "same_speed", "speed_correlation")))


@query()
def double_dragging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detector. Every vessel tows: its partner is the same track two hundred metres to the north; parts have oracles."""
    w = walk(spark, sf_dir).withColumn("course", F.lit(90.0))
    partner = w.withColumns({"mmsi": F.col("mmsi") + 1_000_000, "lat": F.col("lat") + 0.0018, "t": F.col("t") + 10})
    cfg = detectors.DraggingConfig(slow=0.0, fast=20.0, min_points=5, min_seconds=120.0, far=400.0, margin=0.0)
    return detectors.double_dragging(w.unionByName(partner), cfg)


@query(f"""WITH {WALK_SQL}, routes AS (SELECT avg(lon) AS lon, avg(lat) AS lat FROM fixes GROUP BY floor(lon / 0.002e0), floor(lat / 0.002e0) HAVING count(*) >= 20),
e AS (SELECT mmsi, t, lon, lat, lead(t) OVER (PARTITION BY mmsi ORDER BY t) AS nt FROM fixes WHERE NOT at_dock),
l AS (SELECT *, max(CASE WHEN nt - t > 400 THEN t ELSE -1 END) OVER (PARTITION BY mmsi) AS brk FROM e), run AS (SELECT * FROM l WHERE t > brk),
ends AS (SELECT mmsi, count(*) AS n, max(t) - min(t) AS seconds, arg_min(lon, t) AS lon_a, arg_min(lat, t) AS lat_a, arg_max(lon, t) AS lon_b, arg_max(lat, t) AS lat_b FROM run GROUP BY mmsi),
able AS (SELECT mmsi FROM ends p WHERE n >= 3 AND seconds >= 120 AND {distance_sql("p", "p", "_a", "_b")} >= 50),
near AS (SELECT f.mmsi, f.t, least(min({distance_sql("f", "r")}), 2000) AS d FROM run f JOIN able USING (mmsi) CROSS JOIN routes r GROUP BY f.mmsi, f.t),
s AS (SELECT *, bool_or(d <= 60) OVER (PARTITION BY mmsi ORDER BY t) AS seen FROM near),
a AS (SELECT *, max(CASE WHEN NOT (seen AND d >= 120) THEN t ELSE -1 END) OVER (PARTITION BY mmsi) AS kept FROM s)
SELECT mmsi, count(*) AS n_points, min(t) AS off_since, max(t) - min(t) AS off_seconds, round(arg_max(d, t), 3) AS distance, CASE WHEN arg_max(d, t) >= 400 THEN 'high' ELSE 'to verify' END AS risk
  FROM a WHERE t > kept GROUP BY mmsi HAVING count(*) >= 2""")
def deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaving the routes of a grid learned from the same table; each fix is judged by the nearest route point."""
    w = walk(spark, sf_dir)
    cfg = detectors.DeviationConfig(min_speed=0.0, max_gap=400.0, min_points=3, min_displacement=50.0, on_route=60.0, off_route=120.0, high=400.0, off_points=2, off_seconds=0.0, min_coherence=2.0)
    found = detectors.deviation(w.withColumn("eligible", ~F.col("at_dock")), spatial.route_grid(w, 0.002, 20), cfg, 2000.0)
    return found.select("mmsi", "n_points", "off_since", "off_seconds", F.round("distance", 3).alias("distance"), "risk")


@query()
def wandering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-and-forth segments; the folds inside are tested against plain loops."""
    cfg = detectors.WanderingConfig(min_points=5, min_seconds=600.0, min_path=100.0)
    return detectors.wandering(walk(spark, sf_dir), cfg)


_VOYAGES_SQL = f"""{WALK_SQL}, {ZONES_SQL}, oz AS (SELECT i.id, min(i.zone) AS origin FROM {INSIDE_SQL} i GROUP BY i.id),
f1 AS (SELECT f.mmsi, t, f.speed * 4 AS speed, CAST(50 + f.id % 8 AS DOUBLE) / 10 AS draught, f.length / 3 AS length, nav_status, at_dock, CASE
  WHEN f.id % 6 = 0 THEN 'HKG' ELSE 'CHN' END AS iso3, origin, f.id % 4 > 0 AS near_coast, f.id % 29 = 0 AS near_port FROM fixes f LEFT
  JOIN oz ON oz.id = f.id),
f2 AS (SELECT *, t - lag(t) OVER w AS gap, lag(origin) OVER w AS was FROM f1 WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
f3 AS (SELECT *, sum(CASE WHEN CASE WHEN origin IS NOT NULL THEN origin IS DISTINCT FROM was OR coalesce(gap > 180, TRUE) ELSE was IS NOT NULL
  OR gap IS NULL END THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f2),
f4 AS (SELECT *, row_number() OVER x AS nth, min(t) OVER x AS began, max(speed) OVER x AS fast, first_value(draught) OVER x AS base FROM f3
  WINDOW x AS (PARTITION BY mmsi, run ORDER BY t ROWS UNBOUNDED PRECEDING)),
f5 AS (SELECT *, last_value(CASE WHEN origin IS NOT NULL THEN {{'origin': origin, 'sure': nth >= 2 AND t - began >= 60, 'fast': fast, 'base': base}}
  END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stay FROM f4),
f6 AS (SELECT *, nth > 1 AND near_coast AS near, nth > 1 AND near_coast AND (speed <= 1.5e0 OR at_dock OR coalesce(nav_status IN (1, 5),
  FALSE)) AS lands FROM f5 WHERE origin IS NULL AND stay IS NOT NULL AND stay.sure),
f7 AS (SELECT *, max(CASE WHEN nth > 1 AND (near_port OR t - began > 43200) THEN 1 ELSE 0 END) OVER x AS ended, sum(CASE WHEN lands THEN 0
  ELSE 1 END) OVER x AS brk, max(CASE WHEN nth > 1 THEN gap END) OVER x AS max_gap,
  max(CASE WHEN nth > 1 THEN abs(draught - stay.base) END) OVER x AS change FROM f6 WINDOW x AS (PARTITION BY mmsi, run
  ORDER BY t ROWS UNBOUNDED PRECEDING)),
f8 AS (SELECT *, lands AND t - min(CASE WHEN lands THEN t END) OVER y >= 60 AND count(*) FILTER (lands) OVER y >= 2 AS landed FROM f7
  WINDOW y AS (PARTITION BY mmsi, run, brk ORDER BY t ROWS UNBOUNDED PRECEDING)),
f9 AS (SELECT mmsi, t, stay.origin AS origin, began AS departed_at, least(100, 40 + CASE WHEN (began + 28800) % 86400 // 3600 >= 20
  OR (began + 28800) % 86400 // 3600 < 6 THEN 15 ELSE 0 END + CASE WHEN landed THEN 20 ELSE 0 END + CASE WHEN at_dock THEN 15 ELSE 0 END
  + CASE WHEN max_gap > 180 THEN 15 ELSE 0 END + CASE WHEN change >= 0.5e0 THEN 15 ELSE 0 END + CASE WHEN iso3 = 'HKG' THEN 10 ELSE 0 END + CASE
  WHEN length <= 50 AND greatest(fast, stay.fast) >= 15 THEN 10 ELSE 0 END) AS score FROM f8 WHERE near AND ended = 0)"""


def _voyage_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with what the detector needs; zones are origins, and the ids say where the shore and ports are."""
    f = walk(spark, sf_dir)
    origin = spatial.in_zones(f.select("id", "lon", "lat"), zones(spark, sf_dir), CELL).groupBy("id").agg(F.min("zone").alias("origin"))
    k = F.col("id")
    return f.join(origin, "id", "left").select(
        "mmsi", "t", (F.col("speed") * 4).alias("speed"), ((k % 8 + 50).cast("double") / 10).alias("draught"), (F.col("length") / 3).alias("length"), "nav_status", "at_dock",
        F.when(k % 6 == 0, "HKG").otherwise("CHN").alias("iso3"), F.lit(None).cast("string").alias("flag"), "origin", (k % 4 > 0).alias("near_coast"), (k % 29 == 0).alias("near_port"),
    )


_VOYAGE = detectors.SmugglingConfig(stay_fixes=2, landing_seconds=60.0, landing_fixes=2)


@query(f"WITH {_VOYAGES_SQL} SELECT mmsi, t, origin, departed_at, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS risk FROM f9")
def smuggling_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every fix near the shore, from the facts of its voyage so far."""
    scored = detectors.smuggling_risk(detectors.voyages(_voyage_fixes(spark, sf_dir), _VOYAGE))
    return scored.select("mmsi", "t", "origin", "departed_at", "score", "risk")


@query(f"""WITH {_VOYAGES_SQL} SELECT mmsi, departed_at, any_value(origin) AS origin, count(*) AS n_shore, 0 AS n_authorized, min(t) AS first_shore, max(t) AS last_shore,
  max(score) AS score, arg_max(t, score * 1000000 - t) AS scored_at,
  CASE WHEN max(score) >= 80 THEN 'high' WHEN max(score) >= 60 THEN 'medium' ELSE 'low' END AS risk FROM f9 GROUP BY mmsi, departed_at""")
def smuggling_voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voyages from an origin stay to the shore, with their highest score."""
    return detectors.smuggling(_voyage_fixes(spark, sf_dir), _VOYAGE)


@query(f"""WITH {_VOYAGES_SQL}, ports AS (SELECT mmsi, t, CASE WHEN id % 3 > 0 THEN 'P' || id % 3 END AS port FROM fixes),
permits AS (SELECT c_custkey AS permit_id, CAST(412000000 + c_custkey % 150 AS BIGINT) AS mmsi, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS origin, CASE WHEN c_custkey % 3 > 0 THEN 'P' || c_custkey % 3 END AS port,
  c_custkey % 7 * 300 AS valid_from, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 * 300 + 1500 END AS valid_until FROM customer JOIN nation ON n_nationkey = c_custkey % 25 WHERE c_custkey % 4 = 0),
j AS (SELECT f9.*, p.permit_id, row_number() OVER (PARTITION BY f9.mmsi, f9.t ORDER BY CAST(p.origin IS NOT NULL AS INT) + CAST(p.port IS NOT NULL AS INT) DESC, p.origin IS NOT NULL DESC, p.permit_id) AS nth
  FROM f9 JOIN ports ON ports.mmsi = f9.mmsi AND ports.t = f9.t LEFT JOIN permits p ON p.mmsi = f9.mmsi AND (p.origin IS NULL OR p.origin = f9.origin) AND (p.port IS NULL OR p.port = ports.port)
  AND f9.t >= p.valid_from AND (p.valid_until IS NULL OR f9.t <= p.valid_until))
SELECT mmsi, departed_at, any_value(origin) AS origin, count(*) FILTER (permit_id IS NULL) AS n_shore, count(permit_id) AS n_authorized, min(t) FILTER (permit_id IS NULL) AS first_shore,
  max(score) FILTER (permit_id IS NULL) AS score FROM j WHERE nth = 1 GROUP BY mmsi, departed_at HAVING count(*) FILTER (permit_id IS NULL) > 0""")
def permitted_voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voyages to the shore whose fixes no permit covers; permits may leave open the origin and the port."""
    k, text = F.col("c_custkey"), lambda n: F.when(n % 3 > 0, F.concat(F.lit("P"), (n % 3).cast("string")))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_n"), "n_name")
    permits = read(spark, sf_dir, "customer").filter(k % 4 == 0).withColumn("_n", k % 25).join(names, "_n").select(
        k.alias("permit_id"), (F.lit(412000000) + k % 150).cast("long").alias("mmsi"), F.when(k % 2 == 0, F.col("n_name")).alias("origin"), text(k).alias("port"), (k % 7 * 300).alias("valid_from"), F.when(k % 5 > 0, k % 7 * 300 + 1500).alias("valid_until"),
    )
    ports = walk(spark, sf_dir).select("mmsi", "t", text(F.col("id")).alias("port"))
    found = detectors.smuggling(_voyage_fixes(spark, sf_dir).join(ports, ["mmsi", "t"]), _VOYAGE, permits)
    return found.select("mmsi", "departed_at", "origin", "n_shore", "n_authorized", "first_shore", "score")


@query(f"""WITH {FIXES_SQL}, s AS (SELECT mmsi, t, CASE WHEN id % 5 = 0 THEN CASE WHEN v > 2000 THEN 'overload' ELSE 'normal' END WHEN v > 3000 THEN 'overload'
  ELSE 'normal' END AS state FROM fixes), l AS (SELECT *, lag(state) OVER (PARTITION BY mmsi ORDER BY t) AS p FROM s),
r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT mmsi, t, state FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, run ORDER BY t) AS nth FROM r) WHERE nth = 3""")
def overload_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a camera that sees a load line in most frames, and in the others the vessel or nothing."""
    f = fixes(spark, sf_dir).select(F.col("mmsi").alias("camera"), F.col("t").alias("frame"), "id", "v")
    lines = f.filter("id % 5 <> 0").select("camera", "frame", F.lit("load_line").alias("kind"), F.when(F.col("v") > 3000, 1).otherwise(0).alias("class_id"), F.lit(0.9).alias("confidence"))
    hulls = f.select("camera", "frame", F.when((F.col("id") % 5 == 0) & (F.col("v") <= 2000), "other").otherwise("vessel").alias("kind"), F.lit(0).alias("class_id"), F.lit(0.8).alias("confidence"))
    found = events.confirmed(detectors.overload_state(lines.unionByName(hulls)), ["camera"], "state", "frame", 3)
    return found.select(F.col("camera").alias("mmsi"), F.col("frame").alias("t"), "state")
