"""Queries on single records and on each vessel's sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, records
from ..operators import behavior, events, folds, sequence, temporal, tracks
from .catalogue import query
from .tables import FIXES_SQL, HAVERSINE_SQL, WALK_SQL, R, distance_sql, fixes, read, rounded, walk


@query("""
SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(412000000 + user_id AS VARCHAR) END AS mmsi,
  CASE WHEN sp BETWEEN 0 AND 102.2e0 THEN sp END AS speed, CASE WHEN co >= 0 AND co < 360 THEN co END AS course, CASE
  WHEN rot <> -128 THEN rot END AS rot,
  concat_ws(',', CASE WHEN sp BETWEEN 0 AND 102.2e0 THEN NULL ELSE 'speed_unavailable' END, CASE WHEN co >= 0 AND co < 360 THEN NULL
  ELSE 'course_unavailable' END, 'heading_unavailable', CASE WHEN rot <> -128 THEN NULL ELSE 'rot_unavailable' END) AS flags
FROM (SELECT *, value / 4 AS sp, CAST((event_id * 37) % 400 AS DOUBLE) AS co, CAST((event_id % 300) - 150 AS DOUBLE) AS rot FROM events)
  WHERE event_id % 11 <> 0""")
def normalize_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = read(spark, sf_dir, "events").select(
        e.alias("id"), F.when(e % 11 == 0, "41").otherwise((F.lit(412000000) + F.col("user_id")).cast("string")).alias("mmsi"), F.lit(113.5).alias("lon"), F.lit(22.0).alias("lat"),
        (F.col("value") / 4).cast("string").alias("speed"), ((e * 37) % 400).cast("string").alias("course"), F.lit("NaN").alias("heading"), (e % 300 - 150).cast("string").alias("rot"),
    )
    return records.normalise(raw).select("id", "mmsi", "speed", "course", "rot", F.array_join("quality_flags", ",").alias("flags"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN m IN (1,2,3,18,19,27) THEN 'dynamic' WHEN m IN (5,24) THEN 'static' WHEN m IS NULL
  AND event_id % 2 = 0 THEN 'dynamic' ELSE 'unsupported' END AS kind
  FROM (SELECT event_id, CASE WHEN event_id % 30 < 28 THEN event_id % 30 END AS m FROM events)) GROUP BY kind""")
def classify_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = read(spark, sf_dir, "events").select(F.when(e % 30 < 28, e % 30).alias("m"), F.when(e % 2 == 0, F.lit(113.0)).alias("lon"), F.lit(22.0).alias("lat"))
    return raw.groupBy(records.message_kind(F.col("m"), F.col("lon"), F.col("lat")).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT name, count(*) AS n, sum(chinese) AS chinese FROM (SELECT CASE WHEN lower(trim(raw)) IN ('', 'nan', 'n/a') OR raw IS NULL THEN '未知目标'
  ELSE trim(raw) END AS name,
  CASE WHEN substr(CAST(m AS VARCHAR), 1, 3) IN ('412', '413', '414') THEN 1 ELSE 0 END AS chinese
  FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE ' ' || c_mktsegment || ' ' END AS raw,
  411000000 + c_custkey % 5 * 1000000 AS m FROM customer)) GROUP BY name""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, " NaN ").when(k % 5 == 1, "n/a").when(k % 5 == 2, "").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    home = records.registry((F.lit(411000000) + k % 5 * 1000000).cast("string")) == "chinese"
    return read(spark, sf_dir, "customer").select(records.clean_name(raw).alias("name"), home.alias("home")).groupBy("name").agg(F.count("*").alias("n"), F.count_if("home").alias("chinese"))


@query(f"WITH {FIXES_SQL} SELECT mmsi, id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, id DESC) AS rn FROM fixes) WHERE rn = 1")
def latest_per_vessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.latest(fixes(spark, sf_dir), tie="id").select("mmsi", "id", "t", "v")


@query(f"WITH {FIXES_SQL} SELECT mmsi, id, bucket FROM (SELECT *, t // 600 AS bucket, row_number() OVER (PARTITION BY mmsi ORDER BY t // 600 DESC, id ASC) AS rn FROM fixes) WHERE rn = 1")
def latest_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = fixes(spark, sf_dir).withColumn("bucket", F.floor(F.col("t") / 600).cast("long"))
    return sequence.latest(coarse, order="bucket", tie="id", last_wins=False).select("mmsi", "id", "bucket")


@query(f"WITH {FIXES_SQL}, l AS (SELECT mmsi, max(t) AS latest FROM fixes GROUP BY mmsi) SELECT f.mmsi, count(*) AS n FROM fixes f JOIN l USING (mmsi) WHERE (SELECT max(t) FROM fixes) - latest <= 600 GROUP BY f.mmsi")
def fresh_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fresh(fixes(spark, sf_dir), 600).groupBy("mmsi").agg(F.count("*").alias("n"))


@query(f"""WITH {FIXES_SQL} SELECT id, last_value(CASE WHEN nav_status = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY mmsi
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS static_id,
  last_value(CASE WHEN nav_status = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS static_t FROM fixes""")
def static_enrich_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    static = f.filter("nav_status = 1").select("mmsi", "t", F.col("id").alias("static_id"))
    return temporal.as_of(f.select("mmsi", "t", "id"), static, ["mmsi"], ["static_id"]).select("id", F.col("as_of_static_id").alias("static_id"), F.col("as_of_t").alias("static_t"))


_STATES = "SELECT mmsi, v // 100 AS v FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC) AS rn FROM fixes WHERE t <= {}) WHERE rn = 1"


@query(f"""WITH {FIXES_SQL}, o AS ({_STATES.format("3000 AND mmsi % 13 <> 1")}), n AS ({_STATES.format("3060 AND mmsi % 13 <> 2")})
SELECT coalesce(n.mmsi, o.mmsi) AS mmsi, CASE WHEN n.mmsi IS NULL THEN 'remove' ELSE 'upsert' END AS change, n.v AS v FROM o FULL
  JOIN n ON o.mmsi = n.mmsi WHERE o.v IS DISTINCT FROM n.v""")
def state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    state = lambda until, left_out: sequence.latest(f.filter((F.col("t") <= until) & (F.col("mmsi") % 13 != left_out))).select("mmsi", F.floor(F.col("v") / 100).cast("long").alias("v"))
    return events.changes(state(3000, 1), state(3060, 2), "mmsi")


@query(f"""WITH {FIXES_SQL}, b AS (SELECT mmsi, t // 120 * 120 AS t, max(id) AS id FROM fixes GROUP BY 1, 2), w AS (SELECT *,
  max(t) OVER (PARTITION BY mmsi) AS newest, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC) AS rn FROM b)
SELECT mmsi, t, id FROM w WHERE t >= newest - 1800 AND rn <= 10""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = fixes(spark, sf_dir).select("mmsi", (F.floor(F.col("t") / 120) * 120).cast("long").alias("t"), "id")
    return sequence.bounded_history(coarse, 1800, 10, "id")


@query(f"""WITH {FIXES_SQL}, s AS (SELECT mmsi, t, id FROM fixes WHERE t <= 3000), n AS (SELECT mmsi, t - CASE WHEN mmsi % 3 = 0 THEN 6000 ELSE 0 END AS t, id FROM fixes WHERE t > 3000),
r AS (SELECT n.mmsi FROM (SELECT mmsi, max(t) AS a FROM n GROUP BY 1) n JOIN (SELECT mmsi, max(t) AS b FROM s GROUP BY 1) s USING (mmsi) WHERE a < b - 1800),
u AS (SELECT *, 0 AS age FROM s WHERE mmsi NOT IN (SELECT mmsi FROM r) UNION ALL SELECT *, 1 FROM n), o AS (SELECT mmsi, t, arg_max(id, age * 1000000000 + id) AS id FROM u GROUP BY 1, 2),
w AS (SELECT *, max(t) OVER (PARTITION BY mmsi) AS newest, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC) AS rn FROM o)
SELECT mmsi, t, id FROM w WHERE t >= newest - 1800 AND rn <= 20""")
def history_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch of reports, of which a third of the vessels begins again at an earlier time."""
    f = fixes(spark, sf_dir).select("mmsi", "t", "id")
    later = f.filter("t > 3000").withColumn("t", (F.col("t") - F.when(F.col("mmsi") % 3 == 0, 6000).otherwise(0)).cast("long"))
    return sequence.grown_history(f.filter("t <= 3000"), later, 1800, 20, "id")


def tail_sql(source: str, keeps: str, gap: float, extra: str = "", columns: str = "mmsi, count(*) AS n, max(t) - min(t) AS duration, sum(v) AS sum_v, max(v) AS max_v", where: str = "TRUE") -> str:
    return f"""WITH {source}, pool AS (SELECT * FROM fixes WHERE {where}),
l AS (SELECT *, lead(t) OVER (PARTITION BY mmsi ORDER BY t) AS nt, last_value(lon) OVER (PARTITION BY mmsi
  ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS llon,
  last_value(lat) OVER (PARTITION BY mmsi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS llat FROM pool),
m AS (SELECT *, CASE WHEN NOT coalesce({keeps}, FALSE) OR coalesce(nt - t > {gap}, FALSE) {extra} THEN t ELSE -1 END AS brk FROM l),
tail AS (SELECT * FROM (SELECT *, max(brk) OVER (PARTITION BY mmsi) AS last FROM m) WHERE t > last)
SELECT {columns} FROM tail GROUP BY mmsi"""


NEAR_LATEST_SQL = "OR NOT " + HAVERSINE_SQL.format(lon1="lon", lat1="lat", lon2="llon", lat2="llat") + " <= 250"


def _tail_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("mmsi").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"), F.sum("v").alias("sum_v"), F.max("v").alias("max_v"))


@query(tail_sql(FIXES_SQL, "speed <= 1", 90, NEAR_LATEST_SQL))
def tail_segment_low_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tail_summary(behavior.low_speed_tail(fixes(spark, sf_dir), behavior.BehaviorConfig(max_gap=90)))


@query(tail_sql(FIXES_SQL, "speed > 0.25", 90))
def tail_high_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tail_summary(sequence.tail(fixes(spark, sf_dir), F.col("speed") > 0.25, 90))


@query(tail_sql(FIXES_SQL, "nav_status = 5", 1200))
def tail_moored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tail_summary(sequence.tail(fixes(spark, sf_dir), F.col("nav_status") == 5, 1200))


@query(f"WITH {FIXES_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) > 180 THEN 1 ELSE 0 END AS b FROM fixes WHERE v > 1500), s AS (SELECT *, sum(b) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT mmsi, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY mmsi, session")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sessions(fixes(spark, sf_dir).filter("v > 1500"), 180).groupBy("mmsi", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH {WALK_SQL}, m AS (SELECT mmsi, avg(lon) AS mx, avg(lat) AS my FROM fixes GROUP BY mmsi),
c AS (SELECT f.mmsi, t, CAST(floor((lon - mx) * 111194.92664455874 * greatest(1e-6, cos(radians(my))) / 200) AS BIGINT) AS x,
  CAST(floor((lat - my) * 111194.92664455874 / 200) AS BIGINT) AS y FROM fixes f JOIN m USING (mmsi)),
e AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY mmsi ORDER BY t))
SELECT mmsi, count(*) AS n_visits, count(DISTINCT (x, y)) AS n_cells, {R.format("1 - count(DISTINCT (x, y)) / count(*)")} AS revisit_ratio FROM e
  WHERE x IS DISTINCT FROM px OR y IS DISTINCT FROM py GROUP BY mmsi""")
def revisit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.revisits(walk(spark, sf_dir), ["mmsi"]).withColumn("revisit_ratio", rounded(F.col("revisit_ratio")))


@query(f"WITH {WALK_SQL} SELECT a.mmsi, round(max({distance_sql('a', 'b')}), 3) AS diameter FROM fixes a JOIN fixes b ON a.mmsi = b.mmsi GROUP BY a.mmsi")
def track_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.diameter(walk(spark, sf_dir), ["mmsi"]).withColumn("diameter", F.round("diameter", 3))


@query(f"""WITH {WALK_SQL}, c AS (SELECT *, avg(lon) OVER (PARTITION BY mmsi) AS clon, avg(lat) OVER (PARTITION BY mmsi) AS clat,
  lag(lon) OVER (PARTITION BY mmsi ORDER BY t) AS plon, lag(lat) OVER (PARTITION BY mmsi ORDER BY t) AS plat FROM fixes)
SELECT mmsi, count(*) AS n_points, round(max({HAVERSINE_SQL.format(lon1="lon", lat1="lat", lon2="clon", lat2="clat")}), 3) AS radius,
  round(sum({HAVERSINE_SQL.format(lon1="plon", lat1="plat", lon2="lon", lat2="lat")}), 3) AS path,
  round({HAVERSINE_SQL.format(lon1="arg_min(lon, t)", lat1="arg_min(lat, t)", lon2="arg_max(lon, t)", lat2="arg_max(lat, t)")}, 3) AS displacement
  FROM c GROUP BY mmsi""")
def track_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.shape(walk(spark, sf_dir), ["mmsi"]).select("mmsi", "n_points", *(F.round(c, 3).alias(c) for c in ("radius", "path", "displacement")))


@query(f"""WITH {FIXES_SQL}, h AS (SELECT mmsi, t // 600 AS bucket, heading, lead(heading) OVER (PARTITION BY mmsi, t // 600 ORDER BY heading) AS nh,
  min(heading) OVER (PARTITION BY mmsi, t // 600) AS lo FROM fixes)
SELECT mmsi, bucket, count(*) AS n_headings, CASE WHEN count(*) >= 2 THEN 360 - max(coalesce(nh, lo + 360) - heading) END AS heading_arc FROM h
  GROUP BY mmsi, bucket""")
def heading_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.heading_summary(fixes(spark, sf_dir).withColumn("bucket", F.floor(F.col("t") / 600).cast("long")), ["mmsi", "bucket"])


@query(f"WITH {FIXES_SQL} SELECT mmsi, {R.format('count(*) FILTER (nav_status = 1) / count(*)')} AS anchored, {R.format('count(*) FILTER (nav_status = 5) / count(*)')} AS moored FROM fixes GROUP BY mmsi")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).groupBy("mmsi").agg(rounded(tracks.share(F.col("nav_status") == 1)).alias("anchored"), rounded(tracks.share(F.col("nav_status") == 5)).alias("moored"))


@query(f"WITH {FIXES_SQL}, c AS (SELECT mmsi, event_type, count(*) AS n, min(t) AS first FROM fixes GROUP BY 1, 2) SELECT mmsi, event_type FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, first, event_type) AS rn FROM c) WHERE rn = 1")
def commonest_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.most_frequent(fixes(spark, sf_dir), ["mmsi"], "event_type")


@query("SELECT quantile_cont(step, 0.5) AS median_step FROM (SELECT lead(t) OVER (ORDER BY t) - t AS step FROM (SELECT DISTINCT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events)) WHERE step IS NOT NULL")
def nominal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.nominal_interval(read(spark, sf_dir, "events").select(F.unix_timestamp(F.date_trunc("second", "ts")).alias("t")))


@query(f"""WITH RECURSIVE {WALK_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t) AS k FROM fixes),
f AS (SELECT mmsi, k, id, lon, lat, TRUE AS kept FROM o WHERE k = 1 UNION ALL
  SELECT q.mmsi, q.k, CASE WHEN d >= 60 THEN q.id ELSE q.fid END, CASE WHEN d >= 60 THEN q.lon ELSE q.flon END, CASE WHEN d >= 60 THEN q.lat
  ELSE q.flat END, d >= 60
  FROM (SELECT o.mmsi, o.k, o.id, o.lon, o.lat, f.id AS fid, f.lon AS flon, f.lat AS flat,
  {HAVERSINE_SQL.format(lon1="f.lon", lat1="f.lat", lon2="o.lon", lat2="o.lat")} AS d FROM f JOIN o ON o.mmsi = f.mmsi AND o.k = f.k + 1) q)
SELECT mmsi, id FROM f WHERE kept""")
def min_leg_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.thinned(walk(spark, sf_dir), 60.0, ["mmsi"]).select("mmsi", "id")


@query(f"""WITH RECURSIVE {WALK_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t) AS k FROM fixes),
f AS (SELECT mmsi, k, t, id, lon, lat, TRUE AS kept FROM o WHERE k = 1 UNION ALL
  SELECT q.mmsi, q.k, CASE WHEN y THEN q.t ELSE q.ft END, CASE WHEN y THEN q.id ELSE q.fid END, CASE WHEN y THEN q.lon ELSE q.flon END, CASE
  WHEN y THEN q.lat ELSE q.flat END, y
  FROM (SELECT o.mmsi, o.k, o.t, o.id, o.lon, o.lat, f.t AS ft, f.id AS fid, f.lon AS flon, f.lat AS flat,
  {HAVERSINE_SQL.format(lon1="f.lon", lat1="f.lat", lon2="o.lon", lat2="o.lat")} >= 70 OR o.t - f.t >= 180 AS y FROM f JOIN o ON o.mmsi = f.mmsi
  AND o.k = f.k + 1) q)
SELECT mmsi, id FROM f WHERE kept""")
def trajectory_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.samples(walk(spark, sf_dir), 70.0, 180.0, ["mmsi"]).select("mmsi", "id")


def _possible_sql(a: str, b: str) -> str:
    run = HAVERSINE_SQL.format(lon1=f"{a}.lon", lat1=f"{a}.lat", lon2=f"{b}.lon", lat2=f"{b}.lat")
    return f"({b}.t > {a}.t AND ({run} < 500 OR {run} / nullif({b}.t - {a}.t, 0) * 1.943844492e0 <= 80))"


_JUMP = "CASE WHEN id % 17 = 0 THEN lon + 0.5e0 ELSE lon END"


@query(f"""WITH RECURSIVE {WALK_SQL}, tracks AS (SELECT mmsi, list({{'t': t, 'lon': {_JUMP}, 'lat': lat, 'id': id}} ORDER BY t) AS p, count(*) AS n FROM fixes
  GROUP BY mmsi),
f AS (SELECT mmsi, p, n, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS sound, CAST(1 AS BIGINT) AS stayed, p[1].id AS id FROM tracks UNION ALL
  SELECT mmsi, p, n, k, CASE WHEN spike THEN sound ELSE k END, CASE WHEN stays THEN k ELSE stayed END, CASE WHEN stays THEN p[k].id END FROM
  (SELECT *, NOT spike AND (n < 3 OR {_possible_sql("p[stayed]", "p[k]")}) AS stays
    FROM (SELECT mmsi, p, n, i + 1 AS k, sound, stayed, i + 1 < n AND NOT {_possible_sql("p[sound]", "p[i + 1]")}
    AND NOT {_possible_sql("p[i + 1]", "p[i + 2]")} AND {_possible_sql("p[sound]", "p[i + 2]")} AS spike FROM f WHERE i < n)))
SELECT mmsi, id FROM f WHERE id IS NOT NULL""")
def jump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent: a spike depends on the last point that was none, and each point on the last that stayed."""
    spiked = walk(spark, sf_dir).withColumn("lon", F.when(F.col("id") % 17 == 0, F.col("lon") + 0.5).otherwise(F.col("lon")))
    return folds.without_jumps(spiked.select("mmsi", "t", "id", "lon", "lat"), ["mmsi"]).select("mmsi", "id")


@query(f"""WITH RECURSIVE {WALK_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t) AS k FROM fixes WHERE speed >= 0.5e0),
f AS (SELECT mmsi, k, t, course, TRUE AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.mmsi, o.k, CASE WHEN o.t - f.t >= 90 THEN o.t ELSE f.t END, CASE WHEN o.t - f.t >= 90 THEN o.course ELSE f.course END, o.t - f.t >= 90
  FROM f JOIN o ON o.mmsi = f.mmsi AND o.k = f.k + 1),
d AS (SELECT mmsi, abs(course - lag(course) OVER (PARTITION BY mmsi ORDER BY t)) % 360 AS d FROM f WHERE kept)
SELECT m.mmsi, count(*) FILTER (least(d, 360 - d) >= 30) AS n_turns FROM (SELECT DISTINCT mmsi FROM fixes) m LEFT JOIN d ON d.mmsi = m.mmsi
  GROUP BY m.mmsi""")
def turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns between samples at least ninety seconds apart."""
    return folds.turns(walk(spark, sf_dir), ["mmsi"], 30.0, 90.0, 0.5)


@query(f"""WITH RECURSIVE {FIXES_SQL}, o AS (SELECT mmsi, t AS a, t + v // 40 AS b, CASE WHEN id % 3 > 0 THEN id % 2 END AS e,
  row_number() OVER (PARTITION BY mmsi ORDER BY t) AS k FROM fixes),
f AS (SELECT mmsi, k, a, b, e, CAST(1 AS BIGINT) AS run FROM o WHERE k = 1 UNION ALL
  SELECT mmsi, k, a, CASE WHEN joins THEN greatest(fb, b) ELSE b END, CASE WHEN joins THEN coalesce(e, fe) ELSE e END, CASE WHEN joins THEN run
  ELSE run + 1 END
  FROM (SELECT o.*, f.b AS fb, f.e AS fe, f.run, o.a - f.b <= 60 AND (o.e IS NULL OR f.e IS NULL OR o.e = f.e) AS joins FROM f
  JOIN o ON o.mmsi = f.mmsi AND o.k = f.k + 1))
SELECT mmsi, min(a) AS group_start, max(b) AS group_end, count(*) AS n, max(e) AS episode FROM f GROUP BY mmsi, run""")
def event_merge_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that follow each other closely and name no two episodes become one."""
    f = fixes(spark, sf_dir)
    intervals = f.select("mmsi", F.col("t").alias("a"), (F.col("t") + F.floor(F.col("v") / 40)).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("e"))
    return folds.merged_episodes(intervals, "a", "b", "e", 60.0, ["mmsi"])


@query(f"""WITH {FIXES_SQL}, i AS (SELECT mmsi, t, CASE WHEN v <= 1000 THEN 0 ELSE 1 END AS off, t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) AS gap
  FROM fixes),
n AS (SELECT *, sum(CASE WHEN off = 1 OR gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT mmsi, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM n WHERE off = 0 GROUP BY mmsi, island""")
def slow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.islands(fixes(spark, sf_dir), F.col("v") <= 1000, 60).groupBy("mmsi", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).drop("island")


@query(f"""WITH {FIXES_SQL}, s AS (SELECT *, t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) AS gap FROM fixes WHERE v > 2000), n AS (SELECT *, sum(CASE
  WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT mmsi, min(t) AS first_seen, max(t) AS last_seen, count(*) AS observations, max(t) - min(t) AS duration FROM n GROUP BY mmsi, k
  HAVING count(*) >= 3""")
def contact_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.streaks(fixes(spark, sf_dir).filter("v > 2000"), 120, ("mmsi",)).filter("observations >= 3").drop("session")


@query(f"WITH {FIXES_SQL} SELECT mmsi, t, CAST(sum(CASE WHEN v // 1000 IS DISTINCT FROM p // 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM (SELECT *, lag(v) OVER (PARTITION BY mmsi ORDER BY t) AS p FROM fixes)")
def version_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = fixes(spark, sf_dir).withColumn("k", F.floor(F.col("v") / 1000))
    marked = coarse.withColumn("changed", ~F.col("k").eqNullSafe(F.lag("k").over(Window.partitionBy("mmsi").orderBy("t"))))
    return sequence.versions(marked, F.col("changed")).select("mmsi", "t", F.col("version").cast("long").alias("version"))


@query(f"""WITH {WALK_SQL}, l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t) OVER w AS pt, lag(speed) OVER w AS ps,
  lag(course) OVER w AS pc FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
d AS (SELECT *, plon + degrees(ps * 0.514444e0 * (t - pt) * sin(radians(pc)) / (6371000e0 * greatest(abs(cos(radians(plat))), 1e-9))) AS elon,
  plat + degrees(ps * 0.514444e0 * (t - pt) * cos(radians(pc)) / 6371000e0) AS elat FROM l WHERE pt IS NOT NULL)
SELECT id, round({HAVERSINE_SQL.format(lon1="elon", lat1="elat", lon2="lon", lat2="lat")}, 3) AS residual FROM d""")
def reckoning_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("mmsi").orderBy("t")
    lagged = walk(spark, sf_dir).withColumns({f"p_{c}": F.lag(c).over(w) for c in ("lon", "lat", "t", "speed", "course")}).filter("p_t is not null")
    lon, lat = geo.dead_reckon(F.col("p_lon"), F.col("p_lat"), F.col("p_speed"), F.col("p_course"), F.col("t") - F.col("p_t"))
    return lagged.select("id", F.round(geo.haversine(lon, lat, F.col("lon"), F.col("lat")), 3).alias("residual"))


@query(f"""WITH {FIXES_SQL}, given AS (SELECT mmsi % 10 AS scene, mmsi, t, lon, lat FROM fixes WHERE id % 4 > 0),
tm AS (SELECT scene, t, row_number() OVER (PARTITION BY scene ORDER BY t) - 1 AS n, count(*) OVER (PARTITION BY scene) AS total FROM (SELECT DISTINCT scene, t FROM given)),
w AS (SELECT scene, n // 3 AS k, n AS s FROM tm WHERE n % 3 = 0 AND n + 6 <= total), p AS (SELECT w.scene, w.k, tm.n - w.s AS place, tm.t FROM w JOIN tm ON tm.scene = w.scene AND tm.n BETWEEN w.s AND w.s + 5),
g AS (SELECT p.scene, p.k, mmsi FROM p JOIN given ON given.scene = p.scene AND given.t = p.t GROUP BY 1, 2, 3 HAVING count(*) >= 3),
a AS (SELECT p.scene, p.k, g.mmsi, p.place, p.t, given.lon, given.lat, CASE WHEN given.lon IS NOT NULL THEN place END AS here FROM p JOIN g ON g.scene = p.scene AND g.k = p.k LEFT JOIN given ON given.mmsi = g.mmsi AND given.t = p.t),
b AS (SELECT *, last_value(here IGNORE NULLS) OVER w AS pa, last_value(lon IGNORE NULLS) OVER w AS xa, last_value(lat IGNORE NULLS) OVER w AS ya, first_value(here IGNORE NULLS) OVER v AS pb,
  first_value(lon IGNORE NULLS) OVER v AS xb, first_value(lat IGNORE NULLS) OVER v AS yb FROM a WINDOW w AS (PARTITION BY scene, k, mmsi ORDER BY place ROWS UNBOUNDED PRECEDING),
  v AS (PARTITION BY scene, k, mmsi ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, CASE WHEN pb > pa THEN (place - pa) / (pb - pa) ELSE 0 END AS part FROM b)
SELECT scene, k AS "window", mmsi, CAST(place AS INT) AS place, t, {R.format("coalesce(xa + (xb - xa) * part, xa, xb)")} AS lon, {R.format("coalesce(ya + (yb - ya) * part, ya, yb)")} AS lat, here IS NOT NULL AS known FROM c""")
def window_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the vessels of a scene through windows of six report times, every third; a fourth of the reports is missing."""
    some = fixes(spark, sf_dir).filter("id % 4 > 0").withColumn("scene", F.col("mmsi") % 10)
    windows = sequence.sliding(some.select("scene", "t").distinct(), 6, 3, ("scene",))
    found = sequence.window_paths(some, windows, "mmsi", ("scene",))
    return found.withColumns({"lon": rounded(F.col("lon")), "lat": rounded(F.col("lat"))})


@query(f"WITH {FIXES_SQL}, o AS (SELECT mmsi, t, lead(t, 5) OVER w AS last_t, row_number() OVER w - 1 AS k FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t)) SELECT mmsi, CAST(k // 2 AS BIGINT) AS \"window\", t AS first_t, last_t FROM o WHERE last_t IS NOT NULL AND k % 2 = 0")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sliding(fixes(spark, sf_dir), 6, 2).drop("times")


@query(f"""WITH {FIXES_SQL}, e AS (SELECT mmsi, t, CASE nav_status WHEN 0 THEN 'enter' WHEN 1 THEN 'exit' WHEN 5 THEN 'transit' ELSE 'none' END AS d FROM fixes)
SELECT mmsi, t, d AS direction, CASE WHEN d <> 'enter' THEN t WHEN leave - t <= 300 THEN leave END AS leaves_at
FROM (SELECT *, min(CASE WHEN d IN ('exit', 'transit') THEN t END) OVER (PARTITION BY mmsi ORDER BY t ROWS BETWEEN 1 FOLLOWING
  AND UNBOUNDED FOLLOWING) AS leave FROM e) WHERE d <> 'none'""")
def crossing_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("nav_status") == 0, "enter").when(F.col("nav_status") == 1, "exit").when(F.col("nav_status") == 5, "transit").otherwise("none")
    return events.cutoff(fixes(spark, sf_dir).select("mmsi", "t", kind.alias("direction"), F.lit("f").alias("fence")), 300).select("mmsi", "t", "direction", "leaves_at")


@query(f"""WITH {WALK_SQL}, l AS (SELECT *, lead(t) OVER w AS nt, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(course) OVER w AS nc FROM fixes
  WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
s AS (SELECT *, unnest(generate_series(0, CASE WHEN nt IS NULL THEN 0 ELSE CAST(floor((nt - t - 1) / 20) AS BIGINT) END)) AS step FROM l)
SELECT mmsi, t + step * 20 AS t, {R.format("CASE WHEN step = 0 THEN lon ELSE lon + (nlon - lon) * (step * 20 / (nt - t)) END")} AS lon,
  {R.format("CASE WHEN step = 0 THEN lat ELSE lat + (nlat - lat) * (step * 20 / (nt - t)) END")} AS lat,
  round(CASE WHEN step = 0 THEN course ELSE (course + ((nc - course + 540) % 360 - 180) * (step * 20 / (nt - t)) + 360) % 360 END, 4) AS course FROM s""")
def broadcast_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.interpolated(walk(spark, sf_dir), F.lit(20), 600, circular=("course",))
    return out.select("mmsi", F.col("t").cast("long").alias("t"), rounded(F.col("lon")).alias("lon"), rounded(F.col("lat")).alias("lat"), F.round("course", 4).alias("course"))
