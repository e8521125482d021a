"""Permits, far targets, file pruning, the change log, sources, backlogs, and what detectors take from places; each against a plain loop or given rows."""

from __future__ import annotations

import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tests.test_ordered import streamed
from wakeline.functions import records
from wakeline.operators import events, folds, sequence, spatial, temporal
from wakeline.plans import detectors
from wakeline.sources import files
from wakeline.streaming import changelog, sources, state


def test_permits_with_wildcards(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [(k, pick(1, 2, 3), pick("A", "B", None), pick("P", "Q", None), rng.randrange(100)) for k in range(200)]
    rules = [(k, pick(1, 2), pick("A", "B", None), pick("P", "Q", None), pick(None, 10, 40), pick(None, 60, 90)) for k in range(25)]
    left = spark.createDataFrame(rows, "k long, mmsi long, origin string, port string, t long")
    right = spark.createDataFrame(rules, "permit long, mmsi long, origin string, port string, a long, b long")
    got = {r["k"]: r["permit"] for r in temporal.best_valid(left, right, ["mmsi"], ["origin", "port"], "a", "b", "permit", ["permit"], ["k"]).collect()}

    def best(m, o, p, t):
        fits = [r for r in rules if r[1] == m and r[2] in (None, o) and r[3] in (None, p) and (r[4] is None or t >= r[4]) and (r[5] is None or t <= r[5])]
        return min(fits, key=lambda r: (-(r[2] is not None) - (r[3] is not None), r[2] is None, r[0]))[0] if fits else None

    assert got == {k: best(m, o, p, t) for k, m, o, p, t in rows} and len(set(got.values())) > 8


def test_nearest_anywhere(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(120)] + [(500 + i, 113.0 + i * 1e-3, 22.0) for i in range(20)]
    targets = [(k, x, y) for k, (x, y) in enumerate([(113.0, 22.0), (113.01, 22.0), (-179.9, 1.0), (60.0, -70.0)])]
    got = {r["id"]: (r["k_b"], round(r["distance"], 1)) for r in spatial.nearest_anywhere(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(targets, "k long, lon double, lat double"), ["id"], 200.0).collect()}
    want = {i: min(((round(folds.metres(x, y, tx, ty), 1), k) for k, tx, ty in targets))[::-1] for i, x, y in points}
    assert got == want
    assert spatial.nearest_anywhere(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame([], "k long, lon double, lat double"), ["id"], 1e6).count() == 0


def test_only_needed_files_are_read(spark, tmp_path):
    names = {f"ais_2026010100{m:02d}{s:02d}.csv": (m, s) for m in range(10) for s in (0, 30)}
    for name, (m, s) in names.items():
        (tmp_path / name).write_text(f"mmsi,timestamp,lon,lat\n412000001,2026-01-01 00:{m:02d}:{s:02d},113,22\n412000002,2026-01-01 00:{m:02d}:{s:02d},113,22\n")
    (tmp_path / "notes.csv").write_text("no time in the name\n")
    start = 1767225600
    windows = spark.createDataFrame([(1, "412000001", start + 60, start + 120), (2, "412000002", start + 90, start + 90)], "event long, mmsi string, start long, end long")
    got = files.read_windows(spark, str(tmp_path), windows)
    assert sorted(f.rsplit("/", 1)[1] for f in got.inputFiles()) == ["ais_20260101000100.csv", "ais_20260101000130.csv", "ais_20260101000200.csv"]
    assert sorted((r["event"], int(r["t"]) - start) for r in got.collect()) == [(1, 60), (1, 90), (1, 120), (2, 90)]
    assert files.read_windows(spark, str(tmp_path), windows.filter("event = 7")).count() == 0


def test_a_reader_that_missed_versions(spark, tmp_path):
    """Whatever versions a reader loses, it comes to the state that all changes give; it needs a snapshot only if the log has let go of them."""
    rng = random.Random(3)
    log, want, readers = str(tmp_path / "log"), {}, {}
    for n in range(13):
        rows = [(f"v{rng.randrange(6)}", "remove" if rng.random() < 0.3 else "upsert", n * 10 + i) for i in range(3)]
        rows = list({k: (k, c, x) for k, c, x in rows}.values())
        changelog.publish(spark.createDataFrame(rows, "mmsi string, change string, x long").coalesce(1), log, ["mmsi"], n, every=4)
        changelog.publish(spark.createDataFrame([("zz", "upsert", 1)], "mmsi string, change string, x long"), log, ["mmsi"], n, every=4)  # replayed
        for k, c, x in rows:
            want.pop(k, None)
            if c == "upsert":
                want[k] = x
        readers[n] = dict(want)
    for have in (-1, 2, 6, 8, 11, 12):
        got = changelog.news(spark, log, have)
        assert (got.snapshot is not None) == (have < 7) and got.version == 12
        own = got.snapshot if got.snapshot is not None else spark.createDataFrame(list(readers[have].items()), "mmsi string, x long")
        state_ = own if got.changes is None else changelog.applied(own, got.changes, ["mmsi"])
        assert {r["mmsi"]: r["x"] for r in state_.collect()} == want, have
    assert len(changelog._numbers(spark, f"{log}/snapshots")) <= 2


def test_sources_never_mix(spark, tmp_path):
    """Two sources report the same vessels; the one that is active counts, and a switch begins with no state."""
    names = "source string, mmsi string, kind string, t long, lon double, lat double, speed double, course double, nav_status int, name string, ship_type string, length double"
    rows = [(s, "a", "dynamic", t, x + t, 0.0, 0.0, 0.0, 0, None, None, None) for t in range(10, 100, 10) for s, x in (("live", 0.0), ("replay", 1000.0))]
    switches = spark.createDataFrame([("live", 0), ("replay", 40), ("live", 70)], "source string, t long").withColumn("t", F.timestamp_seconds("t"))

    def build(stream):
        some = sources.active(stream.withColumn("kind", F.lit("dynamic")), switches)
        return state.vessel_changes(some.withColumn("mmsi", F.concat_ws("/", "source", F.col("epoch").cast("string"), "mmsi")), delay="1 minute")

    got = streamed(spark, tmp_path, rows, names, build, shuffled=1)
    seen = {(r["mmsi"], r["lon"], r["version"]) for r in got.filter("change = 'upsert'").collect()}
    assert {m for m, _, _ in seen} == {"live/0/a", "replay/1/a", "live/2/a"}
    assert all((lon >= 1000) == m.startswith("replay") for m, lon, _ in seen) and min(v for m, _, v in seen if m == "live/2/a") == 1


def test_backlogs_and_coalesced_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [("c", t, t, rng.random() < 0.1) for t in range(10, 400, 3)]
    want, queue, lost = [], [], 0
    for _, t, item, drain in rows:
        if drain:
            want += [(x, t, lost) for x in queue[:4]]
            del queue[:4]
        else:
            queue.append(item)
            lost += max(0, len(queue) - 15)
            queue = queue[-15:]
    (tmp_path / "a").mkdir()
    got = streamed(spark, tmp_path / "a", rows, "consumer string, t long, item long, drain boolean", lambda s: sources.drained(s, 15, 4, "10 minutes"))
    assert sorted((r["item"], int(r["drained_at"].timestamp()), r["lost"]) for r in got.collect()) == sorted(want) and lost > 0
    asks = [("w", t, rng.random() < 0.3) for t in range(10, 300, 5)]
    want, running, pending = [], False, False
    for _, t, done in asks:
        if done:
            running, pending = pending, False
            if running:
                want.append(t)
        elif running:
            pending = True
        else:
            running = True
            want.append(t)
    (tmp_path / "b").mkdir()
    got = streamed(spark, tmp_path / "b", asks, "work string, t long, done boolean", lambda s: sources.runs(s, "10 minutes"))
    assert sorted(int(r["starts_at"].timestamp()) for r in got.filter("work = 'w'").collect()) == want


def zigzag(mmsi, **place):
    """Forty minutes of going up and down, a turn every three minutes."""
    rows = []
    for k in range(40):
        y = 22.0 + (k % 6 if k % 6 < 4 else 6 - k % 6) * 0.0009
        rows.append({"mmsi": mmsi, "t": 60 * k, "lon": 113.0 + mmsi * 0.1 + 1e-5 * k, "lat": y, "speed": 3.5, "course": 0.0 if k % 6 < 3 else 180.0, "at_dock": None, "port_name": None, "authorised": None, "legal": None, "area": None, **{c: v(k) if callable(v) else v for c, v in place.items()}})
    return rows


WANDER = "mmsi long, t long, lon double, lat double, speed double, course double, at_dock boolean, port_name string, authorised boolean, legal boolean, area string"


def test_wandering_and_what_is_normal(spark):
    rows = zigzag(1) + zigzag(2, at_dock=lambda k: k == 39) + zigzag(3, port_name="Port", speed=2.5) + zigzag(4, port_name="Port", speed=8.0) + zigzag(5, authorised=True, speed=1.5) + zigzag(6, authorised=lambda k: k % 2 == 0, speed=1.5)
    rows += zigzag(7, legal=lambda k: k < 33) + zigzag(8, area=lambda k: "north" if k < 20 else "south" if k < 36 else None) + zigzag(9, area=lambda k: "north" if k < 20 else None)
    fixes = spark.createDataFrame([tuple(r.values()) for r in rows], WANDER)
    cfg = detectors.WanderingConfig(window=2400.0)
    got = {r["mmsi"]: r["area"] for r in detectors.wandering(fixes, cfg).collect()}
    assert got == {1: None, 4: None, 6: None, 8: "north", 9: "north"}
    only = detectors.wandering(fixes, detectors.WanderingConfig(window=2400.0, monitored_only=True)).collect()
    assert {r["mmsi"] for r in only} == {8}
    bare = detectors.wandering(fixes.select("mmsi", "t", "lon", "lat", "speed", "course"), cfg).collect()
    assert {r["mmsi"] for r in bare} == set(range(1, 10)) and all(math.isclose(r["duration"], 2340) for r in bare)


def test_berths_facilities_and_limits(spark):
    places = [(1, None, None, None, None), (2, "Jetty", None, "Port", "Zone"), (3, None, None, "Port", "Zone"), (4, None, None, None, "Zone"), (5, "Jetty", None, None, None), (6, "Jetty", "Berth", None, None)]
    facts = detectors.berth_facts(spark.createDataFrame(places, "mmsi long, configured_facility string, legal_berth string, port_name string, port_zone string"))
    assert {(r["mmsi"], r["facility"], r["legal_area"], r["near_facility"], r["authorised"]) for r in facts.collect()} == {
        (1, None, None, False, False), (2, "Jetty", "Port", True, True), (3, "Port", "Port", True, True), (4, "Zone", "Zone", True, True), (5, "Jetty", None, True, False), (6, "Jetty", "Berth", True, True),
    }
    behaviour = spark.createDataFrame([(k, "berthing", 5, d, 0.1, 10.0) for k, d in ((1, 9000.0), (3, 9000.0), (4, 2000.0), (5, 2000.0), (6, 9000.0))], "mmsi long, behavior string, points long, duration double, mean_speed double, radius double")
    none = spark.createDataFrame([], "mmsi long")
    reasons = lambda **k: {(r["mmsi"], r["reason"]) for r in detectors.parking(behaviour, facts, none, **k).collect()}
    assert reasons() == {(5, "berthed")}
    assert reasons(legal_limit=7200.0) == {(5, "berthed"), (3, "over time"), (6, "over time")}


def test_shore_flags(spark):
    coast = spark.createDataFrame([("s", 113.0, 22.0, 114.0, 22.0)], "segment string, x1 double, y1 double, x2 double, y2 double")
    ports = spatial.with_ring(spark.createDataFrame([("P", [(113.0, 22.0), (113.01, 22.0), (113.01, 22.01), (113.0, 22.01)])], "zone string, vertices array<struct<lon: double, lat: double>>"))
    fixes = spark.createDataFrame([(1, 113.5, 22.04, True), (2, 113.5, 22.06, True), (3, 113.035, 22.0, False), (4, 113.045, 22.0, False), (5, 113.005, 22.005, None)], "id long, lon double, lat double, near_port boolean")
    got = {r["id"]: (r["near_coast"], r["near_port"], r["port"]) for r in detectors.shore_flags(fixes, coast, ports, ["id"]).collect()}
    assert got == {1: (True, False, None), 2: (False, False, None), 3: (True, True, "P"), 4: (True, False, None), 5: (True, True, "P")}


def test_static_reports_are_normalised(spark):
    rows = [("412000001", 5.0, "5", " ANN  LEE ", "chn", " 9 ", "", "12.5", "nan"), ("412000001", None, "5", "X", None, None, None, None, None), ("12", 5.0, "5", "X", None, None, None, None, None), ("412000002", 5.0, "1", "X", None, None, None, None, None), ("412000003", 6.0, "24", None, None, None, "cargo", "x", "3")]
    got = {r["mmsi"]: r for r in records.normalise_static(spark.createDataFrame(rows, "mmsi string, t double, msg_type string, name string, iso3 string, imo string, ship_type string, draught string, length string")).collect()}
    assert set(got) == {"412000001", "412000003"}
    assert (got["412000001"]["iso3"], got["412000001"]["imo"], got["412000001"]["ship_type"], got["412000001"]["draught"], got["412000001"]["length"], got["412000001"]["to_bow"]) == ("CHN", "9", None, 12.5, None, None)
    assert (got["412000003"]["ship_type"], got["412000003"]["draught"], got["412000003"]["length"]) == ("cargo", None, 3.0)


def test_filter_times():
    assert records.filter_time("2026-01-31").isoformat() == "2026-01-31T00:00:00+00:00"
    assert records.filter_time("2026-01-31", end=True).isoformat() == "2026-02-01T00:00:00+00:00"
    assert records.filter_time("2026-01-31T10:00:00", end=True).isoformat() == "2026-01-31T10:00:00+00:00"
    assert records.filter_time(None) is None and records.filter_time("") is None
    with pytest.raises(ValueError):
        records.filter_time("soon")


def test_deviation_only_where_routes_are_known(spark):
    """A vessel leaves its route and is far off within the box of all routes; another leaves that box, where nothing is known."""
    routes = spark.createDataFrame([(113.0 + 0.002 * k, 22.0, 90.0, 1.0) for k in range(60)] + [(113.0, 22.2, 0.0, 1.0)], "lon double, lat double, axis double, coherence double")
    on = [(60 * k, 113.0 + 0.003 * k, 22.0) for k in range(8)]
    tracks_ = {1: on + [(480 + 60 * k, 113.03, 22.03 + 0.003 * k) for k in range(5)], 2: on + [(480 + 60 * k, 113.03, 21.9 - 0.003 * k) for k in range(5)], 3: on}
    fixes = spark.createDataFrame([(m, float(t), x, y, 8.0, 90.0, True) for m, rows in tracks_.items() for t, x, y in rows], "mmsi long, t double, lon double, lat double, speed double, course double, eligible boolean")
    assert [(r["mmsi"], r["n_points"], r["off_since"], r["risk"]) for r in detectors.deviation(fixes, routes, margin=0.0).collect()] == [(1, 5, 480.0, "high")]
    assert sorted(r["mmsi"] for r in detectors.deviation(fixes, routes, margin=30_000.0).collect()) == [1, 2]


def test_port_work_is_no_illegal_anchoring(spark):
    fixes = spark.createDataFrame([(m, float(60 * k), 113.0, 22.0, 0.1, state_, "p", False, port, False) for m, state_, port in ((1, "covered", None), (2, "covered", "Port"), (3, "prohibited", "Port"), (4, "outside", None)) for k in range(8)], "mmsi long, t double, lon double, lat double, speed double, state string, place string, at_dock boolean, port_name string, in_port boolean")
    behaviour = spark.createDataFrame([(m, "anchoring", 8, 10.0) for m in (1, 2, 3, 4)], "mmsi long, behavior string, points long, radius double")
    assert {(r["mmsi"], r["risk"]) for r in detectors.anchoring(fixes, behaviour).collect()} == {(1, "medium"), (3, "high")}


def test_window_paths(spark):
    """Places between samples lie on a line, those outside stay; two samples are too few; the latest window is the end of the scene's times."""
    rows = [("s", t, v, x, y, k) for t, v, x, y, k in ((0, "a", 1.0, 1.0, 0), (20, "a", 3.0, 5.0, 0), (20, "a", 9.0, 9.0, 1), (30, "a", 4.0, 5.0, 0), (10, "b", 1.0, 1.0, 0), (20, "b", 1.0, None, 0), (30, "b", 2.0, 1.0, 0), (40, "c", 7.0, 7.0, 0), (50, "c", 8.0, 8.0, 0))]
    df = spark.createDataFrame(rows, "scene string, t long, v string, lon double, lat double, k long")
    times = df.select("scene", "t").distinct()
    got = sequence.window_paths(df, sequence.sliding(times, 6, 1, ("scene",)), "v", ("scene",), tie="k").orderBy("place").collect()
    assert [(r["v"], r["t"], r["lon"], r["lat"], r["known"]) for r in got] == [("a", 0, 1.0, 1.0, True), ("a", 10, 2.0, 3.0, False), ("a", 20, 3.0, 5.0, True), ("a", 30, 4.0, 5.0, True), ("a", 40, 4.0, 5.0, False), ("a", 50, 4.0, 5.0, False)]
    last = sequence.latest_window(times, 3, ("scene",)).collect()
    assert [(r["first_t"], r["last_t"], r["times"]) for r in last] == [(30, 50, [30, 40, 50])]
    assert sequence.latest_window(times, 7, ("scene",)).count() == 0


def test_spans_of_trajectories():
    at = lambda h: datetime(2026, 1, 1, h, tzinfo=UTC)
    assert events.trajectory_span(None, None, at(12)) == (at(7), at(12)) and events.trajectory_span(at(3), at(8), at(12)) == (at(3), at(8))
    assert events.trajectory_span(None, None, at(12), event_specific=True) is None
    for start, end in ((at(8), at(8)), (at(1), at(7))):
        with pytest.raises(ValueError):
            events.trajectory_span(start, end, at(12))
