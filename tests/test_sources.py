"""Readers, stores and streams on small files."""

from __future__ import annotations

import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.operators import events
from wakeline.sources import files, sinks
from wakeline.streaming import queries, state


def csv(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


HEADER = "timestamp,MMSI,msg_type,latitude,longitude,speed,course,status,Name\n"


def test_report_folder(spark, tmp_path):
    csv(tmp_path / "in/a/x.csv", HEADER + "2026-08-23 08:00:00,412000001,1,22.4,113.7,10,90,1.0,NaN\n1787472060,412000001,1,22.4,113.8,103,400,0,A\n,412000001,1,22.4,113.8,1,1,0,no time\n")
    csv(tmp_path / "in/b/x.csv", HEADER + "2026-08-23 08:00:00,4120,1,22.4,113.7,10,90,1,bad id\n2026-08-23 08:00:00,412000002,5,,,,,,B\n2026-08-23 08:00:00,412000003,9,22,113,1,1,0,unsupported\n")
    positions, particulars = files.load_reports(spark, str(tmp_path / "in"))
    got = sorted((r["t"], r["speed"], r["course"], r["nav_status"], r["name"], r["quality_flags"]) for r in positions.collect())
    assert got == [(1787472000.0, 10.0, 90.0, 1, "未知目标", ["heading_unavailable", "rot_unavailable"]), (1787472060.0, None, None, 0, "A", ["speed_unavailable", "course_unavailable", "heading_unavailable", "rot_unavailable"])]
    assert [r["mmsi"] for r in particulars.collect()] == ["412000002"]
    raw = files.report_folder(spark, str(tmp_path / "in"))
    done = raw.filter(F.col("file").contains("/a/")).select("file", "signature")
    assert files.unseen(raw, done).select("file").distinct().count() == 1


def test_bounded_load(spark):
    df = spark.createDataFrame([("a", 1.0, 1, "f"), ("a", 1.0, 2, "f"), ("b", 0.5, 1, "f"), ("c", 2.0, 1, "f")], "mmsi string, t double, seq int, file string")
    assert {(r["mmsi"], r["seq"]) for r in files.bounded(df, first_vessels=2).collect()} == {("a", 2), ("b", 1)}
    assert {r["mmsi"] for r in files.bounded(df, mmsi=["a", "c"], start=1.5).collect()} == {"c"}


def test_sensor_tables(spark, tmp_path):
    csv(tmp_path / "ais.csv", "DateTime,ID,X,Y,speed\n1700000000000,a,22.5,113.5,3\n1700000001000,b,,113.5,3\n")
    got = files.sensor_table(spark, str(tmp_path / "ais.csv")).collect()
    assert [(r["t"], r["target"], r["lon"], r["lat"], r["speed"]) for r in got] == [(1700000000.0, "a", 113.5, 22.5, 3.0)]
    csv(tmp_path / "bad.csv", "DateTime,ID\n1,a\n")
    with pytest.raises(ValueError, match="X, Y"):
        files.sensor_table(spark, str(tmp_path / "bad.csv"))
    names = spark.createDataFrame([("AIS_08_x.csv",), ("Radar_08_x.csv",), ("AIS_09_x.csv",), ("Radar_09_y.csv",)], "file string")
    assert [(r["scene"], r["suffix"]) for r in files.scene_pairs(names).collect()] == [("08", "x")]


def test_coastline_and_windows(spark, tmp_path):
    with gzip.open(tmp_path / "coast.json.gz", "wt") as out:
        json.dump({"lines": [[[113, 22], [113.1, 22], [113.2, 22.1]], [[114, 22], [114, 23]]]}, out)
    assert {(r["segment"], r["x2"]) for r in files.coastline(spark, str(tmp_path / "coast.json.gz")).collect()} == {("0-0", 113.1), ("0-1", 113.2), ("1-0", 114.0)}
    points = spark.createDataFrame([("a", 10), ("a", 95), ("b", 10)], "mmsi string, t long")
    windows = spark.createDataFrame([("e", "a", 0, 90)], "event string, mmsi string, start long, end long")
    assert [(r["mmsi"], r["t"]) for r in files.in_needed_buckets(points, windows).collect()] == [("a", 10)]


def test_zone_file(spark, tmp_path):
    csv(tmp_path / "zones.csv", 'AOI_Name,type,geometry,is_active\nA,PRT,"POLYGON((0 0, 1 0, 1 1, 0 0))",1\n=B,PRT,"POLYGON((0 0, 1 0, 1 1))",\nC,ANC,"POLYGON((0 0, 1 1, 1 0, 0 1))",no\n')
    got = {r["name"]: (r["fault"], r["is_active"]) for r in files.zone_file(spark, str(tmp_path / "zones.csv")).collect()}
    assert got == {"A": (None, True), "=B": ("formula", True), "C": ("no area", False)}
    few = {r["name"]: r["fault"] for r in files.zone_file(spark, str(tmp_path / "zones.csv"), most_rows=2).collect()}
    assert few == {"A": None, "=B": "formula", "C": "too many rows"}
    csv(tmp_path / "odd.csv", "X,Y,true_heading,rate_of_turn,message_type,draft,vessel_type,MMSI,time\n22.5,113.5,90,3,1,4.5,cargo,412000001,1700000000\n")
    row = files.canonical(spark.read.option("header", True).csv(str(tmp_path / "odd.csv"))).first()
    assert (row["lat"], row["lon"], row["heading"], row["rot"], row["msg_type"], row["draught"], row["ship_type"]) == ("22.5", "113.5", "90", "3", 1, 4.5, "cargo")


def test_feeds(spark):
    xml = "<root><TropicalCycloneName>Ann</TropicalCycloneName><Points><P><Time>t0</Time><Latitude>22.5N</Latitude><Longitude>113.0E</Longitude><Intensity>x</Intensity><MaximumWind>65 km/h</MaximumWind></P><P><Time>t1</Time><Latitude>2.5S</Latitude><Longitude>13.0W</Longitude><Intensity>y</Intensity><MaximumWind>70 km/h</MaximumWind></P></Points></root>"
    got = [(r["name"], r["lat"], r["lon"], r["wind"]) for r in files.typhoon_track(spark.createDataFrame([(xml,)], "xml string")).orderBy("ordinal").collect()]
    assert got == [("Ann", 22.5, 113.0, 65), ("Ann", -2.5, -13.0, 70)]
    weather = spark.createDataFrame([(json.dumps([{"current": {"time": "t", "temperature_2m": 20.5, "wind_speed_10m": 3}}, {"current": {"temperature_2m": 21}}]),)], "json string")
    marine = spark.createDataFrame([(json.dumps([{"current": {"wave_height": 1.5}}]),)], "json string")
    points = spark.createDataFrame([(0, "p"), (1, "q")], "ordinal int, place string")
    got = {r["place"]: (r["temperature_2m"], r["wave_height"]) for r in files.marine_weather(weather, marine, points).collect()}
    assert got == {"p": (20.5, 1.5), "q": (21.0, None)}


def test_store(spark, tmp_path):
    table = str(tmp_path / "store")
    one = lambda *rows: events.deduplicated(spark.createDataFrame(rows, "k string, detected_at long, detection_id long, v long"), ["k"], ["v"])
    sinks.upsert_events(one(("a", 1, 1, 10), ("a", 5, 2, 11)), table, ["k"], ["v"], batch=0)
    sinks.upsert_events(one(("a", 3, 3, 12), ("b", 3, 4, 13)), table, ["k"], ["v"], batch=1)
    sinks.upsert_events(one(("a", 9, 9, 99)), table, ["k"], ["v"], batch=1)  # replayed
    assert {tuple(r) for r in sinks.load(spark, table).collect()} == {("a", 1, 5, 3, 11), ("b", 3, 3, 1, 13)}
    points = str(tmp_path / "points")
    for rows in ([("a", 1), ("a", 1)], [("a", 1), ("a", 2), ("a", 100)]):
        sinks.append_new(spark.createDataFrame(rows, "k string, t long"), points, ["k", "t"])
    assert sinks.load(spark, points).count() == 3
    sinks.retain(points, spark, 50)
    assert [r["t"] for r in sinks.load(spark, points).collect()] == [100]
    sinks.export_csv(spark.createDataFrame([("=1", 1)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["a"] == "'=1"


def test_store_survives_a_write_that_dies(spark, tmp_path, monkeypatch):
    """Killed before the rename, or with half a generation written, the store is what it was; the next write goes on from there."""
    table = str(tmp_path / "store")
    one = lambda *rows: events.deduplicated(spark.createDataFrame(rows, "k string, detected_at long, detection_id long, v long"), ["k"], ["v"])
    rows = lambda: {tuple(r) for r in sinks.load(spark, table).collect()}
    sinks.upsert_events(one(*((f"k{i}", i, i, i) for i in range(40))), table, ["k"], ["v"], batch=0)
    before = rows()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(sinks, "_point", dies)
        with pytest.raises(KeyboardInterrupt):
            sinks.upsert_events(one(("k1", 99, 99, 99)), table, ["k"], ["v"], batch=1)
    assert rows() == before
    stale = sinks._pointer(spark, table)
    sinks.upsert_events(one(("k1", 99, 99, 99)), table, ["k"], ["v"], batch=1)
    assert rows() - before == {("k1", 1, 99, 2, 99)} and len(rows()) == 40
    now = sinks._pointer(spark, table).generations
    assert now[: len(stale.generations)] == stale.generations and len(now) == 2  # nothing was rewritten
    with pytest.raises(sinks.Conflict):
        sinks._add(one(("k1", 5, 5, 5)), table, ["k"], "events", ["v"], 1, stale)  # another writer was first
    for n in range(2, 8):
        sinks.upsert_events(one(("k2", 100 + n, n, n)), table, ["k"], ["v"], batch=n)
    assert len(list((tmp_path / "store" / "_pointers").glob("[0-9]*"))) == sinks.KEPT_POINTERS
    left = {p.name for p in (tmp_path / "store").glob("generation-*")}
    named = {n for k in sinks._numbers(spark, table) for n, _ in sinks._read(spark, table, k).generations}
    assert len(left - named) == 2  # of the write that died and of the one that was second
    sinks._clean(spark, table, grace=-60.0)
    assert {p.name for p in (tmp_path / "store").glob("generation-*")} == named and len(rows()) == 40
    with pytest.raises(ValueError):
        sinks.append_new(spark.createDataFrame([("k1",)], "k string"), table, ["k"])


def test_a_write_costs_what_it_brings(spark, tmp_path):
    """Sixteen micro-batches into a large store leave its large generation alone; merged on read all equals one batch."""
    table = str(tmp_path / "store")
    schema = "k string, detected_at long, detection_id long, v long"
    whole = [(f"k{i}", i, i, i) for i in range(20_000)]
    sinks.upsert_events(events.deduplicated(spark.createDataFrame(whole, schema), ["k"], ["v"]), table, ["k"], ["v"], batch=0)
    first = sinks._pointer(spark, table).generations[0]
    for n in range(1, 17):
        rows = [(f"k{(n * 37 + i * 101) % 20_000}", 50_000 + n, n * 100 + i, n) for i in range(20)]
        whole += rows
        sinks.upsert_events(events.deduplicated(spark.createDataFrame(rows, schema).coalesce(1), ["k"], ["v"]), table, ["k"], ["v"], batch=n)
        now = sinks._pointer(spark, table).generations
        assert now[0] == first and len(now) <= 1 + sinks.FANOUT and sum(size for _, size in now[1:]) < first[1] / 4
    want = {tuple(r) for r in events.deduplicated(spark.createDataFrame(whole, schema), ["k"], ["v"]).collect()}
    assert {tuple(r) for r in sinks.load(spark, table).collect()} == want
    sinks.compact(spark, table)
    assert len(sinks._pointer(spark, table).generations) == 1 and {tuple(r) for r in sinks.load(spark, table).collect()} == want


def test_revisions_of_rows(spark, tmp_path, monkeypatch):
    """Two editors change one zone: the first is taken, the second refused, also when they meet; a preview writes nothing."""
    table, shape = str(tmp_path / "zones"), "zone string, revision long, name string"
    frame = lambda *rows: spark.createDataFrame(list(rows), shape)
    rows = lambda: {tuple(r) for r in sinks.load(spark, table).select("zone", "revision", "name").collect()}
    assert sinks.revise(frame(("a", None, "A"), ("b", 0, "B"), ("c", 3, "C")), table, ["zone"]).select("zone", "revision", "current").collect() == [("c", 3, None)]
    assert rows() == {("a", 1, "A"), ("b", 1, "B")}
    seen = sinks.previewed(frame(("a", 1, "A2"), ("b", 1, "B"), ("b", 7, "B7"), ("d", None, "D")), table, ["zone"])
    assert {(r["zone"], r["revision"], r["action"]) for r in seen.collect()} == {("a", 1, "change"), ("b", 1, "unchanged"), ("b", 7, "refused"), ("d", None, "create")}
    assert rows() == {("a", 1, "A"), ("b", 1, "B")}
    own = sinks._add

    def meets(*args, **kwargs):  # another editor comes between reading and writing
        monkeypatch.setattr(sinks, "_add", own)
        sinks.revise(frame(("a", 1, "other")), table, ["zone"])
        return own(*args, **kwargs)

    monkeypatch.setattr(sinks, "_add", meets)
    refused = sinks.revise(frame(("a", 1, "mine"), ("b", 1, "B2")), table, ["zone"]).collect()
    assert [(r["zone"], r["current"]) for r in refused] == [("a", 2)]
    assert rows() == {("a", 2, "other"), ("b", 2, "B2")}


def test_retention_by_vessel(spark, tmp_path):
    points = str(tmp_path / "points")
    sinks.append_new(spark.createDataFrame([("a", 0), ("a", 100), ("b", 500), ("b", 1000)], "k string, t long"), points, ["k", "t"])
    sinks.retain(points, spark, 300, by="k")
    assert sorted(map(tuple, sinks.load(spark, points).collect())) == [("a", 0), ("a", 100), ("b", 1000)]


def test_cutoffs_and_artifacts(spark):
    rows = [("v", "f", 0, "enter"), ("v", "f", 50, "exit"), ("v", "f", 60, "enter"), ("v", "g", 70, "transit"), ("v", "f", 80, "none")]
    got = events.cutoff(spark.createDataFrame(rows, "mmsi string, fence string, t long, direction string"))
    assert {(r["fence"], r["t"]): r["leaves_at"] for r in got.collect()} == {("f", 0): 50, ("f", 50): 50, ("f", 60): None, ("g", 70): 70}
    points = spark.createDataFrame([(1, "crossing", None, ""), (2, "crossing", "t", None), (3, None, None, None)], "k int, event string, timestamp string, time string")
    assert sorted(r["k"] for r in events.without_artifacts(points, "crossing").collect()) == [2, 3]


def test_zone_search(spark):
    zones = spark.createDataFrame([("Port A", "port", "x", True), ("Bay", "bay", "x", True), ("Port B", "port", "y", False)], "name string, zone_type string, region string, is_active boolean")
    names = lambda **k: sorted(r["name"] for r in events.zone_search(zones, **k).collect())
    assert names() == ["Bay", "Port A"] and names(kinds=("port",), active=None) == ["Port A", "Port B"] and names(text="PORT", region="x") == ["Port A"]


def test_stream_of_reports_keeps_state(spark, tmp_path):
    """Older reports are counted, equal ones ignored, corrections and particulars accepted; silence removes a vessel."""
    folder = tmp_path / "in"
    header = "timestamp,mmsi,msg_type,lat,lon,speed,course,status,name,ship_type,length\n"
    batches = [
        "2026-01-01 00:00:00,412000001,1,22,113,1,0,0,,,\n2026-01-01 00:00:10,412000001,5,,,,,,ANN,cargo,90\n2026-01-01 00:00:00,412000002,1,22,113,1,0,0,,,\n",
        "2026-01-01 00:00:00,412000001,1,22,113,1,0,0,,,\n2026-01-01 00:01:00,412000001,1,22.1,113,1,0,0,,,\n2025-12-31 23:59:00,412000001,1,20,113,1,0,0,,,\n",
        "2026-01-01 01:00:00,412000003,1,22,113,1,0,0,,,\n", "2026-01-01 01:10:00,412000003,1,22,113,1,0,0,,,\n",
    ]
    schema = ", ".join(f"{c} string" for c in header.strip().split(","))
    for k, text in enumerate(batches):
        csv(folder / f"{k}.csv", header + text)
        stream = queries.report_stream(spark, str(folder), schema)
        query = queries.write_changes(state.vessel_changes(stream, delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["mmsi", "version"])
    ann = got[got.mmsi == "412000001"]
    assert ann["change"].tolist() == ["upsert", "upsert", "remove"] and ann["name"].tolist() == ["ANN"] * 3
    assert ann["lat"].tolist() == [22, 22.1, 22.1] and ann["late"].tolist()[1] == 1
    assert got[got.mmsi == "412000002"]["change"].tolist() == ["upsert", "remove"]
    assert pd.api.types.is_datetime64_any_dtype(got["t"])


def test_stream_of_detections_equals_one_batch(spark, tmp_path):
    rows = [("k%d" % (i % 3), i, i, i * 10) for i in range(30)]
    schema = "k string, detected_at long, detection_id long, v long"
    for part in range(3):
        spark.createDataFrame(rows[part::3][:5] + rows[part * 10 : part * 10 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = queries.store_events(stream, str(tmp_path / "store"), str(tmp_path / "cp"), ["k"], ["v"], once=True)
    query.awaitTermination(120)
    whole = events.deduplicated(spark.read.parquet(str(tmp_path / "in")), ["k"], ["v"])
    assert {tuple(r) for r in sinks.load(spark, str(tmp_path / "store")).collect()} == {tuple(r) for r in whole.collect()}


def test_stay_sessions(spark):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:00", 0.1), ("a", "2026-01-01 00:05:00", 0.3), ("a", "2026-01-01 02:00:00", 0.1)], "mmsi string, t string, speed double").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in state.stay_sessions(df, "30 minutes").collect()) == [1, 2]
