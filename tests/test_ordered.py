"""Streams in event-time order against their batch twins and plain loops: alerts, tails."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import lifecycle, sequence
from wakeline.plans import fusion
from wakeline.streaming import ordered, state


def streamed(spark, folder, rows, schema, build, shuffled=3, seed=1, end=10**6):
    """Rows in micro-batches of one file each, every ``shuffled`` neighbours in any order, and a last row far ahead that moves the watermark on."""
    rng = random.Random(seed)
    rows = list(rows)
    for at in range(0, len(rows), shuffled):
        part = rows[at : at + shuffled]
        rng.shuffle(part)
        rows[at : at + shuffled] = part
    size = max(1, len(rows) // 5)
    last = [tuple(end if c == "t" else "end" if k == "string" else 0.0 if k == "double" else None for c, k in (f.split() for f in schema.split(", ")))]
    for k, part in enumerate([rows[i : i + size] for i in range(0, len(rows), size)] + [last]):
        df = spark.createDataFrame(part, schema).withColumn("t", F.timestamp_seconds("t"))
        df.coalesce(1).write.parquet(str(folder / "parts" / str(k)))
    (folder / "in").mkdir()
    kinds = spark.read.parquet(str(folder / "parts" / "0")).schema
    for k in range(len(list((folder / "parts").iterdir()))):  # one file a micro-batch, in order
        file = next((folder / "parts" / str(k)).glob("*.parquet"))
        file.rename(folder / "in" / f"{k:03d}.parquet")
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        query = build(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(folder / "out"))


def plain_alerts(rows, gap, now):
    out, open_ = [], {}
    for key, t, marked in sorted(rows, key=lambda r: (r[1], not r[2])):
        alert = open_.get(key)
        if alert and (t - alert[1] > gap or marked):
            out.append((key, "recovered", min(alert[1] + gap, t), alert[0], alert[2]))
            alert = None
        open_[key] = (alert[0], t, alert[2] + 1) if alert else (t, t, 1)
        out.append((key, "continuing" if alert else "new", t, open_[key][0], open_[key][2]))
    out += [(k, "recovered", a[1] + gap, a[0], a[2]) for k, a in open_.items() if now - a[1] > gap]
    return sorted(out)


def test_alerts_on_a_stream(spark, tmp_path):
    """A vessel that some micro-batches skip keeps its alert, late rows fall into place, and silence ends it."""
    rng = random.Random(2)
    rows = sorted({(rng.choice("abc"), t * 10, rng.random() < 0.1) for t in range(10, 70) if rng.random() < 0.7} | {("quiet", 100, False), ("quiet", 210, False), ("quiet", 500, False)}, key=lambda r: r[1])
    got = streamed(spark, tmp_path, rows, "mmsi string, t long, is_new boolean", lambda s: ordered.alert_changes(s, ["mmsi"], 120.0, "10 minutes"))
    found = sorted((r["mmsi"], r["change"], r["t"].timestamp(), r["s"], r["observations"]) for r in got.filter("mmsi <> 'end'").select("*", F.unix_timestamp("alert_since").alias("s")).collect())
    assert [(*r[:2], int(r[2]), *r[3:]) for r in found] == plain_alerts(rows, 120, 10**6)
    batch = spark.createDataFrame(rows, "mmsi string, t long, is_new boolean")
    ids = {(r["mmsi"], r["alert_since"], r["alert_id"], r["t"]) for r in lifecycle.annotated(batch, ["mmsi"], 120.0, "is_new").collect()}
    assert ids == {(r["mmsi"], r["s"], r["alert_id"], int(r["t"].timestamp())) for r in got.filter("mmsi <> 'end' and change <> 'recovered'").select("*", F.unix_timestamp("alert_since").alias("s")).collect()}


def test_alerts_in_batch(spark):
    rows = [("a", 0, False), ("a", 100, False), ("a", 300, False), ("b", 300, False), ("c", 290, False), ("c", 300, True)]
    got = lifecycle.alerts(spark.createDataFrame(rows, "mmsi string, t long, is_new boolean"), ["mmsi"], 120.0, is_new="is_new").collect()
    want = {("a", 0, 100, 2, "recovered", 220.0), ("a", 300, 300, 1, "new", None), ("b", 300, 300, 1, "new", None), ("c", 290, 290, 1, "recovered", 300.0), ("c", 300, 300, 1, "new", None)}
    assert {tuple(r[c] for c in ("mmsi", "first_seen", "last_seen", "observations", "state", "ended_at")) for r in got} == want
    later = lifecycle.alerts(spark.createDataFrame(rows, "mmsi string, t long, is_new boolean"), ["mmsi"], 120.0, 400.0)
    assert {r["state"] for r in later.filter("last_seen = 300").collect()} == {"continuing"}
    assert lifecycle.signature(["t", "fence", "mmsi", "direction", "x"]) == ["fence", "direction", "mmsi"]
    assert lifecycle.alerts(spark.createDataFrame([], "mmsi string, t long"), ["mmsi"], 120.0).count() == 0


@pytest.mark.parametrize("window", [300.0, 2700.0])
def test_tails_on_a_stream(spark, tmp_path, window):
    """Each fix's tail within the window, as the batch operator finds it among the fixes up to that time."""
    rng = random.Random(6)
    rows = [(v, t, None if rng.random() < 0.05 else rng.choice([0.2, 0.3, 0.4, 0.5, 5.0])) for t in range(30, 1500, 30) for v in ("a", "b") if rng.random() < 0.9]
    schema = "mmsi string, t long, speed double"
    got = streamed(spark, tmp_path, rows, schema, lambda s: ordered.tails(s, "speed", high=1.0, window=window, max_gap=90.0, min_points=3, min_seconds=60.0, delay="10 minutes"))
    fixes = spark.createDataFrame(rows, schema)
    asked = fixes.select(F.col("mmsi").alias("v"), F.col("t").alias("at"))
    upto = fixes.join(asked, (F.col("mmsi") == F.col("v")) & (F.col("t") <= F.col("at")) & (F.col("t") >= F.col("at") - window)).drop("v")
    ends = sequence.tail(upto, F.col("speed") <= 1.0, 90.0, by=("mmsi", "at"))
    want = ends.groupBy("mmsi", "at").agg(F.min("t").alias("since"), F.count("*").alias("n"), F.max("t").alias("last")).filter("n >= 3 and last - since >= 60")
    assert sorted((r["mmsi"], int(r["t"].timestamp()), int(r["since"].timestamp()), r["n_points"]) for r in got.collect()) == sorted((r["mmsi"], r["at"], r["since"], r["n"]) for r in want.collect())
    assert got.count() > 10


def test_two_sensors_on_a_stream(spark, tmp_path):
    """Reports and plots in shuffled micro-batches give the gated pairs of the batch."""
    rng = random.Random(8)
    rows = []
    for t in range(100, 1300, 20):
        for v in range(4):
            if rng.random() < 0.8:
                rows.append((f"v{v}", None, t, 113.0 + 0.02 * v + t * 1e-5, 22.0 + rng.uniform(0, 1e-3), rng.choice([None, 3.0, 6.0]), rng.choice([None, 90.0, 80.0])))
        rows += [(None, t * 10 + k, t + 7, 113.0 + 0.02 * k + t * 1e-5 + rng.uniform(-2e-3, 2e-3), 22.0, None, None) for k in range(3)]
    rows.sort(key=lambda r: r[2])
    schema = "target string, plot long, t long, lon double, lat double, speed double, course double"
    cfg = fusion.FusionConfig(gate=300.0, max_age=60.0)
    build = lambda s: ordered.gated_stream(s.filter("target is not null"), s.filter("plot is not null"), 60.0, 300.0, delay="10 minutes")
    got = streamed(spark, tmp_path, rows, schema, build)
    whole = spark.createDataFrame(rows, schema)
    want = fusion.candidates(whole.filter("target is not null"), whole.filter("plot is not null").select(F.col("t").alias("frame"), "plot", "lon", "lat"), 60.0, cfg)
    plain = lambda r: (r["plot"], r["target"], round(r["distance"], 3), round(r["gate"], 3), round(r["cost"], 6))
    assert sorted(map(plain, got.collect())) == sorted(map(plain, want.collect())) and want.count() > 100


def test_particulars_alone_expire(spark, tmp_path):
    """A vessel that never sends a position does not stay in state for ever, and nobody is told of it."""
    names = "mmsi string, kind string, t long, lon double, lat double, speed double, course double, nav_status int, name string, ship_type string, length double"
    rows = [("a", "static", 3, None, None, None, None, None, "ANN", "cargo", 9.0), ("b", "dynamic", 5, 1.0, 2.0, 3.0, 4.0, 0, None, None, None)]
    got = streamed(spark, tmp_path, rows, names, lambda s: state.vessel_changes(s.withColumn("kind", F.coalesce("kind", F.lit("dynamic"))), expire_ms=60_000, static_ms=120_000), shuffled=1)
    assert sorted((r["mmsi"], r["change"]) for r in got.filter("mmsi <> 'end'").collect()) == [("b", "remove"), ("b", "upsert")]
