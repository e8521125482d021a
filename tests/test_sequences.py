"""Window operators and folds against plain loops."""

from __future__ import annotations

import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import folds, sequence, temporal, tracks


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))


def random_tracks(seed, vessels=5, n=60):
    rng = random.Random(seed)
    rows = []
    for m in range(vessels):
        t, lon, lat = 0, 113.0, 22.0
        for _ in range(rng.randint(1, n)):
            t += rng.choice([30, 60, 60, 60, 400])
            lon += rng.uniform(-4e-4, 4e-4)
            lat += rng.uniform(-4e-4, 4e-4)
            jump = 0.5 if rng.random() < 0.08 else 0.0
            rows.append((f"v{m}", t, lon + jump, lat, rng.uniform(0, 3), rng.uniform(0, 360)))
    return rows


COLUMNS = "mmsi string, t long, lon double, lat double, speed double, course double"


def by_vessel(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tail_equals_reverse_loop(spark, seed):
    rows = random_tracks(seed)
    want = set()
    for m, track in by_vessel(rows).items():
        last, kept = track[-1], []
        for i in range(len(track) - 1, -1, -1):
            r = track[i]
            if r[4] > 2.2 or metres(r[2:4], last[2:4]) > 90_000 or (kept and kept[-1][1] - r[1] > 90):
                break
            kept.append(r)
        want |= {(m, r[1]) for r in kept}
    near = geo.haversine(F.col("lon"), F.col("lat"), F.col("latest_lon"), F.col("latest_lat")) <= 90_000
    got = sequence.tail(spark.createDataFrame(rows, COLUMNS), F.col("speed") <= 2.2, 90, near)
    assert {(r["mmsi"], r["t"]) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_folds_equal_loops(spark, seed):
    rows = random_tracks(seed)
    df = spark.createDataFrame(rows, COLUMNS)

    def bad(a, b):
        s = b[1] - a[1]
        return s <= 0 or (metres(a[2:4], b[2:4]) >= 500 and metres(a[2:4], b[2:4]) / s * 1.943844492 > 80)

    def sound(track):
        out = track[:1]
        for here, after in zip(track[1:], track[2:], strict=False):
            if (bad(out[-1], here), bad(here, after), bad(out[-1], after)) != (True, True, False):
                out.append(here)
        return out + track[-1:]

    def reachable(points):
        return functools.reduce(lambda kept, p: kept if bad(kept[-1], p) else [*kept, p], points[1:], points[:1])

    clean, thin, turned = set(), set(), {}
    for m, track in by_vessel(rows).items():
        clean |= {(m, r[1]) for r in (track if len(track) < 3 else reachable(sound(track)))}
        thinned = track[:1]
        for r in track[1:]:
            if metres(thinned[-1][2:4], r[2:4]) >= 40:
                thinned.append(r)
        thin |= {(m, r[1]) for r in thinned}
        taken = []
        for r in track:
            if r[4] >= 0.5 and (not taken or r[1] - taken[-1][1] >= 90):
                taken.append(r)
        turns = [min((abs(a[5] - b[5])) % 360, 360 - abs(a[5] - b[5]) % 360) for a, b in zip(taken, taken[1:], strict=False)]
        turned[m] = sum(x >= 30 for x in turns)
    assert {(r["mmsi"], r["t"]) for r in folds.without_jumps(df, ["mmsi"]).collect()} == clean
    assert {(r["mmsi"], r["t"]) for r in folds.thinned(df, 40.0, ["mmsi"]).collect()} == thin
    assert {r["mmsi"]: r["n_turns"] for r in folds.turns(df, ["mmsi"], 30.0, 90.0, 0.5).collect()} == turned


def test_latest_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3)], "mmsi string, t long, k long")
    assert sequence.latest(df, tie="k").first()["k"] == 3
    assert sequence.latest(df, tie="k", last_wins=False).first()["k"] == 2


def test_latest_of_text_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 2, "b"), ("a", 1, "a")], "mmsi string, t long, k string")
    assert sequence.latest(df, tie="k", last_wins=False).first()["k"] == "b" and sequence.latest(df, tie="k").first()["k"] == "x"


def test_sessions_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 300, 601)], "mmsi string, t long")
    assert [r["session"] for r in sequence.sessions(df, 300).orderBy("t").collect()] == [0, 0, 1]


def test_history_is_bounded(spark):
    df = spark.createDataFrame([("a", t, t) for t in range(0, 1000, 10)] + [("a", 990, 5000)], "mmsi string, t long, k long")
    got = sequence.bounded_history(df, 500, 20, "k").orderBy("t").collect()
    assert len(got) == 20 and got[-1]["k"] == 5000 and got[0]["t"] == 800


def test_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 7), ("a", 12, 20), ("a", 40, 41)], "k string, s long, e long")
    got = sequence.merged_intervals(df, "s", "e", 5, ("k",)).orderBy("group_start").collect()
    assert [(r["group_start"], r["group_end"], r["n"]) for r in got] == [(0, 20, 3), (40, 41, 1)]


def test_stored_points_take_part_in_sampling(spark):
    points = lambda *ts: spark.createDataFrame([("a", t, 113.0 + 1e-5 * t, 22.0) for t in ts], "mmsi string, t long, lon double, lat double")
    new, stored = points(0, 5, 10, 20, 30, 300), points(10, 28)
    assert sorted(r["t"] for r in folds.samples(new, 10.0, 180.0, ["mmsi"], stored).collect()) == [0, 20, 300]
    assert sorted(r["t"] for r in folds.samples(new, 10.0, 180.0, ["mmsi"]).collect()) == [0, 10, 20, 30, 300]


def test_episodes_part_intervals(spark):
    rows = [("a", 0, 10, None), ("a", 12, 15, "x"), ("a", 16, 18, None), ("a", 19, 40, "y"), ("a", 41, 42, "y"), ("a", 60, 61, "y"), ("b", 0, 1, "x")]
    df = spark.createDataFrame(rows, "k string, s long, e long, w string")
    got = sorted(map(tuple, folds.merged_episodes(df, "s", "e", "w", 5, ["k"]).collect()))
    assert got == [("a", 0, 18, 3, "x"), ("a", 19, 42, 2, "y"), ("a", 60, 61, 1, "y"), ("b", 0, 1, 1, "x")]
    assert folds.merged_episodes(df.limit(0), "s", "e", "w", 5, ["k"]).count() == 0


def test_interpolation_keeps_to_what_is_possible(spark):
    df = spark.createDataFrame([("a", 0, 179.9, 0.0, None), ("a", 100, -179.9, 0.0, 10.0), ("a", 200, -170.0, 0.0, 10.0)], "mmsi string, t long, lon double, lat double, course double")
    got = sequence.interpolated(df, F.lit(50), 600, circular=("course",), most_knots=500.0).orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 50, 100, 200]  # the last leg is too fast
    assert abs(got[1]["lon"]) == pytest.approx(180.0) and got[1]["course"] == 10.0 and got[0]["course"] is None


def test_interpolation_takes_the_short_way_round(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0, 350.0), ("a", 40, 4.0, 0.0, 10.0), ("a", 5000, 9.0, 9.0, 0.0)], "mmsi string, t long, lon double, lat double, course double")
    got = sequence.interpolated(df, F.lit(10), 600, circular=("course",)).orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 10, 20, 30, 40, 5000]
    assert [r["lon"] for r in got] == [0, 1, 2, 3, 4, 9]
    assert [r["course"] for r in got][:5] == [350, 355, 0, 5, 10]


@pytest.mark.parametrize("seed", [7, 8])
def test_diameter_is_exact(spark, seed):
    rows = random_tracks(seed)
    want = {m: max((metres(a[2:4], b[2:4]) for a in t for b in t), default=0) for m, t in by_vessel(rows).items()}
    got = {r["mmsi"]: r["diameter"] for r in tracks.diameter(spark.createDataFrame(rows, COLUMNS), ["mmsi"]).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_alignment_is_one_to_one_in_order(spark, seed):
    rng = random.Random(seed)
    a, b = (sorted({rng.randint(0, 2000) for _ in range(40)}) for _ in range(2))
    want, free = [], list(b)
    for x in a:  # the oldest that is free, near enough and not before one that is taken
        partner = next((y for y in free if abs(x - y) <= 30), None)
        if partner is not None:
            want.append((x, partner))
            free = [y for y in free if y > partner]
    side = lambda x: spark.createDataFrame([("p", t) for t in x], "pair string, t long")
    assert sorted((r["t_a"], r["t_b"]) for r in temporal.align(side(a), side(b), ["pair"], 30).collect()) == want


def test_as_of_and_validity(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 99), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 7, 2)], "k string, t long, v long")
    got = {(r["k"], r["t"]): r["as_of_v"] for r in temporal.as_of(left, right, ["k"], ["v"], 20).collect()}
    assert got == {("a", 5): 1, ("a", 10): 2, ("a", 99): None, ("b", 5): None}
    spans = spark.createDataFrame([("a", None, 6, "x"), ("a", 8, None, "y")], "k string, s long, e long, n string")
    assert {(r["t"], r["n"]) for r in temporal.valid_at(left, spans, ["k"], "s", "e").collect()} == {(5, "x"), (10, "y"), (99, "y")}
