"""Vessel state over streams: the latest report per vessel with particulars carried over, as a keyed processor with timers.

Event time rules: an older report never replaces newer state (it is counted as out of order); the same time with the same payload is a
duplicate, with another payload a correction; particulars are dropped once they are ``static_ms`` older than the position; a vessel
silent for ``expire_ms`` of event time is removed. Output rows are changes: upsert or
remove, with a version that grows by one per vessel and change. Reports older than the watermark (the delay) never reach the state; Spark counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sequence

POSITION = ("lon", "lat", "speed", "course", "nav_status")
PARTICULARS = ("name", "ship_type", "length")
STATE = "t timestamp, lon double, lat double, speed double, course double, nav_status int, name string, ship_type string, length double, static_t timestamp, version long, late long"
OUTPUT = "mmsi string, change string, t timestamp, lon double, lat double, speed double, course double, nav_status int, name string, ship_type string, length double, version long, late long"


class VesselState(StatefulProcessor):
    """Input rows: mmsi, kind (dynamic, static), t, and the columns of both kinds."""

    def __init__(self, expire_ms: int = 900_000, static_ms: int = 7 * 86_400_000):
        self.expire_ms, self.static_ms = expire_ms, static_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        names = [f.split()[0] for f in STATE.split(", ")]
        now = dict(zip(names, old, strict=True)) if old else dict.fromkeys(names)
        now["version"], now["late"] = now["version"] or 0, now["late"] or 0
        changed = False
        for row in pd.concat(list(rows)).sort_values("t", kind="stable").to_dict("records"):
            row = {k: None if pd.isna(v) else v for k, v in row.items()}
            dynamic = row["kind"] == "dynamic"
            since = now["t" if dynamic else "static_t"]
            if since is not None and row["t"] < pd.Timestamp(since):
                now["late"] += 1
                continue
            new = {c: row[c] for c in POSITION} if dynamic else {c: row[c] if row[c] is not None else now[c] for c in PARTICULARS}
            same_time = since is not None and row["t"] == pd.Timestamp(since)
            differs = any(now[c] != v for c, v in new.items())
            if dynamic and not same_time or differs:
                changed = True
            now.update(new)
            now["t" if dynamic else "static_t"] = row["t"].to_pydatetime()
        if now["t"] is not None and now["static_t"] is not None and pd.Timestamp(now["t"]) - pd.Timestamp(now["static_t"]) > pd.Timedelta(milliseconds=self.static_ms):
            now |= dict.fromkeys((*PARTICULARS, "static_t"))
            changed = True
        if now["nav_status"] is not None:
            now["nav_status"] = int(now["nav_status"])
        live = now["t"] is not None
        if changed and live:
            now["version"] += 1
        self.state.update(tuple(now[n] for n in names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live:
            self.handle.registerTimer(int(pd.Timestamp(now["t"]).timestamp() * 1000) + self.expire_ms)
        elif now["static_t"] is not None:  # particulars without a position go too
            self.handle.registerTimer(int(pd.Timestamp(now["static_t"]).timestamp() * 1000) + self.static_ms)
        if changed and live:
            yield self._row(key, "upsert", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE.split(", ")]
        now = dict(zip(names, self.state.get(), strict=True))
        self.state.clear()
        if now["t"] is not None:  # else nobody has been told of the vessel
            now["version"] += 1
            yield self._row(key, "remove", now)

    def _row(self, key, change: str, now: dict) -> pd.DataFrame:
        out = {"mmsi": key[0], "change": change, **{c: now[c] for c in ("t", *POSITION, *PARTICULARS, "version", "late")}}
        frame = pd.DataFrame([out])
        frame["t"] = pd.to_datetime(frame["t"])
        for c in ("lon", "lat", "speed", "course", "length"):
            frame[c] = frame[c].astype(float)
        frame["nav_status"] = frame["nav_status"].astype("Int32")
        return frame

    def close(self) -> None:
        pass


def vessel_changes(reports: DataFrame, expire_ms: int = 900_000, delay: str = "0 seconds", static_ms: int = 7 * 86_400_000) -> DataFrame:
    """The change stream of a stream (or batch) of reports. Needs the RocksDB state store on streams."""
    return reports.withWatermark("t", delay).groupBy("mmsi").transformWithStateInPandas(statefulProcessor=VesselState(expire_ms, static_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def latest_only(batch: DataFrame) -> DataFrame:
    """Coalescing for consumers of snapshots: a micro-batch's newest row per vessel."""
    return sequence.latest(batch)


def stay_sessions(reports: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of slow reports per vessel, closed by a gap of event time."""
    return reports.withWatermark("t", delay).groupBy("mmsi", F.session_window("t", gap)).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed")).select("mmsi", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean_speed")


def without_duplicates(reports: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Repeated deliveries of one report within the watermark, whatever channel they came by."""
    return reports.withWatermark("t", delay).dropDuplicatesWithinWatermark(["mmsi", "t", "lon", "lat", "speed", "course"])
