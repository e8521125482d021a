"""Stateful operators that take a key's rows in event-time order, whatever order the micro-batches bring them in.

Rows wait in state until the watermark has passed them; then they are taken in order, so a stream gives what the batch operator
gives for the rows up to the watermark. What a key needs of its past stays in state as one Arrow table, of no more than the operator's window.
The clock column ``t`` is a timestamp.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import geo
from ..operators import spatial


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.BufferReader(raw)).read_pandas()


class InOrder(StatefulProcessor):
    """Subclasses say in ``advance`` what a key's rows that are due give, and what of them to keep."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "waiting binary, past binary, memo string")

    def advance(self, key: tuple, due: pd.DataFrame, past: pd.DataFrame, memo: dict, clock: float) -> tuple[pd.DataFrame | None, pd.DataFrame, dict, float | None]:
        """Rows out, the past to keep, the memo, and when to call again if nothing comes (epoch seconds). ``clock``: the watermark."""
        raise NotImplementedError

    def _held(self) -> tuple[pd.DataFrame | None, pd.DataFrame | None, dict]:
        if not self.rows.exists():
            return None, None, {}
        waiting, past, memo = self.rows.get()
        return (_unpacked(bytes(waiting)) if waiting else None), (_unpacked(bytes(past)) if past else None), json.loads(memo)

    def _run(self, key: tuple, waiting: pd.DataFrame | None, past: pd.DataFrame | None, memo: dict, watermark: int) -> Iterator[pd.DataFrame]:
        clock = watermark / 1000
        empty = (waiting if waiting is not None else past).iloc[:0] if waiting is not None or past is not None else pd.DataFrame({"t": pd.Series([], dtype="datetime64[us]")})
        due, later = empty, waiting
        if waiting is not None and len(waiting):
            passed = waiting["t"] <= pd.Timestamp(watermark, unit="ms")
            due, later = waiting[passed].sort_values(list(waiting.columns[waiting.columns != "t"].insert(0, "t")), kind="stable").reset_index(drop=True), waiting[~passed]
        out, kept, memo, again = self.advance(key, due, past if past is not None else empty, memo, clock)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [int(later["t"].min().timestamp() * 1000)] if later is not None and len(later) else []
        times += [int(again * 1000)] if again is not None else []
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
            self.rows.update((_packed(later) if later is not None and len(later) else None, _packed(kept) if len(kept) else None, json.dumps(memo)))
        elif len(kept) or memo:
            self.rows.update((None, _packed(kept) if len(kept) else None, json.dumps(memo)))
        elif self.rows.exists():
            self.rows.clear()
        if out is not None and len(out):
            yield out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, past, memo = self._held()
        new = pd.concat(list(rows), ignore_index=True)
        whole = new if waiting is None else pd.concat([waiting, new], ignore_index=True)
        yield from self._run(key, whole, past, memo, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, past, memo = self._held()
        yield from self._run(key, waiting, past, memo, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, by: list[str], processor: InOrder, output: str | StructType, delay: str) -> DataFrame:
    return rows.withWatermark("t", delay).groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


def _seconds(t: pd.Series) -> np.ndarray:
    return t.to_numpy("datetime64[us]").astype(np.int64) / 1e6


class Alerts(InOrder):
    """The open alert of a signature, see ``operators.lifecycle``: its first and last time and its count are all that stays."""

    def __init__(self, by: list[str], gap: float):
        self.by, self.gap = by, gap

    def _row(self, key: tuple, change: str, t: float, alert: dict) -> dict[str, Any]:
        parts = "\x1f".join(["" if k is None else str(k) for k in (*key, int(alert["since"]))])
        return {**dict(zip(self.by, key, strict=True)), "change": change, "t": pd.Timestamp(t, unit="s"), "alert_id": hashlib.sha256(parts.encode()).hexdigest(), "alert_since": pd.Timestamp(alert["since"], unit="s"), "observations": alert["n"]}

    def advance(self, key, due, past, memo, clock):
        out, alert = [], memo.get("alert")
        marks = due["is_new"].fillna(False).to_numpy(bool) if "is_new" in due.columns and len(due) else np.zeros(len(due), bool)
        at = _seconds(due["t"]) if len(due) else np.zeros(0)
        order = np.lexsort((~marks, at))  # of one time the marked come first
        for t, marked in zip(at[order].tolist(), marks[order].tolist(), strict=True):
            if alert is not None and (t - alert["last"] > self.gap or marked):
                out.append(self._row(key, "recovered", min(alert["last"] + self.gap, t), alert))
                alert = None
            change = "new" if alert is None else "continuing"
            alert = {"since": t, "last": t, "n": 1} if alert is None else {**alert, "last": t, "n": alert["n"] + 1}
            out.append(self._row(key, change, t, alert))
        if alert is not None and clock - alert["last"] > self.gap:
            out.append(self._row(key, "recovered", alert["last"] + self.gap, alert))
            alert = None
        again = None if alert is None else alert["last"] + self.gap + 0.001
        return pd.DataFrame(out) if out else None, past.iloc[:0], {} if alert is None else {"alert": alert}, again


def alert_changes(detections: DataFrame, by: list[str], gap: float, delay: str = "0 seconds") -> DataFrame:
    """The stream of an alert's changes: by, change (new, continuing, recovered), t, alert_id, alert_since, observations.

    detections: by, t (timestamp, whole seconds), and ``is_new`` if the detector marks its own. A vessel that a micro-batch does not mention keeps its alert
    until the watermark is more than ``gap`` seconds past its last detection.
    """
    kinds = ", ".join(f"`{c}` {detections.schema[c].dataType.simpleString()}" for c in by)
    own = detections.select(*by, "t", *(["is_new"] if "is_new" in detections.columns else []))
    return in_order(own, by, Alerts(by, gap), f"{kinds}, change string, t timestamp, alert_id string, alert_since timestamp, observations long", delay)


class Tail(InOrder):
    """A vessel's fixes of the last ``window`` seconds; the run at their end in which every fix keeps to a rule, once it is long enough."""

    def __init__(self, window: float, column: str, low: float, high: float, max_gap: float, min_points: int, min_seconds: float):
        self.window, self.column, self.low, self.high = window, column, low, high
        self.max_gap, self.min_points, self.min_seconds = max_gap, min_points, min_seconds

    def advance(self, key, due, past, memo, clock):
        if not len(due):
            newest = _seconds(past["t"]).max() if len(past) else None
            stays = newest is not None and clock - newest <= self.window
            return None, past if stays else past.iloc[:0], {}, newest + self.window + 0.001 if stays else None
        rows = pd.concat([past, due], ignore_index=True) if len(past) else due
        t, value = _seconds(rows["t"]), rows[self.column].to_numpy(float)
        holds = (value >= self.low) & (value <= self.high)
        breaks = ~holds  # a null value breaks too
        start = np.maximum.accumulate(np.where(breaks, np.arange(len(t)) + 1, 0))
        gapped = np.concatenate([[False], np.diff(t) > self.max_gap])
        start = np.maximum(start, np.maximum.accumulate(np.where(gapped, np.arange(len(t)), 0)))
        begin = np.searchsorted(t, t - self.window, side="left")  # what is older than the window is forgotten
        first = np.minimum(np.maximum(start, begin), len(t) - 1)
        i = np.arange(len(t))
        n, seconds = i - np.maximum(start, begin) + 1, t - t[first]
        found = holds & (n >= self.min_points) & (seconds >= self.min_seconds) & (i >= len(past))
        out = pd.DataFrame({"mmsi": key[0], "t": rows["t"][found], "since": rows["t"].to_numpy()[first[found]], "n_points": n[found].astype("int64"), "duration": seconds[found]})
        newest = t[-1]
        return out, rows[t >= newest - self.window], {}, newest + self.window + 0.001


def tails(fixes: DataFrame, column: str, low: float | None = None, high: float | None = None, window: float = 1800.0, max_gap: float = 90.0, min_points: int = 1, min_seconds: float = 0.0, delay: str = "0 seconds") -> DataFrame:
    """For each fix (mmsi, t, column) of a stream that ends a long enough run within the window: mmsi, t, since, n_points, duration.

    It gives what ``sequence.tail`` gives for the fixes of the last ``window`` seconds at that moment. State holds a vessel's window; a vessel that is silent as long is dropped.
    """
    processor = Tail(window, column, -np.inf if low is None else low, np.inf if high is None else high, max_gap, min_points, min_seconds)
    own = fixes.select("mmsi", "t", F.col(column).cast("double").alias(column))
    return in_order(own, ["mmsi"], processor, f"mmsi {fixes.schema['mmsi'].dataType.simpleString()}, t timestamp, since timestamp, n_points long, duration double", delay)


class TwoSensors(InOrder):
    """Radar plots of a region against the reports that can reach it: of each target the last two reports at or before a plot's time, as ``plans.fusion`` takes them."""

    def __init__(self, max_age: float, gate: float, scale: float, sigma_multiplier: float):
        self.max_age, self.gate, self.scale, self.sigma_multiplier = max_age, gate, scale, sigma_multiplier

    def advance(self, key, due, past, memo, clock):
        rows = pd.concat([past, due], ignore_index=True) if len(past) else due
        if not len(rows):
            return None, rows, {}, None
        rows = rows.assign(fresh_=np.arange(len(rows)) >= len(past), plot_=rows["plot"].notna()).sort_values(["t", "plot_"], kind="stable")  # a report of a plot's time serves it
        out, last, before = [], {}, {}
        for r in rows.itertuples(index=False):
            if not r.plot_:
                before[r.target], last[r.target] = last.get(r.target), r
            elif r.fresh_:
                out += self._gated(r, last, before)
        reports = rows[~rows["plot_"]]
        kept = reports.groupby("target", sort=False).tail(2)
        newest = kept.groupby("target")["t"].transform("max") if len(kept) else None
        old = clock - self.max_age
        kept = kept[_seconds(newest) >= old] if len(kept) else kept  # a target that is silent too long is forgotten
        kept = kept[list(due.columns)]
        again = float(_seconds(kept["t"]).max()) + self.max_age + 0.001 if len(kept) else None
        return pd.DataFrame(out) if out else None, kept, {}, again

    def _gated(self, plot, last, before):
        at = plot.t.timestamp()
        near = [(k, r) for k, r in last.items() if at - r.t.timestamp() <= self.max_age]
        if not near:
            return []
        k = geo.KNOT_MPS
        names = ("lon", "lat", "speed", "course")
        now = {c: np.array([getattr(r, c) for _, r in near], float) for c in names}
        was = {c: np.array([np.nan if (b := before.get(target)) is None else getattr(b, c) for target, _ in near], float) for c in names}
        t = np.array([r.t.timestamp() for _, r in near])
        dt = t - np.array([np.nan if (b := before.get(target)) is None else b.t.timestamp() for target, _ in near])
        dt = np.where(dt > 0, dt, np.nan)
        x = np.radians(now["lon"] - was["lon"]) * geo.EARTH_M * np.cos(np.radians(was["lat"])) / dt
        y = np.radians(now["lat"] - was["lat"]) * geo.EARTH_M / dt
        first = lambda *choices: np.where(np.isnan(choices[0]), np.where(np.isnan(choices[1]), 0.0, choices[1]), choices[0])
        own = lambda of, part: of["speed"] * k * part(np.radians(of["course"]))
        rate = np.nan_to_num(np.hypot(x - own(was, np.sin), y - own(was, np.cos)), nan=0.0)
        age = at - t
        lon = now["lon"] + np.degrees(first(own(now, np.sin), x) * age / (geo.EARTH_M * np.maximum(np.abs(np.cos(np.radians(now["lat"]))), 1e-9)))
        lat = now["lat"] + np.degrees(first(own(now, np.cos), y) * age / geo.EARTH_M)
        a, b = np.radians(plot.lat), np.radians(lat)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - plot.lon) / 2) ** 2
        distance = 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        gate, scale = self.gate + self.sigma_multiplier * rate * age, self.scale + rate * age
        return [{"frame": plot.t, "plot": int(plot.plot), "target": near[i][0], "distance": distance[i], "gate": gate[i], "cost": 1 - np.exp(-distance[i] / scale[i])} for i in np.flatnonzero(distance < gate)]


def gated_stream(ais: DataFrame, radar: DataFrame, max_age: float, gate: float = 2000.0, scale: float = 500.0, sigma_multiplier: float = 3.0, reach: float = 50_000.0, delay: str = "0 seconds") -> DataFrame:
    """Both sensors on one clock: frame, plot, target, distance, gate and cost of the pairs within their gate, as ``plans.fusion.candidates`` finds them.

    ais: target, t (timestamp), lon, lat, speed, course; radar: plot, t, lon, lat. The union is dealt by region, cells of ``reach`` metres: a plot to its own, a report to
    those it may be in while it serves. State holds two reports for each target of a region. A target is found within ``reach`` metres of its last report,
    so that must be more than what a vessel sails within ``max_age`` plus the widest gate.
    """
    size = F.lit(float(reach))
    numbers = {c: F.col(c).cast("double").alias(c) for c in ("lon", "lat", "speed", "course")}
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = ais.schema["target"].dataType.simpleString()
    reports = spatial.with_cells_around(ais.select("target", none("long", "plot"), "t", *numbers.values()), size)
    plots = spatial.with_cell(radar.select(none(kind, "target"), F.col("plot").cast("long").alias("plot"), "t", numbers["lon"], numbers["lat"], none("double", "speed"), none("double", "course")), size)
    names = ["_cx", "_cy", "t", "target", "plot", "lon", "lat", "speed", "course"]
    both = reports.select(*names).unionByName(plots.select(*names))
    return in_order(both, ["_cx", "_cy"], TwoSensors(max_age, gate, scale, sigma_multiplier), f"frame timestamp, plot long, target {kind}, distance double, gate double, cost double", delay)
