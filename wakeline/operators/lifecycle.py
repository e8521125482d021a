"""The life of alerts: which detections go on with an open alert, which begin one, and when an alert is over.

A detection has a signature: what it is about (its vessels, and what tells its events apart: a pair, a fence and direction, a zone, a
status). Detections of one signature that follow each other within ``gap`` seconds are one alert, whether or not every run of the detector sees the
vessel; a detection that its detector marks as new begins another one. An alert is over (recovered) once the clock is more than the gap past its
last detection. Ids follow from the signature and the first time, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import event_key

#: The columns that tell what a detection is about, and those that tell the events of one target apart; a detector has some of them.
TARGET = ("mmsi", "other_mmsi", "mmsi_a", "mmsi_b", "ais_id", "radar_id", "target_id", "ship_id", "blacklist_id", "camera")
KIND = ("feature_id", "pair", "fence", "direction", "zone", "area", "place", "behavior", "facility", "status", "event", "reason")


def signature(columns: list[str]) -> list[str]:
    """The columns of a detector's result that identify its alerts."""
    return [c for c in (*KIND, *TARGET) if c in columns]


def _opened(detections: DataFrame, by: list[str], gap: float, is_new: str | None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("t", *([F.desc(is_new)] if is_new else []))
    begins = F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True))
    if is_new:
        begins = begins | F.coalesce(F.col(is_new), F.lit(False))
    return detections.withColumn("_begins", begins).withColumn("_alert", F.sum(F.col("_begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def annotated(detections: DataFrame, by: list[str], gap: float, is_new: str | None = None) -> DataFrame:
    """The detections (signature columns ``by``, t, ...) with ``alert_id``, ``alert_since`` and ``alert_new`` (whether it begins its alert)."""
    run = Window.partitionBy(*by, "_alert")
    marked = _opened(detections, by, gap, is_new).withColumn("alert_since", F.min("t").over(run))
    return marked.withColumns({"alert_id": event_key(*by, "alert_since"), "alert_new": F.col("_begins")}).drop("_begins", "_alert")


def alerts(detections: DataFrame, by: list[str], gap: float, now: Column | float | None = None, is_new: str | None = None) -> DataFrame:
    """One row an alert: by, first_seen, last_seen, observations, ``state`` at the time ``now`` (the newest detection's if not given) and ``ended_at``.

    new: one time of detection only, and that is now; continuing: seen within the gap; recovered: over, with the time when that came about.
    An alert that a marked detection replaced is over at that time.
    """
    runs = _opened(detections, by, gap, is_new).groupBy(*by, "_alert").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("observations"))
    follows = F.lead("first_seen").over(Window.partitionBy(*by).orderBy("_alert"))
    runs = runs.withColumn("_next", follows).drop("_alert")
    if now is None:
        clock = detections.agg(F.max("t").alias("_now"))
        runs = runs.crossJoin(F.broadcast(clock))  # one row
    else:
        runs = runs.withColumn("_now", now if isinstance(now, Column) else F.lit(now))
    over = F.col("_next").isNotNull() | (F.col("_now") - F.col("last_seen") > gap)
    state = F.when(over, "recovered").when((F.col("first_seen") == F.col("last_seen")) & (F.col("last_seen") == F.col("_now")), "new").otherwise("continuing")
    ended = F.when(over, F.least(F.col("last_seen") + gap, F.col("_next")))
    return runs.withColumns({"state": state, "ended_at": ended}).drop("_next", "_now")
