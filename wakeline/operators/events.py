"""The event store: deterministic ids, deduplicating upserts, reports, merges and maintenance."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_key(*parts: str | Column) -> Column:
    """SHA-256 over the parts joined by a separator that no part should hold; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def deduplicated(detections: DataFrame, key: list[str], latest: list[str], order: str = "detected_at", tie: str = "detection_id") -> DataFrame:
    """One event per key: first and last detection, how often, and the latest row's fields."""
    newest = F.max_by(F.struct(*latest), F.struct(order, tie))
    return detections.groupBy(*key).agg(F.min(order).alias("first_detected_at"), F.max(order).alias("last_detected_at"), F.count("*").alias("occurrences"), newest.alias("_l")).select(*key, "first_detected_at", "last_detected_at", "occurrences", *(F.col(f"_l.{c}").alias(c) for c in latest))


def upsert(store: DataFrame, new: DataFrame, key: list[str], latest: list[str]) -> DataFrame:
    """The store after new events of the shape of ``deduplicated`` came: spans widen, counts add, later fields win."""
    both = store.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    newest = F.max_by(F.struct(*latest), F.struct("last_detected_at", "_age"))
    out = both.groupBy(*key).agg(F.min("first_detected_at").alias("first_detected_at"), F.max("last_detected_at").alias("last_detected_at"), F.sum("occurrences").alias("occurrences"), newest.alias("_l"))
    return out.select(*key, "first_detected_at", "last_detected_at", "occurrences", *(F.col(f"_l.{c}").alias(c) for c in latest))


def keep_one(df: DataFrame, key: list[str], order: str, newest: bool = False) -> DataFrame:
    """One row per key, by smallest or largest ``order``."""
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def with_share(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and their percentage of all, most frequent first."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("_total"), 2)).drop("_total").orderBy(F.desc("n"), *by)  # one row


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 for none."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page by a total order, size clamped to 1..100, ``number`` to the pages there are."""
    size = max(1, min(100, size))
    last = max(1, -(-df.count() // size))
    number = max(1, min(number, last))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_facts(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row on a page as ``page`` takes it: count, page, page_size, total_pages, has_previous, has_next."""
    size = max(1, min(100, size))
    last = F.greatest(F.ceil(F.col("count") / size), F.lit(1)).cast("int")
    out = df.agg(F.count("*").alias("count")).withColumn("total_pages", last).withColumn("page", F.greatest(F.least(F.lit(number), F.col("total_pages")), F.lit(1)))
    return out.select("count", "page", F.lit(size).alias("page_size"), "total_pages", (F.col("page") > 1).alias("has_previous"), (F.col("page") < F.col("total_pages")).alias("has_next"))


def newest_page(df: DataFrame, most: int, order: str = "t", tie: str | None = None) -> DataFrame:
    """The newest rows, emitted in time order."""
    down = [F.desc(order), *([F.desc(tie)] if tie else [])]
    return df.orderBy(*down).limit(most).orderBy(order, *([tie] if tie else []))


def trajectory_span(start: datetime | None, end: datetime | None, now: datetime, event_specific: bool = False, most: timedelta = timedelta(hours=5)) -> tuple[datetime, datetime] | None:
    """The times that a trajectory is asked for: up to now and ``most`` long if nothing else is said; a longer or empty span raises. One event's trajectory has no limits (None)."""
    if event_specific:
        return None
    end = now if end is None else end
    start = end - most if start is None else start
    if start >= end:
        raise ValueError("the start must come before the end")
    if end - start > most:
        raise ValueError(f"a trajectory is given for {most} at most")
    return start, end


def search(events: DataFrame, feature: str | None = None, text: str | None = None, columns: tuple[str, ...] = (), start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Filters of the event list; the end is exclusive (``records.filter_time`` makes it the next day's start for a bare date)."""
    out = events if feature is None else events.filter(F.col("feature_id") == feature)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.col(c).cast("string")).contains(text.lower())
        out = out.filter(hit)
    if start is not None:
        out = out.filter(F.col("last_detected_at") >= start)
    return out if end is None else out.filter(F.col("last_detected_at") < end)


def cutoff(crossings: DataFrame, within: float = 86400.0) -> DataFrame:
    """When a crossing's trajectory ends (``leaves_at``): an exit's and a transit's own time, and for an entry the time of the
    next exit or transit of the same vessel and fence within a day, null if there is none. Other rows go."""
    moves = crossings.filter(F.col("direction").isin("enter", "exit", "transit"))
    out = F.col("direction") != "enter"
    w = Window.partitionBy("mmsi", "fence").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    leave = F.first(F.when(out, F.col("t")), ignorenulls=True).over(w)
    return moves.withColumn("leaves_at", F.when(out, F.col("t")).when(leave - F.col("t") <= within, leave))


def without_artifacts(points: DataFrame, detector: str, event: str = "event", times: tuple[str, ...] = ("timestamp", "time")) -> DataFrame:
    """Trajectory points that are no detector results stored by mistake: those name the detector as their event and have no report time."""
    has_time = F.lit(False)
    for c in times:
        has_time = has_time | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return points.filter(~F.coalesce(F.col(event) == detector, F.lit(False)) | has_time)


def trimmed(points: DataFrame, cutoffs: DataFrame, on: list[str]) -> DataFrame:
    """Trajectory points without those after their event's cutoff; events without one keep all."""
    return points.join(cutoffs.select(*on, "leaves_at"), on, "left").filter(F.col("leaves_at").isNull() | (F.col("t") <= F.col("leaves_at"))).drop("leaves_at")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upserts and removes between two states: key, change, and the new row's fields."""
    names = [c for c in new.columns if c != key]
    joined = old.select(key, F.struct(*names).alias("_o")).join(new.select(key, F.struct(*names).alias("_n")), key, "full_outer")
    kind = F.when(F.col("_n").isNull(), "remove").when(F.col("_o").isNull() | (F.col("_o") != F.col("_n")) | ~F.to_json("_o").eqNullSafe(F.to_json("_n")), "upsert")
    return joined.withColumn("change", kind).filter("change is not null").select(key, "change", *(F.col(f"_n.{c}").alias(c) for c in names))


def confirmed(df: DataFrame, by: list[str], label: str, order: str, times: int) -> DataFrame:
    """Debounce: rows at which a label has been seen ``times`` times in a row for the first time in its run."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = df.withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order))).filter(F.col("_nth") == times).drop("_new", "_run", "_nth")


def zone_search(zones: DataFrame, kinds: tuple[str, ...] = (), region: str | None = None, text: str | None = None, active: bool | None = True) -> DataFrame:
    """Filters of the zone list: types, region, text in the name, and whether in use (None: either)."""
    out = zones
    if kinds:
        out = out.filter(F.col("zone_type").isin(*kinds))
    if region is not None:
        out = out.filter(F.col("region") == region)
    if text:
        out = out.filter(F.lower("name").contains(text.lower()))
    return out if active is None else out.filter(F.col("is_active") == active)


def geojson(zones: DataFrame) -> DataFrame:
    """One GeoJSON feature per zone (name, zone_type, region, vertices)."""
    ring = F.transform(F.concat("vertices", F.slice("vertices", 1, 1)), lambda v: F.array(v["lon"], v["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(*(c for c in zones.columns if c != "vertices"))
    return zones.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))
