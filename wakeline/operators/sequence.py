"""Operators along each vessel's time axis, as window functions: one shuffle by vessel serves a whole chain of them.

Inputs have columns mmsi and t (epoch seconds) besides what an operator names; ``by`` names the partition columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

BY = ("mmsi",)


def _w(by: tuple[str, ...], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*(order or ("t",)))


def latest(df: DataFrame, by: tuple[str, ...] = BY, order: str = "t", tie: str | None = None, last_wins: bool = True) -> DataFrame:
    """The newest row per key; of equal times the last or the first by ``tie``, which the first needs. An aggregation with partial results, so a key with very many rows is no hot spot."""
    if tie is None and not last_wins:
        raise ValueError("the first of equal times needs a column that orders them")
    rest = [c for c in df.columns if c not in by]
    row = F.struct(*(F.col(f"`{c}`") for c in rest))
    if last_wins:
        found = df.groupBy(*by).agg(F.max_by(row, F.struct(*dict.fromkeys([order, tie or order]))).alias("_row"))
    else:  # the first of the newest time; ties may be of any type that can be ordered
        newest = df.groupBy(*by, order).agg(F.min_by(row, tie).alias("_row"))
        found = newest.groupBy(*by).agg(F.max_by("_row", order).alias("_row"))
    return found.select(*by, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def fresh(df: DataFrame, most_age: float, by: tuple[str, ...] = BY) -> DataFrame:
    """All rows of the keys whose newest row is at most ``most_age`` seconds older than the newest of all."""
    newest = df.groupBy(*by).agg(F.max("t").alias("_latest"))
    overall = newest.agg(F.max("_latest").alias("_ref"))
    keep = newest.crossJoin(F.broadcast(overall)).filter(F.col("_ref") - F.col("_latest") <= most_age).select(*by)  # one row
    return df.join(keep, list(by), "left_semi")


def with_gaps(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """``gap``: seconds since the key's previous row, null for its first."""
    return df.withColumn("gap", F.col("t") - F.lag("t").over(_w(by)))


def sessions(df: DataFrame, most_gap: float, by: tuple[str, ...] = BY) -> DataFrame:
    """``session``: counts up from 0 where the gap exceeds ``most_gap``."""
    return with_gaps(df, by).withColumn("session", F.sum(F.when(F.col("gap") > most_gap, 1).otherwise(0)).over(_w(by))).drop("gap")


def tail(df: DataFrame, keeps: Column, most_gap: float | None = None, near_latest: Column | None = None, same: tuple[str, ...] = (), by: tuple[str, ...] = BY) -> DataFrame:
    """The longest suffix of each key's rows in which every row ``keeps``, gaps are within ``most_gap``, ``near_latest``
    (may use latest_lon and latest_lat) holds, and the columns ``same`` equal the latest row's.

    A row breaks the suffix if it fails itself, or if the gap *after* it is too long; the suffix is all rows after the last break.
    """
    w = _w(by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    needed = [*same, *(("lon", "lat") if near_latest is not None else ())]
    staged = df.withColumns({f"latest_{c}": F.last(c).over(whole) for c in dict.fromkeys(needed)}) if needed else df
    fails = ~F.coalesce(keeps, F.lit(False))
    if near_latest is not None:
        fails = fails | ~F.coalesce(near_latest, F.lit(False))
    for c in same:
        fails = fails | ~F.col(c).eqNullSafe(F.col(f"latest_{c}"))
    if most_gap is not None:
        fails = fails | F.coalesce(F.lead("t").over(w) - F.col("t") > most_gap, F.lit(False))
    broken = staged.withColumn("_order", F.row_number().over(w)).withColumn("_break", F.when(fails, F.col("_order")).otherwise(0))
    # a gap after a row breaks behind it: rows after the last break stay
    return broken.withColumn("_last", F.max("_break").over(Window.partitionBy(*by))).filter("_order > _last").select(*df.columns)


def islands(df: DataFrame, on: Column, most_gap: float | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Rows where ``on`` holds, with ``island`` numbering their unbroken runs per key."""
    w = _w(by)
    marked = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    breaks = ~F.col("_on")
    if most_gap is not None:
        breaks = breaks | F.coalesce(F.col("t") - F.lag("t").over(w) > most_gap, F.lit(False))
    return marked.withColumn("_break", breaks.cast("int")).withColumn("island", F.sum("_break").over(w)).filter("_on").drop("_on", "_break")


def streaks(df: DataFrame, most_gap: float, by: tuple[str, ...]) -> DataFrame:
    """Consecutive observations per key: first_seen, last_seen, observations, duration of each run without a longer gap."""
    run = sessions(df.select(*by, "t").distinct(), most_gap, by)
    return run.groupBy(*by, "session").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("observations")).withColumn("duration", F.col("last_seen") - F.col("first_seen"))


def carried(df: DataFrame, column: str, usable: Column, name: str, by: tuple[str, ...] = BY) -> DataFrame:
    """``name``: the column's last usable value before this row."""
    return df.withColumn(name, F.last(F.when(usable, F.col(column)), ignorenulls=True).over(_w(by).rowsBetween(Window.unboundedPreceding, -1)))


def ever(df: DataFrame, flag: Column, name: str, by: tuple[str, ...] = BY) -> DataFrame:
    """``name``: whether the flag held at this row or before."""
    return df.withColumn(name, F.max(F.coalesce(flag, F.lit(False))).over(_w(by).rowsBetween(Window.unboundedPreceding, 0)))


def next_time(df: DataFrame, when: Column, name: str, within: float | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """``name``: time of the first later row where ``when`` holds, if within so many seconds."""
    found = F.first(F.when(when, F.col("t")), ignorenulls=True).over(_w(by).rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(name, found if within is None else F.when(found - F.col("t") <= within, found))


def bounded_history(df: DataFrame, seconds: float, most: int, tie: str, by: tuple[str, ...] = BY) -> DataFrame:
    """One row per key and time (the last by ``tie``), no older than ``seconds`` before the newest, the ``most`` newest."""
    single = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "t").orderBy(F.col(tie).desc()))).filter("_n = 1").drop("_n")
    newest = F.max("t").over(Window.partitionBy(*by))
    kept = single.withColumn("_newest", newest).filter(F.col("t") >= F.col("_newest") - seconds)
    return kept.withColumn("_n", F.row_number().over(_w(by, F.col("t").desc()))).filter(F.col("_n") <= most).drop("_n", "_newest")


def grown_history(stored: DataFrame, incoming: DataFrame, seconds: float, most: int, tie: str, by: tuple[str, ...] = BY) -> DataFrame:
    """The bounded history after new rows came; at equal times a new row wins. A key whose new rows end more than ``seconds`` before its stored
    ones is a replay that began again: its stored rows go."""
    ends = incoming.groupBy(*by).agg(F.max("t").alias("_in")).join(stored.groupBy(*by).agg(F.max("t").alias("_was")), list(by))
    again = ends.filter(F.col("_in") < F.col("_was") - seconds).select(*by)
    kept = stored.join(again, list(by), "left_anti")
    order = lambda df, age: df.withColumn("_order", F.struct(F.lit(age).alias("age"), F.col(tie).alias("tie")))
    return bounded_history(order(kept, 0).unionByName(order(incoming, 1)), seconds, most, "_order", by).drop("_order")


def versions(df: DataFrame, changed: Column, by: tuple[str, ...] = BY) -> DataFrame:
    """``version``: goes up by one at each row that changed anything."""
    return df.withColumn("version", F.sum(F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).over(_w(by)))


def interpolated(
    df: DataFrame, rate: Column, most_gap: float, values: tuple[str, ...] = ("lon", "lat"), circular: tuple[str, ...] = (), by: tuple[str, ...] = BY, most_knots: float | None = None,
) -> DataFrame:
    """Positions at a nominal rate (seconds, per row) between neighbouring rows at most ``most_gap`` apart and, if given, not further than a speed allows.

    Emits the row itself and the steps up to the next one. Numbers in ``values`` go linearly, and stay as they are if the next
    one is null; ``lon`` goes the short way round the globe; angles in ``circular`` the short way round, or take the side that is known.
    """
    w = _w(by)
    ahead = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("t", *values, *circular)}).withColumn("_rate", rate)
    span = F.col("next_t") - F.col("t")
    apart = span.isNull() | (span > most_gap) | (span <= 0)
    if most_knots is not None:
        run = geo.haversine(F.col("lon"), F.col("lat"), F.col("next_lon"), F.col("next_lat"))
        apart = apart | (run > most_knots * geo.KNOT_MPS * span)
    steps = F.when(apart, F.lit(0)).otherwise(F.floor((span - 1) / F.col("_rate")))
    out = ahead.withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(steps, F.lit(0)).cast("int"))))
    part = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(F.col("step") * F.col("_rate") / span)
    turn = lambda c: F.pmod(F.col(f"next_{c}") - F.col(c) + 540, F.lit(360.0)) - 180

    def moved(c: str) -> Column:
        if c == "lon":
            return F.when(F.abs(F.col("next_lon") - F.col("lon")) <= 180, F.col("lon") + (F.col("next_lon") - F.col("lon")) * part).otherwise(F.pmod(F.col("lon") + turn("lon") * part + 180, F.lit(360.0)) - 180)
        return F.coalesce(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * part, F.col(c))

    between = {c: moved(c) for c in values} | {c: F.coalesce(F.pmod(F.col(c) + turn(c) * part, F.lit(360.0)), F.col(c), F.col(f"next_{c}")) for c in circular}
    at = (F.col("t") + F.col("step") * F.col("_rate")).alias("t")
    return out.select(*by, at, "step", *(F.when(F.col("step") == 0, F.col(c)).otherwise(v).alias(c) for c, v in between.items()))


def sliding(df: DataFrame, size: int, stride: int = 1, by: tuple[str, ...] = BY) -> DataFrame:
    """Windows of ``size`` consecutive rows every ``stride`` rows: window index, first and last time, the rows' times."""
    w = _w(by)
    return (
        df.withColumns({"_n": F.row_number().over(w) - 1, "times": F.collect_list("t").over(w.rowsBetween(0, size - 1))})
        .filter((F.size("times") == size) & (F.col("_n") % stride == 0))
        .select(*by, (F.col("_n") / stride).cast("long").alias("window"), F.col("t").alias("first_t"), F.element_at("times", -1).alias("last_t"), "times")
    )


def latest_window(df: DataFrame, size: int, by: tuple[str, ...] = BY) -> DataFrame:
    """The last ``size`` rows of each key as one window of the shape of ``sliding``; keys with fewer rows have none."""
    w = Window.partitionBy(*by).orderBy(F.desc("t"))
    last = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("times"))
    return last.filter(F.size("times") == size).select(*by, F.lit(0).cast("long").alias("window"), F.col("times")[0].alias("first_t"), F.element_at("times", -1).alias("last_t"), "times")


def window_paths(samples: DataFrame, windows: DataFrame, target: str, by: tuple[str, ...], values: tuple[str, ...] = ("lon", "lat"), least: int = 3, tie: str | None = None) -> DataFrame:
    """Each target's path through windows of times (``sliding`` over the distinct times of a scene): by, window, target, place (from 0), t, the values, ``known``.

    A target needs ``least`` samples with all values in a window. Between two of them the others lie on a line by place, before the first and after the last they stay as that
    is; of samples of one time the first by ``tie`` counts.
    """
    once = samples.groupBy(*by, target, "t").agg(F.min_by(F.struct(*values), tie or F.struct(*values)).alias("_v"))
    placed = windows.select(*by, "window", "times", F.posexplode("times").alias("place", "t"))
    whole = F.lit(True)
    for c in values:
        whole = whole & F.col(f"_v.{c}").isNotNull() & ~F.isnan(F.col(f"_v.{c}").cast("double"))
    known = placed.join(once.filter(whole), [*by, "t"]).groupBy(*by, "window", target).agg(F.sort_array(F.collect_list(F.struct("place", *(F.col(f"_v.{c}").cast("double").alias(c) for c in values)))).alias("_k"))
    paths = known.filter(F.size("_k") >= least).join(placed, [*by, "window"])
    at = F.col("place")
    before, after = F.element_at(F.filter("_k", lambda k: k["place"] <= at), -1), F.get(F.filter("_k", lambda k: k["place"] >= at), 0)
    sided = paths.withColumns({"_a": F.when(F.col("_k")[0]["place"] <= at, before).otherwise(F.col("_k")[0]), "_b": F.coalesce(after, F.element_at("_k", -1))})
    part = F.when(F.col("_b.place") > F.col("_a.place"), (at - F.col("_a.place")) / (F.col("_b.place") - F.col("_a.place"))).otherwise(0.0)
    line = {c: F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * part for c in values}
    return sided.select(*by, "window", target, "place", "t", *(v.alias(c) for c, v in line.items()), ((F.col("_a.place") == at) | (F.col("_b.place") == at)).alias("known"))


def merged_intervals(df: DataFrame, start: str, end: str, slack: float, by: tuple[str, ...]) -> DataFrame:
    """Intervals of a key that overlap or lie within ``slack`` of each other become one: group_start, group_end, n."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = df.withColumn("_new", F.coalesce(F.col(start) - reach > slack, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*by, "_run").agg(F.min(start).alias("group_start"), F.max(end).alias("group_end"), F.count("*").alias("n")).drop("_run")
