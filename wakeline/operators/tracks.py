"""Aggregates that describe a vessel's track or segment: extent, path, revisits, headings, status shares, pair features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def speed_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_points"), (F.max("t") - F.min("t")).alias("duration"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"), F.max("t").alias("last_t"),
    )


def shape(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """centroid, radius (largest distance to it), path, displacement and their ratio (null for no path), with further aggregates of the same rows."""
    key = Window.partitionBy(*by)
    w = key.orderBy("t")
    staged = df.withColumns({"_clon": F.avg("lon").over(key), "_clat": F.avg("lat").over(key), "_plon": F.lag("lon").over(w), "_plat": F.lag("lat").over(w)})
    place = F.struct("lon", "lat")
    agg = staged.groupBy(*by).agg(
        F.first("_clon").alias("centroid_lon"), F.first("_clat").alias("centroid_lat"), F.count("*").alias("n_points"),
        F.max(geo.haversine(F.col("lon"), F.col("lat"), F.col("_clon"), F.col("_clat"))).alias("radius"),
        F.coalesce(F.sum(geo.haversine(F.col("_plon"), F.col("_plat"), F.col("lon"), F.col("lat"))), F.lit(0.0)).alias("path"),
        F.min_by(place, "t").alias("_a"), F.max_by(place, "t").alias("_b"), *more,
    )
    moved = geo.haversine(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    return agg.withColumn("displacement", moved).withColumn("directness", F.when(F.col("path") > 1e-6, F.col("displacement") / F.col("path"))).drop("_a", "_b")


def _hull(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull in the plane of degrees (monotone chain)."""
    points = np.unique(np.column_stack([lon, lat]), axis=0, return_index=True)[1]
    if len(points) < 3:
        return points
    corners: list[int] = []
    for chain in (points.tolist(), points[::-1].tolist()):
        side: list[int] = []
        for i in chain:
            while len(side) > 1 and (lon[side[-1]] - lon[side[-2]]) * (lat[i] - lat[side[-2]]) <= (lat[side[-1]] - lat[side[-2]]) * (lon[i] - lon[side[-2]]):
                side.pop()
            side.append(i)
        corners += side[:-1]
    return np.array(corners)


def diameter(df: DataFrame, by: list[str], held: int = 4096) -> DataFrame:
    """Largest distance between any two points of a key; meant for extents up to some hundred kilometres.

    Only corners of the convex hull can be farthest apart. Each task first reduces the points it has of a key to their hull,
    so the group of a key holds the corners of partial hulls, however many points the key has.
    """
    own = df.select(*by, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).dropna(subset=["lon", "lat"])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def corners(parts: list[pd.DataFrame]) -> pd.DataFrame:
            points = pd.concat(parts)
            hulls = [g.iloc[_hull(g["lon"].to_numpy(), g["lat"].to_numpy())] for _, g in points.groupby(by, sort=False, dropna=False)]
            return pd.concat(hulls) if hulls else points

        parts: list[pd.DataFrame] = []
        for batch in batches:
            parts.append(batch)
            if sum(map(len, parts)) > held:
                parts = [corners(parts)]
                if len(parts[0]) > held // 2:  # very many keys: nothing to gain from waiting
                    yield parts.pop()
        if parts:
            yield corners(parts)

    def farthest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lon, lat = group["lon"].to_numpy(), group["lat"].to_numpy()
        at = _hull(lon, lat)
        x, y = np.radians(lon[at]), np.radians(lat[at])
        best = 0.0
        for a in range(0, len(at), 512):
            some = slice(a, a + 512)
            h = np.sin((y[some, None] - y) / 2) ** 2 + np.cos(y[some, None]) * np.cos(y) * np.sin((x[some, None] - x) / 2) ** 2
            best = max(best, float(2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(h.max(), 1.0)))))
        return pd.DataFrame([[*key, best]], columns=[*by, "diameter"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return own.mapInPandas(reduce, own.schema).groupBy(*by).applyInPandas(farthest, f"{kinds}, diameter double")


def revisits(df: DataFrame, by: list[str], grid: float = 200.0) -> DataFrame:
    """Visits of grid cells after collapsing stays, how many differ, and the share of repeated visits. The grid hangs on the mean position."""
    key = Window.partitionBy(*by)
    scale = math.radians(1) * geo.EARTH_M
    staged = df.withColumns({"_mx": F.avg("lon").over(key), "_my": F.avg("lat").over(key)})
    cx = F.floor((F.col("lon") - F.col("_mx")) * scale * F.greatest(F.lit(1e-6), F.cos(F.radians("_my"))) / grid)
    cy = F.floor((F.col("lat") - F.col("_my")) * scale / grid)
    celled = staged.withColumn("_cell", F.struct(cx.alias("x"), cy.alias("y")))
    entered = celled.withColumn("_new", ~F.col("_cell").eqNullSafe(F.lag("_cell").over(key.orderBy("t")))).filter("_new")
    agg = entered.groupBy(*by).agg(F.count("*").alias("n_visits"), F.countDistinct("_cell").alias("n_cells"))
    return agg.withColumn("revisit_ratio", 1 - F.col("n_cells") / F.col("n_visits"))


def heading_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """heading_arc, the smallest arc that holds all headings (null below two), and n_headings.

    Equal headings are counted first, and the largest gap between neighbours comes from a window over the different ones.
    """
    known = df.filter(F.col("heading").isNotNull())
    counted = known.groupBy(*by, F.pmod(F.col("heading").cast("double"), F.lit(360.0)).alias("_h")).agg(F.count("*").alias("_n"))
    ahead = F.lead("_h").over(Window.partitionBy(*by).orderBy("_h"))
    agg = counted.withColumn("_gap", ahead - F.col("_h")).groupBy(*by).agg(F.sum("_n").alias("n_headings"), F.max("_gap").alias("_gap"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    round_ = F.col("_lo") + 360 - F.col("_hi")
    arcs = agg.select(*by, F.when(F.col("n_headings") >= 2, 360 - F.greatest(round_, F.coalesce("_gap", F.lit(0.0)))).alias("heading_arc"), "n_headings")
    return df.select(*by).distinct().join(arcs, by, "left").withColumn("n_headings", F.coalesce("n_headings", F.lit(0)).cast("long"))


def share(condition: Column) -> Column:
    """Share of all rows; a missing value counts against it."""
    return F.count_if(condition) / F.count("*")


def most_frequent(df: DataFrame, by: list[str], column: str, order: str = "t") -> DataFrame:
    """The commonest value per key; of equal counts the one seen first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col("_first"), F.col(column))).alias(column))


def nominal_interval(df: DataFrame) -> DataFrame:
    """Median step between distinct times, over the whole table."""
    ahead = df.select("t").distinct().withColumn("_bucket", F.floor(F.col("t") / 86400))
    w = Window.partitionBy("_bucket").orderBy("t")
    inside = ahead.withColumn("step", F.lead("t").over(w) - F.col("t")).filter("step is not null").select("step")
    ends = ahead.groupBy("_bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = ends.withColumn("step", F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("hi")).filter("step is not null").select("step")  # one row a day
    return inside.unionByName(across).agg(F.percentile("step", F.lit(0.5)).alias("median_step"))


def pair_features(aligned: DataFrame, by: list[str], near: float = 100.0, far: float = 2000.0, slow: float = 1.0, fast: float = 8.0, course_gap: float = 20.0, lateral_gap: float = 30.0, speed_gap: float = 1.5) -> DataFrame:
    """Features of two vessels sailing together, from aligned samples with suffixes _a and _b."""
    d = geo.haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    side = geo.angle_between(geo.bearing(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")), geo.mean_course(F.col("course_a"), F.col("course_b")))
    rated = aligned.withColumns({"distance": d, "_side": side, "_turn": geo.angle_between(F.col("course_a"), F.col("course_b"))})
    agg = rated.groupBy(*by).agg(
        F.count("*").alias("n_points"), (F.max("t") - F.min("t")).alias("duration"), F.avg("speed_a").alias("mean_speed_a"), F.avg("speed_b").alias("mean_speed_b"),
        F.avg("distance").alias("mean_distance"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("std_distance"),
        share(F.col("distance").between(near, far)).alias("in_range"), share(F.col("_turn") <= course_gap).alias("same_course"), share(F.abs(F.col("_side") - 90) <= lateral_gap).alias("lateral"),
        share(F.abs(F.col("speed_a") - F.col("speed_b")) <= speed_gap).alias("same_speed"),
        F.covar_pop("speed_a", "speed_b").alias("_cov"), F.stddev_pop("speed_a").alias("_sa"), F.stddev_pop("speed_b").alias("_sb"),
    )
    flat = (F.col("_sa") < 1e-9) | (F.col("_sb") < 1e-9)
    correlation = F.when(F.col("n_points") < 2, 0.0).when(flat, F.when(F.abs(F.col("mean_speed_a") - F.col("mean_speed_b")) <= 1e-9, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("_cov"), F.col("_sa") * F.col("_sb")))
    together = F.col("mean_speed_a").between(slow, fast) & F.col("mean_speed_b").between(slow, fast)
    return agg.withColumns({"speed_correlation": correlation, "both_in_speed": together}).drop("_cov", "_sa", "_sb")
