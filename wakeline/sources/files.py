"""Readers: report folders, bounded loads, sensor tables, zones, coastline and weather feeds. All by Spark's readers or from text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, records

#: Alias columns of raw reports, first filled one wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "mmsi": ("mmsi", "MMSI"), "timestamp": ("timestamp", "DateTime", "time"), "lon": ("longitude", "lon", "Y"), "lat": ("latitude", "lat", "X"),
    "speed": ("speed", "sog"), "course": ("course", "cog"), "heading": ("heading", "true_heading"), "rot": ("rot", "rate_of_turn"),
    "name": ("name",), "nav_status": ("status", "nav_status"), "msg_type": ("msg_type", "message_type", "type"), "at_dock": ("at_dock",),
    "port_name": ("matchedPortName", "matched_port_name"), "length": ("length",), "width": ("width",), "draught": ("draught", "draft"),
    "ship_type": ("ship_type", "ship_and_cargo_type", "vessel_type"), "imo": ("imo",), "flag": ("flag",), "iso3": ("iso3",),
    "accuracy": ("accuracy", "position_accuracy"), "source": ("source", "receiver_id"), "channel": ("channel", "radio_channel"),
}


def report_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below a folder, every column as text, with the file's path and its change time (size and time make its signature)."""
    raw = spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", mode="PERMISSIVE").csv(folder)
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.concat_ws(":", F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time")).alias("signature"))


def unseen(reports: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of files whose (file, signature) has not been read: a changed file is read again, an unchanged one is not."""
    return reports.join(done.select("file", "signature").distinct(), ["file", "signature"], "left_anti")


def canonical(raw: DataFrame) -> DataFrame:
    """The fixed columns from whatever aliases are there; absent ones are null. ``t`` is the event time in epoch seconds."""
    have = {c.lower(): c for c in raw.columns}
    text = lambda names: [F.col(f"`{have[n.lower()]}`").cast("string") for n in dict.fromkeys(names) if n.lower() in have]
    out = raw.select(*(records.first_filled(*text(names)).alias(c) if text(names) else F.lit(None).cast("string").alias(c) for c, names in ALIASES.items()))
    return out.withColumns({
        "t": F.unix_micros(records.event_time(F.col("timestamp"))) / 1e6, "nav_status": records.whole(F.col("nav_status")), "msg_type": records.whole(F.col("msg_type")), "at_dock": records.truth(F.col("at_dock")),
        "name": records.clean_name(F.col("name")), "iso3": F.upper("iso3"), **{c: records.finite(F.col(c)) for c in ("length", "width", "draught", "accuracy")},
    })


def load_reports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(positions, particulars), normalised."""
    raw = canonical(report_folder(spark, folder))
    positions, particulars = records.split_reports(raw)
    return records.normalise(positions.filter("t is not null")), particulars.withColumn("mmsi", records.valid_mmsi(F.col("mmsi"))).filter("mmsi is not null and t is not null")


def bounded(reports: DataFrame, first_vessels: int | None = None, mmsi: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """A load limited by vessels and time, one row per vessel and time (the last by file and order column ``seq``, if there).

    The first N vessels are the first by their earliest time, then number: a defined order instead of the file's.
    """
    out = reports
    if mmsi is not None:
        out = out.filter(F.col("mmsi").isin(*mmsi))
    if start is not None:
        out = out.filter(F.col("t") >= start)
    if end is not None:
        out = out.filter(F.col("t") <= end)
    if first_vessels is not None:
        chosen = out.groupBy("mmsi").agg(F.min("t").alias("_t")).orderBy("_t", "mmsi").limit(first_vessels).select("mmsi")
        out = out.join(chosen, "mmsi", "left_semi")
    order = [F.col(c).desc_nulls_last() for c in ("file", "seq") if c in out.columns] or [F.col("t")]
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("mmsi", "t").orderBy(*order))).filter("_n = 1").drop("_n")


def sensor_table(spark: SparkSession, path: str) -> DataFrame:
    """A sensor CSV (compression by extension) with DateTime, ID, X (latitude), Y (longitude) and optional speed, course, GTID.

    Epoch times share one unit per table, told by the largest magnitude; rows without time, id or position go.
    """
    raw = spark.read.options(header=True).csv(path)
    missing = {"DateTime", "ID", "X", "Y"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    extra = [c for c in ("speed", "course", "GTID") if c in raw.columns]
    number = records.finite(F.col("DateTime"))
    peak = F.broadcast(raw.agg(F.max(F.abs(number)).alias("_peak")))  # one row
    scale = F.when(F.col("_peak") < 1e11, 1.0).when(F.col("_peak") < 1e14, 1e3).when(F.col("_peak") < 1e17, 1e6).otherwise(1e9)
    t = F.coalesce(number / scale, F.unix_micros(F.try_to_timestamp("DateTime")) / 1e6)
    kept = {"speed", "course"}
    out = raw.crossJoin(peak).select(t.alias("t"), F.col("ID").alias("target"), records.finite(F.col("Y")).alias("lon"), records.finite(F.col("X")).alias("lat"), *((records.finite(F.col(c)) if c in kept else F.col(c)).alias(c) for c in extra))
    return out.dropna(subset=["t", "target", "lon", "lat"])


def scene_pairs(files: DataFrame, left: str = r"AIS_(\d+)_([^/]*)\.csv", right: str = r"Radar_(\d+)_([^/]*)\.csv") -> DataFrame:
    """(scene, suffix, left, right) of the scenes that have both files, from a column ``file``."""
    side = lambda pattern, name: files.filter(F.col("file").rlike(pattern)).select(F.regexp_extract("file", pattern, 1).alias("scene"), F.regexp_extract("file", pattern, 2).alias("suffix"), F.col("file").alias(name))
    return side(left, "left").join(side(right, "right"), ["scene", "suffix"])


def route_points(spark: SparkSession, path: str, least_speed: float = 2.0) -> DataFrame:
    """Four columns of a track table, filtered in the scan, for the route grid."""
    return spark.read.parquet(path).select(F.col("Longitude").alias("lon"), F.col("Latitude").alias("lat"), F.col("COG").alias("course"), F.col("SOG").alias("speed")).filter(F.col("speed") >= least_speed)


def coastline(spark: SparkSession, path: str) -> DataFrame:
    """Segments (segment, x1, y1, x2, y2) of a JSON file (gzip by extension) of lines: {"lines": [[[lon, lat], ...], ...]}."""
    lines = spark.read.schema("lines array<array<array<double>>>").option("multiLine", True).json(path).select(F.posexplode("lines").alias("line", "points"))
    pairs = lines.select("line", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("i", "p"))
    return pairs.select(F.concat_ws("-", "line", "i").alias("segment"), F.col("p.a")[0].alias("x1"), F.col("p.a")[1].alias("y1"), F.col("p.b")[0].alias("x2"), F.col("p.b")[1].alias("y2"))


def time_bucket(t: Column, seconds: int = 30) -> Column:
    return (F.floor(t / seconds) * seconds).cast("long")


def in_needed_buckets(points: DataFrame, windows: DataFrame, seconds: int = 30) -> DataFrame:
    """Points (mmsi, t) within windows (event, mmsi, start, end), joined through time buckets so only needed buckets meet."""
    spread = windows.withColumn("_bucket", F.explode(F.sequence(time_bucket(F.col("start"), seconds), time_bucket(F.col("end"), seconds), F.lit(seconds).cast("long"))))
    return points.withColumn("_bucket", time_bucket(F.col("t"), seconds)).join(spread, ["mmsi", "_bucket"]).filter(F.col("t").between(F.col("start"), F.col("end"))).drop("_bucket")


def timed_files(spark: SparkSession, folder: str, glob: str = "*.csv", pattern: str = r"(\d{14})[^/]*$", form: str = "yyyyMMddHHmmss", seconds: int = 30) -> DataFrame:
    """(path, bucket) of the files of a folder that have their time in their name; nothing of them is read."""
    named = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path")
    stamp = F.regexp_extract("path", pattern, 1)
    return named.filter(stamp != "").select("path", time_bucket(F.unix_timestamp(stamp, form), seconds).alias("bucket"))


def needed_files(files: DataFrame, windows: DataFrame, seconds: int = 30) -> list[str]:
    """The paths whose bucket lies in a window (start, end); files: path, bucket. One path a file that will be read."""
    spread = windows.select(F.explode(F.sequence(time_bucket(F.col("start"), seconds), time_bucket(F.col("end"), seconds), F.lit(seconds).cast("long"))).alias("bucket")).distinct()
    return [r["path"] for r in files.join(spread, "bucket", "left_semi").orderBy("bucket", "path").toLocalIterator()]


def read_windows(spark: SparkSession, folder: str, windows: DataFrame, seconds: int = 30, **named: str) -> DataFrame:
    """The reports (canonical columns) of windows (event, mmsi, start, end), from the files of the buckets they need and no others."""
    paths = needed_files(timed_files(spark, folder, seconds=seconds, **named), windows, seconds)
    if not paths:
        return in_needed_buckets(canonical(spark.createDataFrame([], "mmsi string, timestamp string")), windows, seconds)
    return in_needed_buckets(canonical(spark.read.options(header=True).csv(paths)), windows, seconds)


#: Header aliases of zone files, lower-cased.
ZONE_HEADERS: dict[str, tuple[str, ...]] = {"source_id": ("id", "source_id"), "name": ("aoi_name", "name"), "zone_type": ("type", "zone_type"), "locode": ("locode",), "description": ("aoi_description", "description"), "geometry": ("geometry", "points", "wkt"), "is_active": ("is_active", "active")}


def zone_file(spark: SparkSession, path: str, encoding: str = "UTF-8", most_rows: int = 2000, most_columns: int = 32) -> DataFrame:
    """Zones of a CSV with ``vertices`` and ``fault`` (null: usable). Formula cells and too many columns are refused.

    Rows beyond ``most_rows`` (in the file's order) have the fault "too many rows"; nothing runs while this is planned.
    """
    raw = spark.read.options(header=True, encoding=encoding).csv(path)
    if len(raw.columns) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    have = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: next((F.trim(F.col(f"`{have[n]}`")) for n in names if n in have), F.lit(None).cast("string"))
    cells = raw.select(*(pick(names).alias(c) for c, names in ZONE_HEADERS.items()), F.monotonically_increasing_id().alias("_place"))
    above = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_place")) > most_rows  # a hand-made file
    cells = cells.withColumn("_above", above)
    formula = records.any_of([F.coalesce(F.col(c).rlike(r"^[=+@]"), F.lit(False)) for c in ("name", "zone_type", "locode", "description")])
    placed = cells.withColumns({"vertices": geo.parse_ring(F.col("geometry")), "is_active": F.coalesce(records.truth(F.col("is_active")), F.lit(True))})
    fault = F.when(F.col("name").isNull() | (F.col("name") == ""), "no name").when(formula, "formula").otherwise(geo.ring_fault(F.col("vertices")))
    fault = F.when(F.col("_above"), "too many rows").otherwise(fault)
    return placed.withColumn("fault", fault).filter(F.col("name").isNotNull() | F.col("geometry").isNotNull()).drop("geometry", "_place", "_above")


def _coordinate(c: Column) -> Column:
    """'22.5N' style text: S and W are negative."""
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(F.upper(c).rlike("[SW]"), -1).otherwise(1)


def typhoon_track(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """One row per point of typhoon XML documents (TropicalCyclone with Time, Latitude, Longitude, Intensity, MaximumWind)."""
    fields = ("Time", "Latitude", "Longitude", "Intensity", "MaximumWind")
    many = lambda name: F.xpath(F.col(column), F.lit(f"//*[Latitude and Longitude]/{name}/text()"))
    rows = feeds.select(F.xpath_string(F.col(column), F.lit("//TropicalCycloneName")).alias("name"), F.posexplode(F.arrays_zip(*(many(f).alias(f) for f in fields))).alias("ordinal", "p"))
    return rows.select("name", "ordinal", F.col("p.Time").alias("time"), _coordinate(F.col("p.Latitude")).alias("lat"), _coordinate(F.col("p.Longitude")).alias("lon"), F.col("p.Intensity").alias("intensity"), F.regexp_extract("p.MaximumWind", r"(\d+)", 1).try_cast("int").alias("wind"))


def marine_weather(weather: DataFrame, marine: DataFrame, points: DataFrame) -> DataFrame:
    """Two JSON arrays zipped by position onto fixed points (ordinal, place, lon, lat); columns ``json`` of the one-row inputs."""
    current = "array<struct<current: struct<time: string, temperature_2m: double, wind_speed_10m: double, wind_direction_10m: double>>>"
    waves = "array<struct<current: struct<time: string, wave_height: double, wave_direction: double, wave_period: double>>>"
    w = weather.select(F.posexplode(F.from_json("json", current)).alias("ordinal", "w")).select("ordinal", "w.current.*")
    m = marine.select(F.posexplode(F.from_json("json", waves)).alias("ordinal", "m")).select("ordinal", F.col("m.current.wave_height").alias("wave_height"), F.col("m.current.wave_direction").alias("wave_direction"), F.col("m.current.wave_period").alias("wave_period"))
    return points.join(w, "ordinal", "left").join(m, "ordinal", "left")
