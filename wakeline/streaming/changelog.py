"""A versioned log of state changes with snapshots: readers follow it version by version, and one that has missed some is given a snapshot and the rest.

A version is the changes of one micro-batch (upsert and remove rows of a key). Every ``every`` versions the whole state is written as a snapshot; changes older than the
snapshot before the last are deleted. All of it is Parquet in numbered folders, each written under another name and renamed, so a version is there as a whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVERY = 10


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    return sorted(int(n) for f in fs.listStatus(path) if (n := f.getPath().getName()).isdigit()) if fs.exists(path) else []


def _put(rows: DataFrame, folder: str, number: int) -> None:
    spark, aside = rows.sparkSession, f"{folder}/_aside-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    fs, made = _fs(spark, aside)
    _, final = _fs(spark, f"{folder}/{number:012d}")
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, True)


def applied(state: DataFrame | None, changes: DataFrame, key: list[str]) -> DataFrame:
    """The state after changes (key, change, fields, and ``version``, by which the last of a key counts)."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version")))).filter("_n = 1").drop("_n")
    new = last.filter("change = 'upsert'").drop("change", "version")
    return new if state is None else state.join(last.select(*key), key, "left_anti").unionByName(new.select(*state.columns))


def _changes(spark: SparkSession, log: str, numbers: list[int]) -> DataFrame | None:
    parts = [spark.read.parquet(f"{log}/changes/{n:012d}").withColumn("version", F.lit(n)) for n in numbers]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@dataclass(frozen=True)
class News:
    """What a reader gets: the state to begin with (None: its own), the changes after it in order of ``version`` (None: none), and the version it then has."""

    snapshot: DataFrame | None
    changes: DataFrame | None
    version: int


def news(spark: SparkSession, log: str, have: int = -1) -> News:
    """What came after version ``have``; with a snapshot if some of it is no longer kept."""
    kept = _numbers(spark, f"{log}/changes")
    shots = _numbers(spark, f"{log}/snapshots")
    latest = max([have, *kept, *shots])
    wanted = list(range(have + 1, latest + 1))
    if set(wanted) <= set(kept):
        return News(None, _changes(spark, log, wanted), latest)
    base = shots[-1] if shots else -1
    rest = [n for n in kept if n > base]
    if rest != list(range(base + 1, latest + 1)):
        raise ValueError(f"{log}: versions are missing after {base}")
    return News(spark.read.parquet(f"{log}/snapshots/{base:012d}"), _changes(spark, log, rest), latest)


def publish(changes: DataFrame, log: str, key: list[str], number: int, every: int = EVERY) -> None:
    """Version ``number`` (versions count up from 0; one that is there already is left as it is), and a snapshot if it is due."""
    spark = changes.sparkSession
    if number in _numbers(spark, f"{log}/changes") or number <= max(_numbers(spark, f"{log}/snapshots"), default=-1):
        return
    _put(changes, f"{log}/changes", number)
    if (number + 1) % every:
        return
    shots = _numbers(spark, f"{log}/snapshots")
    base = shots[-1] if shots else -1
    state = spark.read.parquet(f"{log}/snapshots/{base:012d}") if shots else None
    _put(applied(state, _changes(spark, log, list(range(base + 1, number + 1))), key), f"{log}/snapshots", number)
    fs, _ = _fs(spark, log)
    for n in _numbers(spark, f"{log}/changes"):
        if n <= base:  # readers that began with the snapshot before still find what follows it
            fs.delete(_fs(spark, f"{log}/changes/{n:012d}")[1], True)
    for n in shots[:-1]:
        fs.delete(_fs(spark, f"{log}/snapshots/{n:012d}")[1], True)


def publish_stream(changes: DataFrame, log: str, key: list[str], checkpoint: str, every: int = EVERY, once: bool = False) -> StreamingQuery:
    """A stream of changes as versions; a micro-batch that is replayed is the version it was."""
    write: Callable[[DataFrame, int], None] = lambda batch, number: publish(batch, log, key, number, every)
    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
