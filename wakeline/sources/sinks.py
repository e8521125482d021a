"""Writers: idempotent upserts, appends that ignore conflicts, revisions, retention, backups and exports.

A store is a folder of generations and of numbered pointers. A write adds one small generation with its own rows and then the next
pointer; what is stored before is not read and not rewritten. A pointer is a small file that names the generations in order; it is written aside
and renamed, which either happens or does not, and the one with the highest number counts, so a job that dies leaves the store as it
was. Reading merges the generations by key, by the store's rule:

* ``events``: spans widen, counts add, later fields win (``events.upsert``); ``first``: a stored row stays; ``last``: a later row takes its place.

Generations at the end are merged once there are ``FANOUT`` of them none of which is more than ``FANOUT`` times as large as those after it, so a large one
is left alone until what came later is a fair part of it, and a store has few generations. What a dead write left is deleted once it is ``GRACE`` seconds old and no kept pointer names it.
On HDFS of two writers that meet the second fails to rename and changes nothing; where a rename may replace a file (object stores) one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import safe_cell

FANOUT, KEPT_POINTERS, GRACE = 4, 3, 3600.0


@dataclass(frozen=True)
class Pointer:
    number: int
    batch: int
    key: tuple[str, ...]
    rule: str
    latest: tuple[str, ...]  # the fields of ``events`` that follow the latest row
    generations: tuple[tuple[str, int], ...]  # name and bytes, oldest first


class Conflict(RuntimeError):
    """Another writer was first."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, table: str) -> list[int]:
    fs, folder = _fs(spark, f"{table}/_pointers")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, table: str, number: int) -> Pointer:
    found = json.loads(spark.read.text(f"{table}/_pointers/{number:012d}", wholetext=True).first()["value"])
    return Pointer(number, found["batch"], tuple(found["key"]), found["rule"], tuple(found["latest"]), tuple((n, w) for n, w in found["generations"]))


def _pointer(spark: SparkSession, table: str) -> Pointer | None:
    numbers = _numbers(spark, table)
    return _read(spark, table, numbers[-1]) if numbers else None


def _point(spark: SparkSession, table: str, pointer: Pointer) -> None:
    """Write the pointer aside, rename it to its number, and remove what is over."""
    text = json.dumps({"batch": pointer.batch, "key": pointer.key, "rule": pointer.rule, "latest": pointer.latest, "generations": pointer.generations})
    fs, aside = _fs(spark, f"{table}/_aside-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, final = _fs(spark, f"{table}/_pointers/{pointer.number:012d}")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise Conflict(f"{table}: another writer was first")
    _clean(spark, table)


def _clean(spark: SparkSession, table: str, grace: float | None = None) -> None:
    """Delete pointers but the last few (readers may still be there), generations that only those named, and old ones that no pointer ever named."""
    numbers = _numbers(spark, table)
    kept, gone = numbers[-KEPT_POINTERS:], numbers[:-KEPT_POINTERS]
    live = {g for n in kept for g, _ in _read(spark, table, n).generations}
    named = {g for n in gone for g, _ in _read(spark, table, n).generations} - live
    fs, folder = _fs(spark, table)
    before = (time.time() - (GRACE if grace is None else grace)) * 1000
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name in named or (name.startswith(("generation-", "_aside-")) and name not in live and f.getModificationTime() < before):
            fs.delete(f.getPath(), True)
    for n in gone:
        fs.delete(_fs(spark, f"{table}/_pointers/{n:012d}")[1], False)


def _aged(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    """The rows of some generations, oldest first, with ``_age``."""
    parts = [spark.read.parquet(f"{table}/{name}").withColumn("_age", F.lit(age)) for age, name in enumerate(names)]
    return reduce(DataFrame.unionByName, parts)


def _merged(rows: DataFrame, pointer: Pointer) -> DataFrame:
    """One row a key from rows with ``_age``."""
    key = list(pointer.key)
    if pointer.rule == "events":
        newest = F.max_by(F.struct(*pointer.latest), F.struct("last_detected_at", "_age"))
        out = rows.groupBy(*key).agg(F.min("first_detected_at").alias("first_detected_at"), F.max("last_detected_at").alias("last_detected_at"), F.sum("occurrences").alias("occurrences"), newest.alias("_l"))
        return out.select(*key, "first_detected_at", "last_detected_at", "occurrences", *(F.col(f"_l.{c}").alias(c) for c in pointer.latest))
    pick, rest = F.min_by if pointer.rule == "first" else F.max_by, [c for c in rows.columns if c not in (*key, "_age")]
    if not rest:
        return rows.select(*key).distinct()
    return rows.groupBy(*key).agg(pick(F.struct(*rest), "_age").alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def _load(spark: SparkSession, table: str, pointer: Pointer) -> DataFrame | None:
    names = [n for n, _ in pointer.generations]
    if not names:
        return None
    return spark.read.parquet(f"{table}/{names[0]}") if len(names) == 1 else _merged(_aged(spark, table, names), pointer)


def load(spark: SparkSession, table: str) -> DataFrame | None:
    """All rows of the store; None if nothing was ever stored."""
    found = _pointer(spark, table)
    return _load(spark, table, found) if found else None


def _write(rows: DataFrame, table: str) -> tuple[str, int]:
    """A new generation: its name and bytes."""
    name = f"generation-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{name}")
    fs, folder = _fs(rows.sparkSession, f"{table}/{name}")
    return name, fs.getContentSummary(folder).getLength()


def _compacted(spark: SparkSession, table: str, generations: list[tuple[str, int]], pointer: Pointer) -> list[tuple[str, int]]:
    """The generations with a tail of like sizes merged."""
    first, total = len(generations) - 1, generations[-1][1]
    while first and generations[first - 1][1] <= FANOUT * total:
        first -= 1
        total += generations[first][1]
    if len(generations) - first < FANOUT:
        return generations
    return [*generations[:first], _write(_merged(_aged(spark, table, [n for n, _ in generations[first:]]), pointer), table)]


def _add(rows: DataFrame, table: str, key: list[str], rule: str, latest: list[str] = [], batch: int | None = None, old: Pointer | None = None) -> None:  # noqa: B006
    """One generation more, and the next pointer after ``old``."""
    spark = rows.sparkSession
    if old is not None and (old.key, old.rule) != (tuple(key), rule):
        raise ValueError(f"{table} is kept by {old.rule} on {old.key}")
    last = old.batch if old else -1
    base = Pointer(old.number + 1 if old else 0, last if batch is None else batch, tuple(key), rule, tuple(latest), ())
    own = _write(rows, table)
    kept = _compacted(spark, table, [*(old.generations if old else ()), own], base)
    _point(spark, table, replace(base, generations=tuple(kept)))
    if own not in kept:  # merged before it was ever named
        fs, folder = _fs(spark, f"{table}/{own[0]}")
        fs.delete(folder, True)


def upsert_events(new: DataFrame, table: str, key: list[str], latest: list[str], batch: int | None = None) -> None:
    """Merge events of the shape of ``events.deduplicated`` into a store. A micro-batch number that was merged before is skipped, so a replay counts nothing twice."""
    found = _pointer(new.sparkSession, table)
    if batch is None or found is None or batch > found.batch:
        _add(new.select(*key, "first_detected_at", "last_detected_at", "occurrences", *latest), table, key, "events", latest, batch, found)


def append_new(new: DataFrame, table: str, key: list[str]) -> None:
    """Add rows whose key is not stored yet; of equal new keys one is kept."""
    _add(new.dropDuplicates(key), table, key, "first", old=_pointer(new.sparkSession, table))


def _judged(changes: DataFrame, stored: DataFrame | None, key: list[str]) -> DataFrame:
    """The changes with ``current`` (the stored revision, null if there is no row) and ``action``: create, change, unchanged or refused."""
    names = [c for c in changes.columns if c not in (*key, "revision")]
    if stored is None:
        held = changes.select(*key, F.lit(None).cast("long").alias("current"), F.lit(None).cast("boolean").alias("_same")).limit(0)
    else:
        held = stored.select(*key, F.col("revision").alias("current"), F.struct(*names).alias("_held"))
    met = changes.join(held, key, "left")
    same = F.lit(False) if stored is None else F.to_json("_held", {"ignoreNullFields": "false"}) == F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    fits = F.coalesce("revision", F.lit(0)) == F.coalesce("current", F.lit(0))
    action = F.when(~fits, "refused").when(F.col("current").isNull(), "create").when(same, "unchanged").otherwise("change")
    return met.withColumn("action", action).select(*changes.columns, "current", "action")


def previewed(changes: DataFrame, table: str, key: list[str]) -> DataFrame:
    """What ``revise`` would do with each row, without doing it."""
    return _judged(changes, load(changes.sparkSession, table), key)


def revise(changes: DataFrame, table: str, key: list[str], tries: int = 3) -> DataFrame:
    """Compare and set: a row whose ``revision`` is the stored one (null or 0: not stored yet) takes its place with the next revision.

    Returns the refused rows with the stored revision as ``current``. Of two writers that meet the second looks again, and finds its rows refused. One change a key.
    """
    spark = changes.sparkSession
    for left in reversed(range(tries)):
        found = _pointer(spark, table)
        judged = _judged(changes, _load(spark, table, found) if found else None, key).persist()
        refused = judged.filter("action = 'refused'").drop("action")
        fits = judged.filter("action in ('create', 'change')").withColumn("revision", F.coalesce("current", F.lit(0)).cast("long") + 1).select(*changes.columns)
        try:
            if not fits.isEmpty():
                _add(fits, table, key, "last", old=found)
            return refused
        except Conflict:
            judged.unpersist()
            if not left:
                raise
    raise AssertionError


def compact(spark: SparkSession, table: str) -> None:
    """One generation out of all; reading then merges nothing."""
    found = _pointer(spark, table)
    if found is not None and len(found.generations) > 1:
        _point(spark, table, replace(found, number=found.number + 1, generations=(_write(_load(spark, table, found), table),)))


def retain(table: str, spark: SparkSession, seconds: float, tolerance: float = 0.0, reference: float | None = None, by: str | None = None) -> None:
    """Keep rows no older than ``seconds`` before the reference, and not after it by more than the tolerance.

    The reference is a given time or the newest; with ``by`` each value of that column (a vessel, say) has its own newest.
    Only generations that lose rows are written.
    """
    found = _pointer(spark, table)
    rows = _load(spark, table, found) if found else None
    if rows is None:
        return
    if by is not None:
        dated = rows.join(rows.groupBy(by).agg(F.max("t").alias("_ref")), by)
    else:
        dated = rows.withColumn("_ref", F.lit(reference if reference is not None else rows.agg(F.max("t")).first()[0]))
    stays = F.coalesce(F.col("t").between(F.col("_ref") - seconds, F.col("_ref") + tolerance), F.lit(False))
    key = list(found.key)
    gone = dated.filter(~stays).select(*key).persist()
    try:
        names = [n for n, _ in found.generations]
        touched = {r["_age"] for r in _aged(spark, table, names).join(gone, key, "left_semi").select("_age").distinct().collect()}  # few generations
        if touched:
            kept = [_write(spark.read.parquet(f"{table}/{n}").join(gone, key, "left_anti"), table) if age in touched else (n, w) for age, (n, w) in enumerate(found.generations)]
            _point(spark, table, replace(found, number=found.number + 1, generations=tuple(kept)))
    finally:
        gone.unpersist()


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: text that looks like a formula is quoted."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    df.select(*(safe_cell(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path)


def export_routes(grid: DataFrame, path: str) -> None:
    """The route knowledge base, sorted by cell so that scans prune row groups."""
    grid.sortWithinPartitions("cell_y", "cell_x").write.mode("overwrite").parquet(path)
