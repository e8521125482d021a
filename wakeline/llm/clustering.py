"""Centroid clustering in whole numbers: Lloyd's rounds sharded by dimension.

A vector is cut into blocks of ``WIDTH`` columns, and a few thousand vectors into a group; a task holds one column block of a group and
needs only the centroids' slice of its columns. It computes exact partial distances; a shuffle by group adds the blocks' parts and
takes the nearest centroid; the choices (a few bytes a vector) go back to the blocks, which stay where they are, and each column block
sums up its own slice of the new centroids. The driver sees the centroids only: ``k`` times the number of columns.

Components become floor(scale * x), so all distances and sums are whole numbers and the result does not depend on the order of tasks.

Edge cases: vectors with another number of components, or with a null, a NaN or an infinite one, are left out, and so are those with a
component of 2^27 or more after scaling, as their distances could pass 64 bits. Repeated rows each count; a null vec_id hashes like the
empty text. With fewer vectors than ``k`` each is a start. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows, shuffle_partitions

DIMENSIONS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
WIDTH, GROUP, LARGEST = 16, 2048, 1 << 27


def scaled(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``x``: the whole-number components of the usable vectors."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * scale))
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (F.size("embedding") == dimensions) & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v * scale) < LARGEST), F.lit(False)))
    return raw.filter(F.coalesce(usable, F.lit(False))).select("vec_id", x.cast("array<long>").alias("x"))


def starts(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash, in its order, as the first centroids."""
    hashed = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    found = hashed.orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in found], np.int64)


def blocks(points: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """grp, block, n, ids (with block 0 only) and m: the block's columns of the group's vectors, row by row."""
    schema = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("x")
            m = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
            for at in range(0, len(batch), group):
                part, ids = m[at : at + group], batch.column("vec_id").slice(at, group).to_pylist()
                slices = [part[:, c : c + width] for c in range(0, m.shape[1], width)]
                k = len(slices)
                yield rows(schema, [grp] * k, list(range(k)), [len(part)] * k, [ids, *[None] * (k - 1)], [s.astype("<i4").tobytes() for s in slices])
                grp += 1

    return points.mapInArrow(run, "grp long, block int, n int, ids array<long>, m binary")


def nearest(parts: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """grp, cluster (int32 each) and distance (int64 each) of all vectors: partial distances by column block, added by group."""
    k = len(centroids)
    partial = pa.schema([("grp", pa.int64()), ("n", pa.int32()), ("d", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, n, m in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "m")), strict=True):
                own = np.frombuffer(m, "<i4").reshape(n, -1).astype(np.int64)
                slices = centroids[:, b * width : (b + 1) * width]
                out.append(np.stack([((own - c) ** 2).sum(axis=1) for c in slices], axis=1).tobytes())
            yield rows(partial, batch.column("grp").to_pylist(), batch.column("n").to_pylist(), out)

    chosen = pa.schema([("grp", pa.int64()), ("cluster", pa.binary()), ("distance", pa.binary())])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d, np.int64).reshape(-1, k) for d in group.column("d").to_pylist())
        best = total.argmin(axis=1)  # the first of equal ones
        least = total[np.arange(len(best)), best]
        return pa.Table.from_batches([rows(chosen, [group.column("grp")[0].as_py()], [best.astype("<i4").tobytes()], [least.tobytes()])])

    return parts.select("grp", "block", "n", "m").mapInArrow(measure, "grp long, n int, d binary").groupBy("grp").applyInArrow(add, "grp long, cluster binary, distance binary")


def moved(parts: DataFrame, chosen: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The next centroids: each column block adds up its own slice; an empty cluster keeps its centroid."""
    k, n_blocks = len(centroids), -(-centroids.shape[1] // width)
    schema = pa.schema([("cluster", pa.int32()), ("column", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a slice of the centroids for each column block seen
        for batch in batches:
            for b, n, m, c in zip(*(batch.column(x).to_pylist() for x in ("block", "n", "m", "cluster")), strict=True):
                own, to = np.frombuffer(m, "<i4").reshape(n, -1).astype(np.int64), np.frombuffer(c, "<i4")
                total, count = sums.setdefault(b, (np.zeros((k, own.shape[1]), np.int64), np.zeros(k, np.int64)))
                np.add.at(total, to, own)
                count += np.bincount(to, minlength=k)
        for b, (total, count) in sums.items():
            w = total.shape[1]
            yield rows(schema, np.repeat(np.arange(k), w), np.tile(np.arange(w) + b * width, k), total.ravel(), np.repeat(count, w))

    sent = chosen.select("grp", "cluster", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    met = parts.join(sent, ["grp", "block"]).select("block", "n", "m", "cluster")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")  # exact beyond 64 bits
    added = met.mapInArrow(add, "cluster int, column int, total long, n long").groupBy("cluster", "column").agg(wide, F.sum("n").alias("n"))
    out = centroids.copy()
    for r in added.collect():  # at most k rows a column
        if r["n"]:
            out[r["cluster"], r["column"]] = int(r["total"]) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector after so many rounds and a last assignment."""
    spark = vectors.sparkSession
    points = scaled(vectors, dimensions, scale)
    centroids = starts(points, k, seed)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    # written once, then dealt by group and column block and kept so: only choices move in a round
    parts = checkpointed(blocks(points, width, group)).repartition(shuffle_partitions(spark), "grp", "block").persist()
    try:
        for _ in range(rounds):
            centroids = moved(parts, nearest(parts, centroids, width), centroids, width)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, c, d in zip(*(batch.column(x).to_pylist() for x in ("ids", "cluster", "distance")), strict=True):
                    yield rows(schema, ids, np.frombuffer(c, "<i4"), np.frombuffer(d, np.int64))

        last = nearest(parts, centroids, width).join(parts.filter("block = 0").select("grp", "ids"), "grp")
        placed = checkpointed(last.select("ids", "cluster", "distance").mapInArrow(unpack, "vec_id long, cluster int, distance long"))
    finally:
        parts.unpersist()
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    return placed.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
