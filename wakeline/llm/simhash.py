"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles; two documents are linked at ``most`` or fewer differing bits. Equal
fingerprints collapse first. The 64 bits are viewed as ``BLOCKS`` equal parts: of a linked pair at least one part differs
in at most ``most // BLOCKS`` bits, so a part gets a vantage-point tree over Hamming distance with that small radius
instead of one tree with the whole radius, which would prune next to nothing. At 4 bits two of the four parts differ in at
most one, so three trees find every pair, and a shard that its own part can't split any more is split on by a later part:
the keys of 32 bits that this makes let shards stay small as fingerprints grow.

A tree's node splits by the distance to a vantage point at the median. Every fingerprint lives in one leaf (shard) per
tree and visits those that its ball overlaps by the triangle inequality; a shard compares its visitors with its residents
and checks all 64 bits, so pairs are exact and complete. The upper levels come from a bounded sample and deal the work to
tasks; each task goes on splitting its shard the same way. In a dense shard, residents within half the radius of a pivot
are linked through it and not compared with each other. Shards emit a spanning forest of their links, never all pairs.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle are one
shingle; repeated rows share a component; a null doc_id counts as the smallest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows, shuffle_partitions, text_batches, texts
from .components import components, local_forest

SHINGLE, MOST, BLOCKS, SEED = 4, 4, 4, 42
SHARD, SAMPLE, LEAF = 16_384, 8_192, 96
WORTH = 1.7  # copies of a shard's visitors that a split may make at most
_U = np.uint64


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    words = raw.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)])
    bits = np.zeros(64, np.int64)
    packed = np.frombuffer(joined, np.uint8)
    for at in range(0, len(packed), 1 << 19):
        bits += np.unpackbits(packed[at : at + (1 << 19)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches):
            yield rows(schema, ids, np.array([text_fingerprint(r, shingle) for r in raws], _U).view(np.int64))

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _good_parts(most: int, blocks: int) -> int:
    """How many parts of a linked pair differ in at most ``most // blocks`` bits, at least."""
    return blocks - most // (most // blocks + 1)


def _part(fp: np.ndarray, block: int, blocks: int) -> np.ndarray:
    width = 64 // blocks
    return (fp >> _U(block * width)) & _U((1 << width) - 1)


def _split(values: np.ndarray, seed: int) -> tuple[int, int] | None:
    """A vantage point of the values and the median distance to it, if that parts them."""
    if len(values) < 2:
        return None
    vantage = values[seed % len(values)]
    d = np.bitwise_count(values ^ vantage)
    m = int(np.partition(d, len(d) // 2)[len(d) // 2])
    if m == d.max():
        m -= 1
    return None if m < d.min() else (int(vantage), m)


def build_tree(values: np.ndarray, depth: int, seed: int = 1):
    """A node is (vantage, median, inner, outer), a leaf None."""
    cut = _split(values, seed) if depth else None
    if cut is None:
        return None
    inside = np.bitwise_count(values ^ _U(cut[0])) <= cut[1]
    return (*cut, build_tree(values[inside], depth - 1, seed * 31 + 7), build_tree(values[~inside], depth - 1, seed * 31 + 11))


def route(tree, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows that reach it, whether they live there), leaves numbered by their path from the root."""
    pending = [(1, tree, np.arange(len(values)), np.ones(len(values), bool))]
    while pending:
        path, node, at, lives = pending.pop()
        if not len(at):
            continue
        if node is None:
            yield path, at, lives
            continue
        vantage, median, inner, outer = node
        d = np.bitwise_count(values[at] ^ _U(vantage)).astype(np.int16)
        near, far = d - radius <= median, d + radius > median
        pending += [(2 * path, inner, at[near], lives[near] & (d[near] <= median)), (2 * path + 1, outer, at[far], lives[far] & (d[far] > median))]


class _Shard:
    """Links between visitors and residents of a shard, as indices into ``fp``; gathered and thinned as they come."""

    def __init__(self, fp: np.ndarray, most: int):
        self.fp, self.most = fp, most
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > 2_000_000:
                self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = local_forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.held = [a], [b], len(a)
        return a, b

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(len(right), 1))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            x, y = np.nonzero(np.bitwise_count(self.fp[some][:, None] ^ self.fp[right][None, :]) <= self.most)
            x, y = some[x], right[y]
            self.add(x[x != y], y[x != y])

    def dense(self, residents: np.ndarray, visitors: np.ndarray) -> None:
        """No split helps: peel off balls of half the radius, linked through their centre."""
        half = self.most // 2
        while len(residents) > 512:
            pivot = residents[0]
            dr, dv = (np.bitwise_count(self.fp[x] ^ self.fp[pivot]) for x in (residents, visitors))
            near = visitors[(dv <= self.most) & (visitors != pivot)]
            self.add(np.full(len(near), pivot), near)
            ball = residents[(dr <= half) & (residents != pivot)]
            self.add(np.full(len(ball), pivot), ball)
            self.compare(ball, visitors[(dv > half) & (dv <= self.most + half)])
            residents = residents[dr > half]
        self.compare(residents, visitors)

    def search(self, block: int, blocks: int) -> None:
        """Split on as the upper tree did, by one part of the bits and then by later ones, until shards are small."""
        radius, several = self.most // blocks, _good_parts(self.most, blocks) > 1
        parts = {b: _part(self.fp, b, blocks) for b in range(block, blocks)}
        pending = [(np.arange(len(self.fp)), self.lives, 0, block)]
        while pending:
            at, lives, depth, b = pending.pop()
            residents, part = at[lives], parts[b]
            if not len(residents):
                continue
            cut = _split(part[residents], depth * 7 + 3) if len(residents) > LEAF else None
            if cut is not None:
                d = np.bitwise_count(part[at] ^ _U(cut[0])).astype(np.int16)
                near, far = d - radius <= cut[1], d + radius > cut[1]
                if int(near.sum()) + int(far.sum()) <= WORTH * len(at):
                    pending += [(at[near], lives[near] & (d[near] <= cut[1]), depth + 1, b), (at[far], lives[far] & (d[far] > cut[1]), depth + 1, b)]
                    continue
            if several and b == block and len(residents) > LEAF:
                pending += [(at, lives, depth, later) for later in range(block + 1, blocks)]
                continue
            (self.dense if len(residents) > 512 else self.compare)(residents, at)  # small, or a cluster that no part parts


def shard_links(fp: np.ndarray, lives: np.ndarray, block: int, most: int = MOST, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    shard = _Shard(fp, most)
    shard.lives = lives
    shard.search(block, blocks)
    return shard.thin()


def links(marks: DataFrame, most: int = MOST, blocks: int = BLOCKS, shard_size: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all pairs of different fingerprints within ``most`` bits; marks: fp (distinct), node."""
    spark = marks.sparkSession
    n = marks.count()
    sample = np.array([r["fp"] for r in marks.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(_U)  # bounded by SAMPLE
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard_size))))
    needed = blocks - _good_parts(most, blocks) + 1  # of these one part is good in every pair
    trees = [build_tree(np.unique(_part(sample, b, blocks)), depth, seed=b + 1) if depth else None for b in range(needed)]
    radius = most // blocks
    dealt = pa.schema([("shard", pa.int64()), ("lives", pa.bool_()), ("fp", pa.int64()), ("node", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            for b, tree in enumerate(trees):
                for leaf, at, lives in route(tree, _part(fp.view(_U), b, blocks), radius):
                    yield rows(dealt, np.full(len(at), leaf * blocks + b), lives, fp[at], node[at])

    found = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            a, b = shard_links(whole["fp"].to_numpy().view(_U), whole["lives"].to_numpy(), now % blocks, most, blocks)
            node = whole["node"].to_numpy()
            return rows(found, node[a], node[b])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if x == y:
                    continue
                if now is not None and shards[x] != now:
                    yield done()
                    held = []
                now = int(shards[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield done()

    parted = marks.select("fp", "node").mapInArrow(deal, "shard long, lives boolean, fp long, node long")
    return parted.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row."""
    none = F.lit(-(2**63)).cast("long")  # stands for a null doc_id
    own = checkpointed(fingerprints(docs, shingle).withColumn("doc_id", F.coalesce("doc_id", none)))
    marks = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    joined = components(links(marks, most))
    of = marks.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(of, "fp").select(F.nullif("doc_id", none).alias("doc_id"), "fp", F.nullif("component_id", none).alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
