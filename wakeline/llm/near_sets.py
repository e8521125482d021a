"""Near-duplicate rows by the exact Jaccard index of their word-shingle sets.

Candidates come from two searches: the vantage-point trees over SimHash (``simhash.links``), and buckets of equal values in
``BANDS`` bands of ``ROWS`` minimum hashes, as pairs at an index of 0.8 differ in about ten of the 64 bits. A pair at 0.8
shares no bucket with a chance of (1 - 0.8**5)**24, about 7 * 10**-5. Each candidate is then checked by its whole sets, so
no document goes for a fingerprint alone.

A bucket is compared in two steps. First one pivot is checked against the other members and leaves; a large group of near copies so
takes about one check a member. Then members go that can't be alike any other of their bucket, unless they are connected with it already; what
is still open is compared in blocks, see ``crowd_links``. Both steps first reject pairs by their signatures, a bound that no alike pair
fails (``may_be_alike``), so a crowd of texts that share bands and are not alike makes few pairs. No pair of a bucket is left out.

Equal sets collapse first. A null or empty text has the empty set; fewer words than a shingle are one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, release, text_batches, texts
from .components import components, local_forest

SHINGLE, ALIKE, BANDS, ROWS, MOST = 5, 0.8, 24, 5, 7
CROWD, SIGNATURE = 1024, 512
_U = np.uint64
_RNG = np.random.default_rng(42)
_TIMES, _PLUS = _RNG.integers(0, 2**64 - 1, BANDS * ROWS, _U) | _U(1), _RNG.integers(0, 2**64 - 1, BANDS * ROWS, _U)


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of the word shingles, ascending."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z only
    n = max(len(words) - shingle + 1, 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), simhash.SEED) for i in range(n)), _U, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band from the minimum hashes of the set; none for the empty set."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, _U)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _PLUS) * _TIMES).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[b].tobytes(), b) for b in range(BANDS)], _U).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), 1), _U).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """_id (a null doc_id counts as the smallest) and _text, a hash: together they name a row, or rows that repeat it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def described(docs: DataFrame) -> DataFrame:
    """_id, _text, node (hash of the set), n (its size), fp (SimHash) and bands."""
    kinds = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, raws in text_batches(batches):
            sets = [shingle_set(r) for r in raws]
            text = np.array([xxhash.xxh64_intdigest(r, 42) for r in raws], _U).view(np.int64)  # Spark's xxhash64
            fp = np.array([simhash.text_fingerprint(r, SHINGLE) for r in raws], _U).view(np.int64)
            columns = ids, text, [_node(s) for s in sets], [len(s) for s in sets], fp, [band_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    found = texts(docs).mapInArrow(run, "doc_id long, hash long, node long, n int, fp long, bands array<long>")
    return found.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("_id"), F.col("hash").alias("_text"), "node", "n", "fp", "bands")


def node_sets(docs: DataFrame) -> DataFrame:
    """node and its set, once a row of ``docs``."""
    kinds = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in text_batches(batches):
            sets = [shingle_set(r) for r in raws]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], kinds[1].type)], schema=kinds)

    return texts(docs).mapInArrow(run, "node long, hashes array<long>")


def checked(pairs: DataFrame, sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least this Jaccard index."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared >= alike * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def signatures(sets: DataFrame) -> DataFrame:
    """node and sig, ``SIGNATURE`` bits of its set: each is the parity of the elements that fall on it."""
    kinds = pa.schema([("node", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                node, lists = batch.slice(start, 1024).columns
                size = np.diff(lists.offsets.to_numpy())
                at = np.repeat(np.arange(len(size)), size) * SIGNATURE + (lists.flatten().to_numpy() & (SIGNATURE - 1))
                odd = (np.bincount(at, minlength=len(size) * SIGNATURE) & 1).astype(np.uint8)
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (SIGNATURE // 64), pa.int32()), pa.array(np.packbits(odd).view(np.int64)))
                yield pa.RecordBatch.from_arrays([node, words], schema=kinds)

    return sets.select("node", "hashes").mapInArrow(run, "node long, sig array<long>")


def may_be_alike(alike: float = ALIKE) -> Column:
    """False only for sets (n, sig and _n, _sig) below this Jaccard index.

    Sets of other sizes can't be alike. Bits in which two signatures differ are at most the elements that one set alone has, and at this index those
    are at most (1 - alike) / (1 + alike) of both sizes. Far below it nearly every pair is told apart, up to some thousand elements; beyond, the sets decide.
    """
    differ = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("_sig")[i])) for i in range(1, SIGNATURE // 64)), F.bit_count(F.col("sig")[0].bitwiseXOR(F.col("_sig")[0])))
    return (F.least("n", "_n") >= alike * F.greatest("n", "_n")) & (differ * F.lit(1 + alike) <= (F.col("n") + F.col("_n")) * F.lit(1 - alike) + 1e-6)


def undecided(members: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The members that may be alike another one of their bucket that they are not connected with; one row a member at most."""
    other = members.select(F.col("bucket").alias("_bucket"), F.col("component").alias("_of"), F.col("n").alias("_n"), F.col("sig").alias("_sig"))
    return members.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("component") != F.col("_of")) & may_be_alike(alike), "left_semi")


def crowd_links(members: DataFrame, sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Links (a, b) that connect all alike nodes of a bucket that are not of one component yet; members: bucket, node, n, component.

    A bucket of more than ``CROWD`` nodes is cut into blocks of about that many whose sets have like sizes: sets with this Jaccard index are of the same or
    of neighbouring size classes. Each pair of such blocks is one task's work; it counts common shingles as a product of matrices and returns a forest, no pairs.
    """
    size_class = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / math.log(1 / alike)).cast("int")
    large = members.groupBy("bucket").agg((F.count("*") > CROWD).alias("_large"))
    sized = checkpointed(members.join(large, "bucket").select("bucket", "node", "component", F.when(F.col("_large"), size_class).otherwise(0).alias("c")))
    counts = sized.groupBy("bucket", "c").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("n"))
    blocks = checkpointed(counts.select("bucket", "c", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")))
    left = blocks.select("bucket", F.col("c").alias("at"), F.col("s").alias("s_a"))
    right = blocks.select("bucket", "c", F.col("s").alias("s_b"), F.explode(F.array(F.col("c"), F.col("c") - 1)).alias("at"))
    both = left.join(right, ["bucket", "at"]).filter((F.col("c") > F.col("at")) | (F.col("s_b") >= F.col("s_a")))
    task = F.struct("bucket", "at", "s_a", "c", "s_b").alias("task")
    sides = both.select("bucket", F.explode(F.array_distinct(F.array(F.struct(F.col("at").alias("c"), F.col("s_a").alias("s")), F.struct("c", F.col("s_b").alias("s"))))).alias("_side"), task)
    sides = sides.select("bucket", "_side.c", "_side.s", "task")
    placed = sized.join(blocks.filter("s = 0").drop("s"), ["bucket", "c"]).select("node", "component", "bucket", "c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("s"))
    dealt = placed.join(sides, ["bucket", "c", "s"]).select("task", "node", "component").join(sets, "node")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
        lists = group.column("hashes").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        x, y = alike_pairs(lists.flatten().to_numpy(), n, alike)
        other = component[x] != component[y]
        a, b = local_forest(node[x[other]], node[y[other]])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kinds)

    return dealt.select("task", "node", "component", "hashes").groupBy("task").applyInArrow(compare, "a long, b long")


def alike_pairs(hashes: np.ndarray, n: np.ndarray, alike: float = ALIKE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x < y) of sets, n elements each one after the other, with at least this Jaccard index."""
    at, seen = np.unique(hashes, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(n)), n)
    shared = seen[at] > 1  # what one set alone has is in no pair
    column = (np.cumsum(seen > 1) - 1)[at[shared]]
    row = row[shared]
    common = np.zeros((len(n), len(n)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        has = np.zeros((len(n), 4096), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        common += has @ has.T
    return np.nonzero(np.triu(common >= alike * (n[:, None] + n[None] - common), 1) & (common > 0))


def set_components(members: DataFrame, sets: DataFrame, more: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(node, component) of the nodes with a link; members: bucket, node, n (size of its set); more: further candidate pairs a, b."""
    members = checkpointed(members.select("bucket", "node", "n").join(signatures(sets), "node"))
    pivots = members.groupBy("bucket").agg(F.min(F.struct("node", "n", "sig")).alias("_p"))
    pivots = checkpointed(pivots.select("bucket", F.col("_p.node").alias("_pivot"), F.col("_p.n").alias("_n"), F.col("_p.sig").alias("_sig")))
    pairs = members.join(pivots, "bucket").filter(F.col("node") != F.col("_pivot")).filter(may_be_alike(alike)).select(F.col("node").alias("a"), F.col("_pivot").alias("b"))
    pairs = pairs.unionByName(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    links = checkpointed(checked(checkpointed(pairs.distinct()), sets, alike))
    joined = checkpointed(components(links))
    release(sets.sparkSession)
    left = members.join(pivots.select("bucket", F.col("_pivot").alias("node")), ["bucket", "node"], "left_anti")
    left = left.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = checkpointed(undecided(left, alike))
    if members.isEmpty():
        return joined
    links = checkpointed(links.unionByName(crowd_links(members, sets, alike)))
    release(sets.sparkSession)
    return components(links)


def _order(docs: DataFrame) -> Column:
    """The columns of ``_row`` in an order that any type has: what Spark does not compare (maps and the like) as JSON."""
    plain = lambda kind: not any(x in kind for x in ("map<", "variant", "interval"))
    field = lambda c: F.col(f"_row.`{c}`")
    return F.struct(*(field(c) if plain(kind) else F.to_json(F.struct(field(c).alias("x"))) for c, kind in docs.dtypes))


def deduplicated(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """One row of each group: that with the smallest doc_id (a null one counts as the smallest), ties by a hash of the text, then by the row."""
    own = checkpointed(described(docs))
    bands = own.select("node", "n", F.explode("bands").alias("bucket")).unionByName(own.select("node", "n", F.xxhash64(F.lit("fp"), "fp").alias("bucket")))
    several = bands.groupBy("bucket").agg(F.min("node").alias("_x"), F.max("node").alias("_y")).filter("_x <> _y").select("bucket")
    members = checkpointed(bands.join(several, "bucket", "left_semi").distinct())
    marks = checkpointed(own.groupBy("fp").agg(F.min("node").alias("node")))
    more = checkpointed(simhash.links(marks, MOST))
    asked = members.select("node").unionByName(more.select(F.col("a").alias("node"))).unionByName(more.select(F.col("b").alias("node"))).distinct()
    shown = own.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_id", "_text")).alias("_k")).select("_k._id", "_k._text")
    keyed = _keyed(docs)
    texts_of = keyed.join(shown, ["_id", "_text"], "left_semi").select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text"))
    sets = checkpointed(node_sets(texts_of).dropDuplicates(["node"]))
    release(docs.sparkSession)
    joined = checkpointed(set_components(members, sets, more, alike))
    release(docs.sparkSession)
    kept = own.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("_c")).agg(F.min(F.struct("_id", "_text")).alias("_k")).select("_k._id", "_k._text")
    rows = keyed.join(kept, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min_by("_row", _order(docs)).alias("_row"))
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
