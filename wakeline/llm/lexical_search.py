"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

``index`` reads the texts once and cuts them into shards of about ``SHARD`` bytes. A shard has a row for each of its terms: the
postings (gaps and counts as variable-length bytes, in blocks of ``BLOCK``), each block's last document and best contribution, and a row
for its documents. ``search`` sends only the query terms' rows on, by shard, and asks each shard every item of a block of the query set:

* lists are ordered by their global bound (weight times best contribution); those whose bounds together stay below the item's 20th
  score so far are not essential, and documents are found through the other lists only;
* a document so found is looked up in a list that is not essential only if its block's maximum could still bring it to that score,
  before the block is decompressed;
* a task keeps one heap an item over all its shards, so later shards are asked with a score to beat; the tasks' heaps are merged by rank.

Scores are whole numbers as the contract defines them, so a result does not depend on how documents are dealt.

Edge cases: a null or empty text has no terms and does not count; a null doc_id counts as the smallest; repeated rows are documents of
their own, and items that repeat an item_id are ranked each for itself; items without terms, and empty tables, give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, rows, text_batches, texts, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that end a term become blanks, A-Z small letters; all bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SHARD, BLOCK, MOST, QUERY_BYTES, PIECE = 16_000_000, 64, 20, 4_000_000, 4_000_000
NO_ID = -(2**63)


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


@dataclass(frozen=True)
class Statistics:
    documents: int  # with a term
    terms: int  # of all of them, with repeats


def statistics(docs: DataFrame) -> Statistics:
    n = texts(docs).select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"))
    found = n.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    return Statistics(found["documents"], found["terms"] or 0)


def length_factor(n: np.ndarray, of: Statistics) -> np.ndarray:
    """m of documents with n terms; exact also where 64 bits would not do."""
    exact = n.astype(object) if len(n) and int(n.max()) * 25 * of.documents >= 2**63 else n
    return (75 + (25 * exact * of.documents) // max(of.terms, 1)).astype(np.int64)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, and where each number begins (one more: the end)."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        out[at[:-1][here] + k] = (values[here] >> 7 * k & 127) | np.where(size[here] > k + 1, 128, 0)
    return out, at


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begins)


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("last", pa.list_(pa.int32())), ("best", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("postings", pa.binary()), ("ids", pa.binary()), ("m", pa.binary())])
_INDEX_DDL = "shard long, term string, df long, last array<int>, best array<long>, at array<int>, postings binary, ids binary, m binary"


class _Shard:
    """Texts of one shard as they come; ``batch`` gives its rows of the index."""

    def __init__(self):
        self.numbers, self.ids, self.tokens, self.bytes = _Numbers(), [], [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        folded = raw.translate(_FOLD)
        found, at = [], 0
        while at < len(folded):  # a very long text in pieces that end at a blank
            end = folded.find(b" ", at + PIECE)
            end = len(folded) if end < 0 else end
            some = folded[at:end].split()
            found.append(np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some)))
            at = end
        own = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(own):
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.tokens.append(own)
            self.bytes += len(raw)

    def batch(self, shard: int, of: Statistics) -> pa.RecordBatch:
        n = np.array([len(t) for t in self.tokens], np.int64)
        m = length_factor(n, of)
        number = np.array(sorted(range(len(self.numbers)), key=list(self.numbers).__getitem__), np.int64)  # terms in order
        place = np.empty_like(number)
        place[number] = np.arange(len(number))
        keys, tf = np.unique(place[np.concatenate(self.tokens)] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, doc = keys // len(n), keys % len(n)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(begins, append=len(keys))
        nth = np.arange(len(keys)) - np.repeat(begins, df)
        gap = np.where(nth == 0, doc + 1, np.diff(doc, prepend=0))
        raw, at = packed(np.stack([gap, tf], axis=1).ravel())
        blocks = np.flatnonzero(nth % BLOCK == 0)
        n_blocks = -(-df // BLOCK)
        to = np.append(blocks[1:], len(keys))
        best = np.maximum.reduceat(contribution(tf, m[doc]), blocks)
        at_block, at_term = at[2 * blocks], at[2 * begins]
        lists = np.concatenate([[0], np.cumsum(n_blocks), [n_blocks.sum()]]).astype(np.int32)
        held = lambda x, kind: pa.ListArray.from_arrays(pa.array(lists), pa.array(x, kind))
        ends = np.concatenate([at_term, [len(raw)], [len(raw)]]).astype(np.int32)
        k = len(df)
        names = [t.decode("utf-8", "replace") for t in sorted(self.numbers)]
        none = [None] * k
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(k + 1, shard)), pa.array([*names, ""], pa.string()), pa.array(np.append(df, 0)), held(doc[to - 1], pa.int32()), held(best, pa.int64()), held(at_block - np.repeat(at_term, n_blocks), pa.int32()),
            pa.BinaryArray.from_buffers(pa.binary(), k + 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]),
            pa.array([*none, np.array(self.ids, "<i8").tobytes()], pa.binary()), pa.array([*none, m.astype("<i8").tobytes()], pa.binary()),
        ], schema=_INDEX)


def index(docs: DataFrame, of: Statistics, shard_bytes: int = SHARD) -> DataFrame:
    """The inverted index of all documents: a row for each term of a shard, and one with an empty term for its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for ids, raws in text_batches(batches):
            for doc_id, raw in zip(ids, raws, strict=True):
                shard.add(doc_id, raw)
                if shard.bytes >= shard_bytes:
                    yield shard.batch(number, of)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.batch(number, of)

    return texts(docs).mapInArrow(run, _INDEX_DDL)


class _Postings:
    """One term's list in a shard, decompressed block by block as it is asked for."""

    def __init__(self, last: np.ndarray, best: np.ndarray, at: np.ndarray, raw: bytes, m: np.ndarray):
        self.last, self.best, self.raw, self.m = last, best, np.frombuffer(raw, np.uint8), m
        self.at = np.append(at, len(raw))
        self.most = int(best.max())
        self._whole: tuple[np.ndarray, np.ndarray] | None = None
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _read(self, begin: int, end: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        values = unpacked(self.raw[begin:end])
        docs = before + np.cumsum(values[::2])
        return docs, contribution(values[1::2], self.m[docs])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self._whole is None:
            self._whole = self._read(0, len(self.raw), -1)
        return self._whole

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self._blocks:
            self._blocks[b] = self._read(self.at[b], self.at[b + 1], int(self.last[b - 1]) if b else -1)
        return self._blocks[b]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that would hold each document, and the best contribution in it (0 beyond the last block)."""
        b = np.searchsorted(self.last, docs)
        return b, np.where(b < len(self.last), self.best[np.minimum(b, len(self.last) - 1)], 0)

    def of(self, docs: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Contributions to documents (ascending) whose blocks are known."""
        out = np.zeros(len(docs), np.int64)
        for one in np.unique(b):
            here = np.flatnonzero(b == one)
            held, worth = self._whole if self._whole is not None else self.block(int(one))
            at = np.minimum(np.searchsorted(held, docs[here]), len(held) - 1)
            out[here] = np.where(held[at] == docs[here], worth[at], 0)
        return out


class _Heap:
    """The best of an item so far: scores and ids, best first."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def goal(self) -> int:
        """A score below this is of no use."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def ask(item: list[tuple[int, _Postings]], ids: np.ndarray, heap: _Heap) -> None:
    """Take what one shard has for an item: lists with their weights."""
    order = sorted(item, key=lambda x: x[0] * x[1].most)
    bounds = np.cumsum([w * p.most for w, p in order])
    first = int(np.searchsorted(bounds, heap.goal))  # the lists before it don't reach the goal together
    if first == len(order):
        return
    total = np.zeros(len(ids), np.int64)
    for w, p in order[first:]:
        docs, worth = p.whole()
        total[docs] += w * worth
    docs = np.flatnonzero(total)
    scores = total[docs]
    for k in range(first - 1, -1, -1):
        enough = scores + int(bounds[k]) >= heap.goal
        docs, scores = docs[enough], scores[enough]
        if not len(docs):
            return
        w, p = order[k]
        b, best = p.bounds(docs)
        rest = int(bounds[k - 1]) if k else 0
        enough = scores + w * best + rest >= heap.goal
        docs, scores, b, best = docs[enough], scores[enough], b[enough], best[enough]
        there = np.flatnonzero(best > 0)
        scores[there] += w * p.of(docs[there], b[there])
    enough = scores >= heap.goal
    heap.add(scores[enough], ids[docs[enough]])


def query_blocks(items: DataFrame, most_bytes: int = QUERY_BYTES) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """The query set in blocks whose texts have about so many bytes: item_id and how often it has each term."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most_bytes)
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], Counter(terms(r["text"].encode()))) for r in part.toLocalIterator()]  # about most_bytes


def search(found: DataFrame, of: Statistics, items: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item (item_id, text) in an index."""
    spark: SparkSession = found.sparkSession
    parts = [_search_block(spark, found, of, block, most) for block in query_blocks(items)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_block(spark: SparkSession, found: DataFrame, of: Statistics, block: list[tuple[int, dict[bytes, int]]], most: int) -> DataFrame:
    asked = sorted({t for _, own in block for t in own})
    names = [t.decode("utf-8", "replace") for t in asked]
    listed = F.broadcast(spark.createDataFrame([(t,) for t in names], "term string"))  # at most QUERY_BYTES
    df = {r["term"]: r["df"] for r in found.select("term", "df").join(listed, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # of the block's terms
    weights = {n: weight(of.documents, df[n]) for n in names if n in df}
    sent = spark.sparkContext.broadcast([[(n, k * weights[n]) for t, k in own.items() if (n := t.decode("utf-8", "replace")) in weights] for _, own in block])
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, heaps = sent.value, [_Heap(most) for _ in sent.value]

        def answer(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            named = t.column("term").to_pylist()
            own = named.index("")
            m, ids = (np.frombuffer(t.column(c)[own].as_py(), "<i8") for c in ("m", "ids"))
            lists = {}
            for i, (name, last, best, at, raw) in enumerate(zip(named, *(t.column(c) for c in ("last", "best", "at", "postings")), strict=True)):
                if i != own:
                    lists[name] = _Postings(*(x.values.to_numpy() for x in (last, best, at)), raw.as_py(), m)
            for item, heap in zip(wanted, heaps, strict=True):
                there = [(w, lists[n]) for n, w in item if n in lists and w > 0]
                if there:
                    ask(there, ids, heap)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("shard")[0].as_py() != int(shards[a]):
                    answer(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            answer(held)
        for k, heap in enumerate(heaps):
            if len(heap.scores):
                yield rows(schema, [k] * len(heap.scores), heap.ids, heap.scores)

    some = found.filter("term = ''").unionByName(found.filter("term <> ''").join(listed, "term", "left_semi").select(*found.columns))
    dealt = some.repartition(partitions_for(some), "shard").sortWithinPartitions("shard")
    best = dealt.mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    numbered = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long"))  # a block of items
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return ranked.join(numbered, "item").select("item_id", "rank", doc, "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """Index the documents, written as a table in the shared folder, and search for every item."""
    of = statistics(docs)
    return search(written(index(docs, of), "lexical-index"), of, items, most)
