"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for two 31-bit moduli, the running sums ``P[i] = sum(c[j] * b**j) mod p`` over a text's code points.
Any span's hash is ``(P[i+n] - P[i]) * b**-i``, so span equality takes constant time and the longest common extension of
two positions a binary search. A fingerprint is the hash of the whole text, its length, and the ``SKETCH`` smallest
mixed hashes of its ``SPAN``-code-point spans (a bottom-k sample of the set of spans). Likeness of two fingerprints is
the share of spans in common (Dice's coefficient, from the bottom-k estimate of the Jaccard index of the two span sets),
and 1 for equal whole hashes and lengths.

``edited`` pairs each document with the next one by descending doc_id. Documents are dealt by doc_id ranges, each with a
copy of the first document of the range that follows, so each task streams its ranges and no window spans the table.

Edge cases: a null text counts as empty; texts shorter than a span are one span; rows of equal doc_id are ordered by text; a
null doc_id counts as the smallest; a table of one row is its own next document; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, shuffle_partitions, texts

MODULI, BASES = (2147483647, 2147483629), (1000003, 998244353)
SPAN, SKETCH = 8, 64
_U = np.uint64


class _Powers:
    """b**i mod p and its inverses, grown by doubling as longer texts come."""

    def __init__(self, base: int, modulus: int):
        self.base, self.p = base, modulus
        self.table = np.ones(1, _U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = _U(pow(self.base, len(self.table), self.p))
            self.table = np.concatenate([self.table, self.table * step % _U(self.p)])
        return self.table[:n]


_FORWARD = [_Powers(b, p) for b, p in zip(BASES, MODULI, strict=True)]
_BACKWARD = [_Powers(pow(b, -1, p), p) for b, p in zip(BASES, MODULI, strict=True)]


class PrefixHash:
    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for powers, p in zip(_FORWARD, MODULI, strict=True):
            terms = (points.astype(_U) + _U(1)) * powers.upto(self.n) % _U(p)
            self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(terms) % _U(p)]))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length at ``starts``."""
        out = np.zeros(len(starts), _U)
        for sums, inverse, p in zip(self.sums, _BACKWARD, MODULI, strict=True):
            value = (sums[starts + length] + _U(p) - sums[starts]) % _U(p)
            out = (out << _U(31)) | (value * inverse.upto(self.n + 1)[starts] % _U(p))
        return out

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])

    def extension(self, at: int, other: PrefixHash, other_at: int) -> int:
        """Longest common extension from two positions: binary search over span equality."""
        most = min(self.n - at, other.n - other_at)
        return bisect_left(range(1, most + 1), True, key=lambda n: self.span(at, n) != other.span(other_at, n))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def fingerprint(hashes: PrefixHash) -> str:
    """16 hex digits of whole hash, 8 of length, then the sketch, 16 digits each, ascending."""
    length = min(SPAN, hashes.n)
    found = _mixed(hashes.spans(np.arange(hashes.n - length + 1), length)) if hashes.n else np.zeros(0, _U)
    if len(found) > 4 * SKETCH:
        # repeated spans count once: widen the prefix until it holds enough different ones
        most = 2 * SKETCH
        while True:
            smallest = np.unique(np.partition(found, most)[:most])
            if len(smallest) > SKETCH or 4 * most >= len(found):
                break
            most *= 4
        found = smallest if len(smallest) > SKETCH else found
    sketch = np.unique(found)[:SKETCH]
    return f"{hashes.span(0, hashes.n):016x}{hashes.n:08x}" + sketch.astype(">u8").tobytes().hex()


def sketch_of(mark: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(mark[24:]), ">u8")


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a[:24] == b[:24]:
        return 1.0
    x, y = sketch_of(a), sketch_of(b)
    union = np.union1d(x, y)[:SKETCH]
    shared = len(np.intersect1d(np.intersect1d(x, y), union))
    return 2 * shared / max(len(union) + shared, 1)


def _blocks(docs: DataFrame, n: int) -> list[int]:
    """The largest doc_id of each of about ``n`` blocks, ascending: one number a block comes to the driver."""
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    edges = np.array(sorted(set(cuts)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.sort(b.column("doc_id").to_numpy())
            block = np.searchsorted(edges, ids, "right")
            last = np.flatnonzero(np.append(block[1:] != block[:-1], True)) if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(block[last], pa.int32()), pa.array(ids[last])], ["block", "top"])

    found = docs.mapInArrow(tops, "block int, top long").groupBy("block").agg(F.max("top").alias("top"))
    return sorted(r["top"] for r in found.collect())


def edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix_next."""
    own = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    n = ranges or shuffle_partitions(docs.sparkSession) * 4
    tops = np.array(_blocks(own.select("doc_id"), max(n, 2)), np.int64)
    # blocks count from the largest ids; the largest document of each follows the smallest of the block before it, that of the first block the very last
    follows = {int(top): (len(tops) - 2 - i) % len(tops) for i, top in enumerate(tops)}
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_next", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("block", pa.int32()), ("ahead", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            home = len(tops) - 1 - np.searchsorted(tops, ids)  # blocks count from the largest ids
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(np.zeros(len(ids), bool)), b.column("doc_id"), b.column("text").cast(pa.string())], schema=kinds)
            top = np.flatnonzero(np.isin(ids, tops))
            if len(top):
                also = b.take(pa.array(top))
                to = [follows[i] for i in also.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(to), bool)), also.column("doc_id"), also.column("text").cast(pa.string())], schema=kinds)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            for b in batches:
                for block, ahead, doc_id, text in zip(b.column("block").to_pylist(), b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    yield block, ahead, doc_id, text.as_py()

        def described(doc, following):
            doc_id, text, hashes, mark = doc
            half = len(text) // 2
            new = text[: len(text) - half] + following[1][:half]
            made = PrefixHash(code_points(new))
            its = fingerprint(made)
            return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, its, likeness(mark, its), likeness(mark, following[3]), hashes.extension(0, following[2], 0)

        out: list[tuple] = []
        held_back, at = None, None
        for block, ahead, doc_id, text in documents():
            if block == at and held_back is None:
                continue  # ties of the document ahead: only the first of them follows
            hashes = PrefixHash(code_points(text))
            doc = (doc_id, text, hashes, fingerprint(hashes))
            if block == at:
                out.append(described(held_back, doc))
            held_back, at = (None if ahead else doc), block
            if len(out) >= 500:
                yield rows(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield rows(schema, *zip(*out, strict=True))

    dealt = own.mapInArrow(deal, "block int, ahead boolean, doc_id long, text string")
    # within a block: descending ids, the copy from the following block last
    sorted_blocks = dealt.repartition(max(1, min(len(tops), shuffle_partitions(docs.sparkSession))), "block").sortWithinPartitions("block", "ahead", F.col("doc_id").desc(), "text")
    done = sorted_blocks.mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_next long")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
