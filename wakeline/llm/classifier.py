"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. ``statistics`` turns each whole text into some twenty bounded ratios and logarithms (no label, language, source or id).
2. Random Fourier features ``sqrt(2/D) cos(W x + b)`` with a fixed seed approximate a Gaussian kernel on the standardised
   statistics.
3. Every partition sums its share of ``Z'Z`` and ``Z'y`` (per fold); the sums are added and solved with a ridge term.
4. Scores of each half of the fitting rows under the model of the other half give an isotonic calibration to [0, 1].

Fitting takes a bounded sample of labelled rows: ``max_rows`` (a parameter) in expectation, chosen by a hash of doc_id,
so the sample does not depend on partitioning. Scoring covers every row in one pass without a shuffle.

Edge cases: a null text counts as empty and gets a score like any other; labels that are null, or for ids that have no
document, are ignored; of documents repeated under one id the smallest text is fitted, and all are scored; without usable labels every score
is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import rows, text_batches, texts

STATISTICS = (
    "log_words", "word_length", "symbols", "bangs", "bars", "digits", "upper", "letters_ascii", "stops", "commas", "other_marks",
    "log_line_words", "duplicate_lines", "next_same", "distinct_words", "top_word", "entropy", "blanks", "capitalised_words", "short_words",
)
_GROUPS = {"symbols": b"#*$%&<>", "bangs": b"!", "bars": b"|", "digits": b"0123456789", "upper": bytes(range(65, 91)), "letters_ascii": bytes(range(65, 91)) + bytes(range(97, 123)), "stops": b".?", "commas": b",;:", "other_marks": b"@/\\_=+~^`{}[]()\"-"}
MAX_ROWS, FEATURES, RIDGE, SEED = 20_000, 256, 3e-3, 11


def text_statistics(raw: bytes) -> list[float]:
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = lambda kind: int(counts[np.frombuffer(kind, np.uint8)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / size
    of: dict[bytes, int] = {}
    for w in words:
        of[w] = of.get(w, 0) + 1
    m, sizes = max(n, 1), np.fromiter(map(len, words), np.int64, n)
    per_word = {k: total(_GROUPS[k]) / m for k in ("symbols", "bangs", "bars", "stops", "commas", "other_marks")}
    return [
        math.log1p(n), min(float(sizes.mean()) if n else 0.0, 40.0), min(per_word["symbols"], 4.0), min(per_word["bangs"], 4.0), min(per_word["bars"], 4.0), total(_GROUPS["digits"]) / size,
        total(_GROUPS["upper"]) / size, total(_GROUPS["letters_ascii"]) / size, min(per_word["stops"], 4.0), min(per_word["commas"], 4.0), min(per_word["other_marks"], 4.0),
        math.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), sum(map(bytes.__eq__, words, words[1:])) / m, len(of) / m / max(1.0, 8 / math.log2(m + 2)), max(of.values(), default=0) / m,
        float(-(p * np.log2(p)).sum()), int(counts[[9, 10, 11, 12, 13, 32]].sum()) / size, sum(map(bytes.istitle, words)) / m, float((sizes <= 3).mean()) if n else 0.0,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of STATISTICS."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches):
            yield rows(schema, ids, [text_statistics(r) for r in raws])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    steps: np.ndarray  # raw scores, increasing
    levels: np.ndarray  # calibrated values there

    def features(self, x: np.ndarray) -> np.ndarray:
        """Term by term: a product of matrices rounds a row by its place among the others, so equal texts would differ in the last bits."""
        at = np.tile(self.phases, (len(x), 1))
        for column, weights in zip(((x - self.mean) / self.scale).T, self.weights, strict=True):
            at += column[:, None] * weights
        return np.hstack([np.cos(at) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return np.clip(np.interp((self.features(x) * self.beta).sum(axis=1), self.steps, self.levels), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (block centres, block means), ready for linear interpolation. Equal scores are one point."""
    at, inverse = np.unique(score, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # weighted score, weighted label, weight
    for s, y, w in zip(at, np.bincount(inverse, weights=label), n, strict=True):
        blocks.append([s * w, y, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of all ids, by a checksum; their labels are for measuring, never for fitting."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def sampled_labels(labels: DataFrame, learnable: Column, max_rows: int, label: str = "quality") -> DataFrame:
    """doc_id, y: one row per labelled id that may be learned from; beyond ``max_rows`` of them a hash picks that many in expectation."""
    usable = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    n = usable.count()
    share = min(1.0, max_rows / max(n, 1))
    return usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on at most about ``max_rows`` labelled documents; only sums of a fixed size and the sample's scores reach the driver."""
    sample = F.broadcast(sampled_labels(labels, learnable, max_rows))  # bounded by max_rows
    # of documents repeated under one id the smallest text is fitted, so rows are bounded like ids
    chosen = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")
    k, rng = len(STATISTICS), np.random.default_rng(seed)
    facts = statistics(chosen).join(sample, "doc_id").select("x", "y", fold.alias("fold")).persist()
    try:
        moments = facts.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)), *(F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(k))).first()
        n = moments["n"]
        if not n:
            zero = np.zeros(0)
            return Model(np.zeros(k), np.ones(k), np.zeros((k, features)), np.zeros(features), zero, zero, zero)
        mean = np.array([moments[f"s{i}"] for i in range(k)]) / n
        scale = np.sqrt(np.maximum(np.array([moments[f"q{i}"] for i in range(k)]) / n - mean**2, 0))
        scale = np.where(scale > 1e-9, scale, 1.0)
        bare = Model(mean, scale, rng.normal(size=(k, features)) / math.sqrt(k), rng.uniform(0, 2 * math.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
        size = features + 1

        def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, size, size + 1))
            for b in batches:
                if b.num_rows:
                    z, y, side = bare.features(np.array(b.column("x").to_pylist())), b.column("y").to_numpy(), b.column("fold").to_numpy()
                    for f in (0, 1):
                        sums[f] += z[side == f].T @ np.column_stack([z, y])[side == f]
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        total = np.zeros((2, size, size + 1))
        for part in facts.coalesce(16).mapInArrow(normal_equations, "sums binary").toLocalIterator():  # at most 16 sums of a fixed size
            total += np.frombuffer(part["sums"]).reshape(total.shape)
        solve = lambda s: np.linalg.solve(s[:, :size] + ridge * n * np.eye(size) / size, s[:, size])
        halves, whole = [solve(s) for s in total], solve(total.sum(axis=0))

        def cross_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    z, side = bare.features(np.array(b.column("x").to_pylist())), b.column("fold").to_numpy()
                    score = np.where(side == 0, z @ halves[1], z @ halves[0])
                    yield pa.RecordBatch.from_arrays([pa.array(score), b.column("y")], ["score", "y"])

        pairs = facts.mapInArrow(cross_scores, "score double, y double").toPandas()  # bounded by max_rows
        steps, levels = isotonic(pairs["score"].to_numpy(), pairs["y"].to_numpy())
    finally:
        facts.unpersist()
    return Model(mean, scale, bare.weights, bare.phases, whole, steps, levels)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document; one pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches):
            yield rows(schema, ids, shared.value.score(np.array([text_statistics(r) for r in raws])))

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (the whole input row) and its score: each row for itself, whatever its doc_id; one pass, no shuffle."""
    whole = StructType([StructField("_row", docs.schema, False), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(0).field(at).cast(pa.large_binary())
            for start in range(0, batch.num_rows, 512):
                raws = [x or b"" for x in texts_.slice(start, 512).to_pylist()]
                found = shared.value.score(np.array([text_statistics(r) for r in raws]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 512), pa.array(found)], ["_row", "score"])

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).mapInArrow(run, whole)
