"""Best-fit packing of token sequences, bounded-space and online.

Each task packs the pieces of its own partition as they come, so there is no shuffle and a lost executor only repeats its
partitions. Bins don't outlive their task, so small partitions are joined to ones of ``BYTES`` of text at least. ``BestFit`` keeps a fixed number of bins open; a bitset with one bit per amount of free space finds the
fullest bin that still takes a piece with two integer operations. If nothing fits and all bins are open, the fullest one
closes. A place is known as soon as a piece comes, so pieces stream out and nothing waits in memory.

A document is its token ids and the separator id. Longer documents are cut so that all pieces but the first have exactly
``length`` tokens: only the first, shorter one needs a best fit.

Edge cases: a null or empty text is the separator alone; repeated rows are packed each; an empty table gives no pieces;
other columns are not read; a literal ``<|endoftext|>`` in a text is the vocabulary's added token, as in the JSON file.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, text_batches, texts

LENGTH, SEPARATOR, OPEN_BINS = 1024, 2, 512
BYTES = 24_000_000  # of text in a task, if there is so much
ADDED = {"<|endoftext|>": 50256}  # the added token of byte_bpe_50k.json; the ranks file has only the others
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


class BestFit:
    """Online best fit over at most ``open_bins`` open bins of ``length``."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1..length."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open == self.open_bins and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.length, self.n_bins
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.length - free


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The byte-level BPE vocabulary as tiktoken ranks: the ids of the JSON file of the same vocabulary, at a fifth of the time."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def cuts(n: int, length: int) -> list[int]:
    """Starts of the pieces of n tokens: the first takes what is left over."""
    first = n % length or length
    return [0, *range(first, n, length)]


def pack(docs: DataFrame, ranks_path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR, open_bins: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids.

    ``ranks_path``: vocabulary file, readable on every executor; by default the packaged 50k byte-level BPE.
    """
    schema = _SCHEMA if with_ids else pa.schema(list(_SCHEMA)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_to_numpy
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 33
        for ids, raws in text_batches(batches):
            out: list[tuple] = []
            for doc_id, raw in zip(ids, raws, strict=True):
                tokens = np.append(encode(raw.decode("utf-8", "replace"), allowed_special="all").astype("<u4"), np.uint32(separator))
                starts = cuts(len(tokens), length)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(tokens)], strict=True)):
                    piece = tokens[a:b]
                    bin_id, offset = bins.place(b - a)
                    out.append((doc_id, k, a, b - a, zlib.crc32(piece.tobytes()), base + bin_id, offset, *([piece] if with_ids else ())))
            if out:
                yield rows(schema, *zip(*out, strict=True))

    own = texts(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return own.coalesce(max(1, round(size / BYTES))).mapInArrow(run, kinds + ", ids array<int>" * with_ids)
