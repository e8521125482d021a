"""Removal of repeated word windows by level-wise doubling.

``anchored`` brings passages that can share windows to meeting places. There, words that stand more than once are
extended to pairs, repeated pairs to four words, and so on until the length is ``WINDOW``; a level looks only at what
survived the one before, and compares exactly, as a window is the pair of two shorter ones that have been compared.

Edge cases: a null text has no words; texts with fewer words than a window lose nothing; rows of equal doc_id count as
occurrences of their own; a null doc_id counts as the smallest; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Kind, Passages, remove_repeats
from .suffix_dedup import runs

WINDOW, GRAM = 35, 9
KIND = Kind(words=True, window=WINDOW, gram=GRAM, anywhere=True, section=256)
BATCH = 1 << 20  # words compared together


def lengths(window: int = WINDOW) -> list[int]:
    """1, 2, 4, ..., window."""
    out = [1]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def decide(some: Passages, kind: Kind = KIND) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, first, last window) runs that stand more than once at their meeting place."""
    if not some.bodies:
        return
    order = np.argsort(some.place, kind="stable")
    new = np.append(True, some.place[order][1:] != some.place[order][:-1])
    words = np.cumsum(some.windows[order] + kind.window - 1)
    batch = (words // BATCH)[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # a meeting place stays together
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(batch)) + 1):
        who = order[part]
        at, window = repeated([some.bodies[i].split() for i in who.tolist()], np.cumsum(new[part]), some.times[who], kind.window)
        if len(at):
            passage, first, last = runs(at, window)
            yield who[passage], first, last


def repeated(passages: list[list[bytes]], names: np.ndarray, times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Among passages of equal names: (passage, place) of the windows that stand there more than once; ``times``: what a passage counts for.

    ``rank``: a number per place that is equal for equal windows of the level's length and the same name, -1 if the
    window stands only once. A window of the next length is the pair of two that overlap or touch, so ranks are exact.
    """
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    passage = np.repeat(np.arange(len(passages)), sizes)
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(w, len(known)) for p in passages for w in p), np.int64, len(passage))
    counts = times[passage]
    rank, length = _ranks(names[passage], word, counts), 1
    for longer in lengths(window)[1:]:
        at = np.flatnonzero((rank >= 0) & (np.arange(len(rank)) + longer <= ends[passage]))
        at = at[rank[at + longer - length] >= 0]
        new = np.full(len(rank), -1)
        new[at] = _ranks(rank[at], rank[at + longer - length], counts[at])
        rank, length = new, longer
    at = np.flatnonzero(rank >= 0)
    return passage[at], at - (ends - sizes)[passage[at]]


def _ranks(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number per pair (a, b), -1 where a pair's counts add up to 1 only."""
    if not len(a):
        return np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    new = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
    at = np.flatnonzero(new)
    many = np.add.reduceat(counts[order], at) > 1
    out = np.empty(len(a), np.int64)
    out[order] = np.repeat(np.where(many, np.arange(len(at)), -1), np.diff(np.append(at, len(a))))
    return out


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space); on request that text as ``kept``."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])]

    def finish(raw: bytes, gone: np.ndarray) -> tuple:
        words = raw.split()
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else []))

    return remove_repeats(docs, KIND, decide, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text, pa.schema(fields))
