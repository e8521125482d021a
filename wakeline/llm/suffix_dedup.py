"""Suffix-array deduplication: bytes covered by a string that also starts in a smaller document are removed.

``anchored`` brings passages that can share windows to meeting places. The passages of each place become one string, its
suffix array is built by linear grouping (``linear_grouping``), and neighbouring suffixes that agree in ``LENGTH`` bytes,
which are compared, are windows that repeat. Windows of anchors that few documents have are decided by suffix arrays only;
of those that many have, equal pieces of one task are compared and combined before.

Edge cases: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; rows of equal doc_id are the same document
and don't remove each other; a null doc_id counts as the smallest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Kind, Passages, cut, mix, remove_repeats
from .linear_grouping import suffix_arrays

LENGTH, GRAM = 50, 20
KIND = Kind(words=False, window=LENGTH, gram=GRAM, anywhere=False, section=512)
BATCH, LARGE, PART = 1 << 19, 1 << 16, 1 << 17  # bytes sorted together (what fits the caches), in one string, and cut together
_U = np.uint64


def decide(some: Passages, kind: Kind = KIND) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, first, last window) runs to remove; a meeting place of one document has none.

    Where a place's string would be long, its passages are cut into fragments again, and those of each anchor make a string.
    """
    if not some.bodies:
        return
    size = np.fromiter(map(len, some.bodies), np.int64, len(some.bodies))
    names, place = np.unique(some.place, return_inverse=True)
    long = np.bincount(place, weights=size)[place] > LARGE
    short = np.flatnonzero(~long)
    yield from _sorted(names[place[short]], short, np.zeros(len(short), np.int64), size[short], some, kind)
    at = np.flatnonzero(long)
    if len(at):  # cut a part at a time, but sorted together: passages of one place may be in several parts
        parts = np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // PART)) + 1)
        pieces = [_recut(part, some, kind) for part in parts]
        yield from _sorted(*(np.concatenate(x) for x in zip(*pieces, strict=True)), some, kind)


def _recut(part: np.ndarray, some: Passages, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, passage, offset, size) of the fragments of some passages."""
    bodies = [some.bodies[i] for i in part.tolist()]
    bounds = np.cumsum([0] + [len(b) for b in bodies])
    f = cut(kind.values(bodies), bounds, kind)
    return mix(mix(some.place[part[f.text]]) ^ f.key), part[f.text], f.first - bounds[f.text], f.last - f.first + kind.window


def _sorted(name, passage, offset, size, some: Passages, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces ``size`` long at an offset of passages; those of one name make a string, whose suffix array decides them.

    Where more than two documents have equal pieces, those of the smallest and of the next one are sorted, and the rest share
    the next one's verdict: whatever repeats for it does for them.
    """
    order = np.lexsort((some.doc[passage], name))
    name, passage, offset, size = name[order], passage[order], offset[order], size[order]
    if not len(order):
        return
    doc = some.doc[passage]
    starts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    counts = np.diff(np.append(starts, len(order)))
    differ = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    keep = np.repeat(differ, counts)
    group = np.repeat(np.arange(int(differ.sum())), counts[differ])
    passage, offset, size, doc = passage[keep], offset[keep], size[keep], doc[keep]
    if not len(group):
        return
    pieces = [some.bodies[i][a : a + n] for i, a, n in zip(passage.tolist(), offset.tolist(), size.tolist(), strict=True)]
    leader = np.arange(len(group))
    known: dict[tuple[int, bytes], list[int]] = {}
    for i, (g, d, piece) in enumerate(zip(group.tolist(), doc.tolist(), pieces, strict=True)):
        first = known.setdefault((g, piece), [d, -1])
        if d > first[0] and first[1] < 0:
            first[1] = i
        elif d > first[0]:
            leader[i] = first[1]
    own = np.flatnonzero(leader == np.arange(len(leader)))
    rest = np.flatnonzero(leader != np.arange(len(leader)))
    rest = rest[np.argsort(leader[rest], kind="stable")]
    total = np.bincount(group[own], weights=size[own] + 1).astype(np.int64)
    nth = np.argsort(np.argsort(total, kind="stable"), kind="stable")  # strings of like length are sorted together
    own = own[np.argsort(nth[group[own]], kind="stable")]
    names = nth[group[own]]
    batch = ((np.cumsum(np.sort(total, kind="stable")) - 1) // BATCH)[names]
    for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(batch)) + 1):
        who = own[part]
        end = np.cumsum(size[who])
        at, window = repeated(np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), np.uint8), names[part], end - size[who], end, doc[who], kind.window)
        if len(at):
            found, first, last = runs(at, window)
            found = who[found]
            yield passage[found], offset[found] + first, offset[found] + last
            low, high = np.searchsorted(leader[rest], found, "left"), np.searchsorted(leader[rest], found, "right")
            run = np.repeat(np.arange(len(found)), high - low)
            ends = np.cumsum(high - low)
            also = rest[np.arange(len(run)) + np.repeat(low - (ends - (high - low)), high - low)]
            yield passage[also], offset[also] + first[run], offset[also] + last[run]


def repeated(flat: np.ndarray, names: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Among pieces ``flat[start:end]``, one after another, of equal (sorted) names: (piece, offset) of the windows that a smaller document has too."""
    n = len(names)
    new = np.append(True, names[1:] != names[:-1])
    last = np.append(new[1:], True)
    width = end - start + 1 + last  # a separator after each piece, an end symbol after each string
    piece = np.repeat(np.arange(n), width)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(width) - width, width)
    left = np.repeat(end - start, width) - offset  # symbols up to the separator
    inside = left > 0
    byte = np.zeros(len(piece) + 8, np.uint8)
    byte[: len(piece)][inside] = flat
    symbol = np.where(inside, byte[: len(piece)].astype(np.int64) + 2, left + 1)
    order = suffix_arrays(symbol, np.add.reduceat(width, np.flatnonzero(new)))
    order = order[left[order] >= window]
    eight = np.zeros(len(piece), _U)
    for i in range(8):
        eight |= byte[i : i + len(piece)].astype(_U) << _U(8 * i)
    if not len(order):
        return order, order
    of = piece[order]
    same = names[of[1:]] == names[of[:-1]]
    for i in (*range(0, window - 8, 8), window - 8):
        there = eight[order + i]
        same &= there[1:] == there[:-1]
    firsts = np.flatnonzero(np.append(True, ~same))
    of_doc = doc[of]
    least = np.repeat(np.minimum.reduceat(of_doc, firsts), np.diff(np.append(firsts, len(order))))
    gone = order[of_doc > least]
    return piece[gone], offset[gone]


def runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the maximal runs of neighbouring places."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1)
    firsts = np.flatnonzero(new)
    return owner[firsts], place[firsts], place[np.append(firsts[1:], len(owner)) - 1] if len(owner) else place


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; on request the kept bytes as ``kept``."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])]

    def finish(raw: bytes, gone: np.ndarray) -> tuple:
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        return (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else []))

    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return remove_repeats(docs, KIND, decide, finish, columns, pa.schema(fields))
