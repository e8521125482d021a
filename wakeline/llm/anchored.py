"""Where repeated windows of a fixed length can meet, for a whole corpus; an operator's own method then decides them.

A text is a sequence of symbols (bytes or words). Of each window of ``window`` symbols, the ``gram``-symbol string inside
it with the smallest hash is its anchor, so equal windows have equal anchors. Anchors deal work out, and nothing else:
no window is removed because hashes agree.

1. ``scan``: each task cuts its texts into fragments (neighbouring windows of one anchor) and sends which documents have
   which anchors, once per document.
2. ``meet``: an anchor that only one document has is done with. Else its windows meet at the smallest of its documents,
   in the section of it where the anchor stands; documents are told so. An anchor that more than ``FEW`` documents have is hot.
3. ``fetch``: documents cut out the passages that were asked for and send their symbols to the meeting place; neighbouring
   fragments with one meeting place travel as one passage. Windows of a hot anchor are dealt by what they hold: windows
   whose anchor stands at four neighbouring places share all but six of their symbols, and the hash of these is their
   meeting place, so that only windows that can be equal meet. Equal pieces of one task are combined there, after comparing them.
4. ``decided``: the method of the operator gets the passages of each meeting place and names the windows to remove.
5. ``covered``: documents get the spans to remove.

Hashes that collide bring windows together that differ, which costs time but changes nothing. Texts longer than a slice
are cut into overlapping slices, so memory is bounded by ``SLICE`` symbols. A row is named by its document and its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, texts
from .sorting import grouped_order, packed_order

_U = np.uint64
CHUNK = 1 << 21  # bytes of text sent together
SLICE = 1 << 17  # symbols handled at once: their hashes should stay in a core's cache
HELD = 1 << 20  # entries gathered before they are sent
FEW = 64  # documents of an anchor that meet at one of them
PLACES = 4  # neighbouring places of a hot anchor that are dealt together
LONGEST = 4096  # windows in a passage
HOT = 0
_LOW = (1 << 22) - 1
_MASK48 = _U((1 << 48) - 1)
_B = 0x9E3779B97F4A7C15


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    m = 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * _U(pow(base, m, 1 << 64))
        m += k
    return out


class _Tables:
    """Powers modulo 2**64, grown as longer sequences come, and random values of bytes; made in the processes that need them."""

    powers = inverse = np.ones(1, _U)
    bytes_ = np.random.default_rng(7).integers(1, 2**64 - 1, 256, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.powers) < n:
            size = max(n, 1 << 16, 2 * len(cls.powers))
            cls.powers, cls.inverse = _table(_B, size), _table(pow(_B, -1, 1 << 64), size)
        return cls.powers, cls.inverse


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


class Sums:
    """Prefix sums that give the hash of any span."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _Tables.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(_U))


@dataclass(frozen=True)
class Kind:
    """What is sought: windows of ``window`` symbols that also start in a smaller document, or (``anywhere``) anywhere else.

    ``section``: symbols of the smallest document that make one meeting place.
    """

    words: bool
    window: int
    gram: int
    anywhere: bool
    section: int

    def symbols(self, raw: bytes) -> list[bytes] | bytes:
        return raw.split() if self.words else raw

    def values(self, pieces: list) -> np.ndarray:
        """A 64-bit value per symbol of the pieces, concatenated."""
        if self.words:
            import xxhash

            known: dict[bytes, int] = {}
            digest = xxhash.xxh64_intdigest
            return np.array([known.get(w) or known.setdefault(w, digest(w) | 1) for p in pieces for w in p], _U)
        return _Tables.bytes_[np.frombuffer(b"".join(pieces), np.uint8)]

    def body(self, piece, a: int, b: int) -> bytes:
        return b" ".join(piece[a:b]) if self.words else piece[a:b]


@dataclass
class Fragments:
    """Arrays with one entry per fragment: first and last window start, the anchor's start and hash, and the text's index."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    text: np.ndarray
    sums: Sums


def cut(values: np.ndarray, bounds: np.ndarray, kind: Kind) -> Fragments:
    """The fragments of the texts ``values[bounds[i]:bounds[i + 1]]``."""
    w, k, n = kind.window, kind.gram, len(values)
    none = np.zeros(0, np.int64)
    sums = Sums(values)
    if n < w:
        return Fragments(none, none, none, none.astype(_U), none, sums)
    grams = sums.sums[k:] - sums.sums[:-k]
    grams *= sums.inverse[: n - k + 1]
    grams = mix(grams)
    least = grams & ~_U(_LOW)
    least |= np.arange(len(grams), dtype=_U)
    reach, wide = 1, w - k + 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    for edges in (bounds[:-1], np.maximum(bounds[1:] - w + 1, bounds[:-1])):  # where a text's windows begin and end
        new[edges[edges < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    text = np.searchsorted(bounds, first, "right") - 1
    inside = first + w <= bounds[text + 1]
    first, last, text = first[inside], last[inside], text[inside]
    anchor = (least[first] & _U(_LOW)).astype(np.int64)
    return Fragments(first, last, anchor, grams[anchor] & _MASK48, text, sums)


def slices(raws: list[bytes], kind: Kind) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """(index of the text, symbols per piece, bounds, start of each piece in its text) of at most about SLICE symbols."""
    held: list[tuple[int, object, int]] = []
    size = 0

    def out():
        bounds = np.cumsum([0] + [len(h[1]) for h in held])
        return np.array([h[0] for h in held], np.int64), [h[1] for h in held], bounds, np.array([h[2] for h in held], np.int64)

    for i, raw in enumerate(raws):
        symbols = kind.symbols(raw)
        step = SLICE - kind.window + 1
        for at in range(0, max(len(symbols) - kind.window + 1, 1), step):
            piece = symbols[at : at + SLICE]
            if held and size + len(piece) > SLICE:
                yield out()
                held, size = [], 0
            held.append((i, piece, at))
            size += len(piece)
    if held:
        yield out()


def arrow_texts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """(ids, texts) of a batch, a chunk's bytes at a time."""
    ids, column = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes) // CHUNK
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(parts)) + 1) if len(ids) else []:
        take = pa.array(part)
        yield ids.take(take).to_pylist(), column.take(take).to_pylist()


def row_names(ids: list[int], raws: list[bytes]) -> np.ndarray:
    """Rows of one document with different texts have different names; rows that repeat share theirs, and their spans."""
    import xxhash

    return mix(np.array(ids, np.int64).view(_U)) ^ np.array([xxhash.xxh64_intdigest(r) for r in raws], _U)


# Packed rows: ``to`` the partition, ``kind`` what the row holds, four columns of bytes.
ENTRY, VERDICT, WANTED, PASSAGE, TEXT = 0, 1, 2, 3, 4
PACKED = "to int, kind int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def packed_rows(kind: int, to: np.ndarray, *columns: tuple[np.ndarray, Callable[[np.ndarray], bytes]]) -> Iterator[pa.RecordBatch]:
    """One row per destination, each column's part turned to bytes."""
    if not len(to):
        return
    order = packed_order(to)
    dest = to[order]
    cutoff = np.append(np.flatnonzero(np.append(True, dest[1:] != dest[:-1])), len(dest))
    spans = list(zip(cutoff[:-1].tolist(), cutoff[1:].tolist(), strict=True))
    data = []
    for values, encode in columns:
        sorted_ = values[order]
        data.append([encode(sorted_[x:y]) for x, y in spans])
    data += [[None] * len(spans)] * (4 - len(data))
    places, kinds = pa.array(dest[cutoff[:-1]], pa.int32()), pa.array([kind] * len(spans), pa.int32())
    yield pa.RecordBatch.from_arrays([places, kinds, *(pa.array(d, pa.binary()) for d in data)], schema=_SCHEMA)


def raw64(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).astype("<i8").tobytes()


def raw32(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).astype("<i4").tobytes()


def raw8(x: np.ndarray) -> bytes:
    return x.astype(np.uint8).tobytes()


def _int64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _int32(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d")), strict=True)


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class Deal:
    """Where things go: anchors and meeting places by their hash, documents by their id."""

    def __init__(self, n: int):
        self.n = n

    def hashed(self, key: np.ndarray) -> np.ndarray:
        return (key % _U(self.n)).astype(np.int32)

    def documents(self, doc: np.ndarray) -> np.ndarray:
        return (mix(doc.astype(np.int64).view(_U)) % _U(self.n)).astype(np.int32)

    def exchange(self, df: DataFrame) -> DataFrame:
        """Rows of a destination together, texts after everything else."""
        return df.repartitionById(self.n, "to").sortWithinPartitions("kind")

    def verdicts(self, doc: np.ndarray, name: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Symbols start..end of the rows of that name go."""
        yield from packed_rows(VERDICT, self.documents(doc), (doc, raw64), (name.view(np.int64), raw64), (start, raw32), (end, raw32))

    def wanted(self, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from packed_rows(WANTED, self.documents(doc), (doc, raw64), (key, pack48), (place, pack48))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _counts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def _ranks(doc: np.ndarray) -> np.ndarray:
    """The rank of each document; those of one stand together, mostly."""
    at, lengths = _counts(_starts(doc))
    return np.repeat(np.unique(doc[at], return_inverse=True)[1], lengths)


def _by_anchor(key: np.ndarray, rank: np.ndarray, section: np.ndarray) -> np.ndarray:
    """The order that brings entries of an anchor together, by document and section."""
    order = packed_order(rank, section)
    return order[grouped_order(key[order])]


def scan(docs: DataFrame, kind: Kind, deal: Deal) -> DataFrame:
    """ENTRY rows (a anchor, b document, c section, d flags: 1 more than once in the document, 2 hot), to the anchor's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for ids, raws in arrow_texts(batch):
                doc = np.array(ids, np.int64)
                for row, pieces, bounds, starts in slices(raws, kind):
                    found = cut(kind.values(pieces), bounds, kind)
                    place = found.anchor - bounds[found.text] + starts[found.text]
                    held.append((found.key, doc[row[found.text]], place // kind.section))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield from _scanned(*_joined(held), deal)
                    held = []
        if held:
            yield from _scanned(*_joined(held), deal)

    return texts(docs).mapInArrow(run, PACKED)


def _scanned(key, doc, section, deal: Deal) -> Iterator[pa.RecordBatch]:
    rank = _ranks(doc)
    order = _by_anchor(key, rank, section)
    key, rank = key[order], rank[order]
    once, times = _counts(_starts(key, rank))
    order = order[once]
    key, rank, doc, section = key[once], rank[once], doc[order], section[order]
    groups, sizes = _counts(_starts(key))
    hot = np.repeat(sizes > FEW, sizes)
    yield from deal.wanted(doc[hot], key[hot], np.full(int(hot.sum()), HOT, _U))  # known here already
    flags = (times > 1) + 2 * hot
    hot[groups] = False  # one entry tells the others
    send = np.flatnonzero(~hot)
    send = send[packed_order(rank[send])]  # runs of a document compress well
    yield from packed_rows(ENTRY, deal.hashed(key[send]), (key[send], pack48), (doc[send], raw64), (section[send], raw32), (flags[send], raw8))


def meet(scanned: DataFrame, kind: Kind, deal: Deal) -> DataFrame:
    """WANTED rows (a document, b anchor, c meeting place) to the documents' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        told: list[tuple] = []
        for k, a, b, c, d in _columns(batches):
            if k == ENTRY:
                entries.append((unpack48(a), _int64(b), _int32(c), np.frombuffer(d, np.uint8)))
            else:
                told.append((_int64(a), unpack48(b), unpack48(c)))
        if entries:
            told.append(_met(*_joined(entries), kind))
        if told:
            yield from deal.wanted(*_joined(told))

    return deal.exchange(scanned).mapInArrow(run, PACKED)


def _met(key, doc, section, flags, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = _by_anchor(key, _ranks(doc), section)
    key, doc, section, flags = key[order], doc[order], section[order], flags[order]
    groups, sizes = _counts(_starts(key))
    new_doc = _starts(key, doc)
    n_docs = np.add.reduceat(new_doc.astype(np.int64), groups)
    any_flag = np.bitwise_or.reduceat(flags, groups)
    hot = (n_docs > FEW) | (any_flag & 2 > 0)
    wanted = hot | (n_docs > 1)
    if kind.anywhere:
        wanted |= (any_flag & 1 > 0) | (sizes > 1)
    place = mix(mix(doc[groups].view(_U)) + section[groups].astype(_U)) & _MASK48
    place = np.where(hot, _U(HOT), np.maximum(place, _U(1)))
    keep = np.repeat(wanted, sizes) & new_doc
    return doc[keep], key[keep], np.repeat(place, sizes)[keep]


def with_texts(rows_: DataFrame, docs: DataFrame, deal: Deal) -> DataFrame:
    """Packed rows and the texts, each with the partition of its document."""

    def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for ids, raws in arrow_texts(batch):
                doc, sizes = np.array(ids, np.int64), np.fromiter(map(len, raws), np.int64, len(raws))
                body = lambda at, raws=raws: pressed.compress(b"".join([raws[i] for i in at.tolist()]))
                yield from packed_rows(TEXT, deal.documents(doc), (doc, raw64), (sizes, raw64), (np.arange(len(raws)), body))

    return deal.exchange(rows_.unionByName(texts(docs).mapInArrow(addressed, PACKED)))


def _unpacked_text(a: bytes, b: bytes, c: bytes) -> tuple[list[int], list[bytes]]:
    import zstandard

    ids, sizes = _int64(a), _int64(b)
    flat = zstandard.ZstdDecompressor().decompress(c, max_output_size=max(int(sizes.sum()), 1))
    ends = np.cumsum(sizes)
    return ids.tolist(), [flat[x:y] for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


class Lookup:
    """Rows by a 64-bit key, by binary search."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, named): all pairs of equal keys."""
        lo, hi = np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, keys, "right")
        n = hi - lo
        asked = np.repeat(np.arange(len(keys)), n)
        ends = np.cumsum(n)
        return asked, self.order[np.arange(int(n.sum())) + np.repeat(lo - (ends - n), n)]


def _doc_key(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(_U)) ^ key * _U(0xBF58476D1CE4E5B9))


class Asked:
    """The meeting places that documents were told of, by document and anchor."""

    def __init__(self, doc: np.ndarray, key: np.ndarray, place: np.ndarray):
        self.docs = np.unique(doc)
        self.exact = len(self.docs) <= 1 << 16
        names = self._names(doc, key)
        order = np.argsort(names)  # who was told twice was told the same
        self.names, self.places = names[order], place[order]

    def _names(self, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not self.exact:
            return _doc_key(doc, key)
        at, lengths = _counts(_starts(doc))
        return np.repeat(np.searchsorted(self.docs, doc[at]).astype(_U) << _U(48), lengths) | key  # those of a document side by side

    def those(self, doc: np.ndarray) -> np.ndarray:
        """Which of the documents were told anything."""
        at = np.minimum(np.searchsorted(self.docs, doc), len(self.docs) - 1)
        return np.flatnonzero(self.docs[at] == doc)

    def find(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, meeting place) of the pairs that were told of, for documents that were."""
        names = self._names(doc, key)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        found = np.flatnonzero(self.names[at] == names)
        return found, self.places[at[found]]


class _Sent:
    """Passages on their way to their meeting places; equal ones of hot anchors are combined until the next flush."""

    def __init__(self, kind: Kind, deal: Deal):
        self.kind, self.deal = kind, deal
        self.clear()

    def clear(self) -> None:
        self.places: list[np.ndarray] = []
        self.facts: list[np.ndarray] = []  # document, row name, start, times
        self.shapes: list[np.ndarray] = []  # bytes, windows
        self.bodies: list[bytes] = []
        self.hot: dict[tuple[int, bytes], list[list[int]]] = {}
        self.gone: list[tuple[int, int, int, int]] = []

    def add(self, f: Fragments, asked, place, row, doc, name, pieces, bounds, starts) -> None:
        cold = place != HOT
        self._passages(f, asked[cold], place[cold], row, doc, name, pieces, bounds, starts)
        if not cold.all():
            self._hot(f, asked[~cold], row, doc, name, pieces, bounds, starts)

    def _bodies(self, text, first, last, pieces, bounds) -> list[bytes]:
        low, high = first - bounds[text], last - bounds[text] + self.kind.window
        return [self.kind.body(pieces[t], a, b) for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)]

    def _passages(self, f, asked, place, row, doc, name, pieces, bounds, starts) -> None:
        if not len(asked):
            return
        text = f.text[asked]
        new = _starts(place, text)
        new[1:] |= f.first[asked[1:]] != f.last[asked[:-1]] + 1
        at = np.flatnonzero(new)
        first, last = f.first[asked[at]], f.last[asked[np.append(at[1:], len(asked)) - 1]]
        parts = (last - first) // LONGEST + 1  # windows of long passages are dealt to several
        which = np.repeat(np.arange(len(at)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        text, place = text[at][which], place[at][which]
        first, last = first[which] + nth * LONGEST, np.minimum(first[which] + (nth + 1) * LONGEST - 1, last[which])
        bodies = self._bodies(text, first, last, pieces, bounds)
        start = first - bounds[text] + starts[text]
        self.places.append(place)
        self.facts.append(np.column_stack([doc[row[text]], name[row[text]].view(np.int64), start, np.ones(len(text), np.int64)]))
        self.shapes.append(np.column_stack([np.fromiter(map(len, bodies), np.int64, len(bodies)), last - first + 1]))
        self.bodies += bodies

    def _hot(self, f, asked, row, doc, name, pieces, bounds, starts) -> None:
        window, wide = self.kind.window, self.kind.window - self.kind.gram
        for a in range(0, wide + 1, PLACES):
            b = min(a + PLACES - 1, wide)  # the anchor stands a..b symbols right of the window's start
            first, last = np.maximum(f.first[asked], f.anchor[asked] - b), np.minimum(f.last[asked], f.anchor[asked] - a)
            some = np.flatnonzero(first <= last)
            at, first, last = asked[some], first[some], last[some]
            shared = f.sums.spans(f.anchor[at] - a, f.anchor[at] - b + window)
            place = np.maximum(mix(shared ^ f.key[at] + _U(a)) & _MASK48, _U(1))
            text = f.text[at]
            bodies = self._bodies(text, first, last, pieces, bounds)
            facts = zip(doc[row[text]].tolist(), name[row[text]].view(np.int64).tolist(), (first - bounds[text] + starts[text]).tolist(), (last - first + 1).tolist(), strict=True)
            self._combine(zip(place.tolist(), bodies, strict=True), facts)

    def _combine(self, keys: Iterator[tuple[int, bytes]], facts: Iterator[tuple[int, int, int, int]]) -> None:
        """Of equal pieces the smallest document's are sent on (anywhere: the first, as two); the rest go."""
        hot, gone, more, anywhere = self.hot, self.gone, self.kind.window - 1, self.kind.anywhere
        for key, (doc, name, start, windows) in zip(keys, facts, strict=True):
            kept = hot.get(key)
            if kept is None:
                hot[key] = [[doc, name, start, windows, 1]]
            elif anywhere:
                kept[0][4] = 2
                gone.append((doc, name, start, start + windows + more))
            elif doc > kept[0][0]:
                gone.append((doc, name, start, start + windows + more))
            elif doc == kept[0][0]:
                kept.append([doc, name, start, windows, 1])
            else:
                gone += [(d, n, s, s + w + more) for d, n, s, w, _ in kept]
                hot[key] = [[doc, name, start, windows, 1]]

    def size(self) -> int:
        return len(self.bodies) + len(self.hot) + len(self.gone)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.hot:
            flat = [(place, body, x) for (place, body), kept in self.hot.items() for x in kept]
            self.places.append(np.array([x[0] for x in flat], _U))
            self.facts.append(np.array([[x[2][0], x[2][1], x[2][2], x[2][4]] for x in flat], np.int64))
            self.shapes.append(np.array([[len(x[1]), x[2][3]] for x in flat], np.int64))
            self.bodies += [x[1] for x in flat]
        if self.places:
            import zstandard

            pressed = zstandard.ZstdCompressor(level=1)
            bodies = np.empty(len(self.bodies), object)
            bodies[:] = self.bodies
            place = np.concatenate(self.places)
            shapes, join = np.concatenate(self.shapes), lambda x: pressed.compress(b"".join(x.tolist()))
            yield from packed_rows(PASSAGE, self.deal.hashed(place), (place, pack48), (np.concatenate(self.facts), raw64), (bodies, join), (shapes, raw32))
        if self.gone:
            doc, name, start, end = np.array(self.gone, np.int64).T
            yield from self.deal.verdicts(doc, np.ascontiguousarray(name), start, end)
        self.clear()


def fetch(met: DataFrame, docs: DataFrame, kind: Kind, deal: Deal) -> DataFrame:
    """PASSAGE rows (a meeting places, b document, row name, start and times, c symbols, d sizes), and verdicts on combined ones."""

    def wanted_texts(batches: Iterator[pa.RecordBatch], told: list[tuple]) -> Iterator[tuple[list[int], list[bytes]]]:
        """First fills ``told``, then gives the texts, some rows together; none if nothing is wanted."""
        ids, raws, size, any_ = [], [], 0, False
        for k, a, b, c, _ in _columns(batches):
            if k == WANTED:
                told.append((_int64(a), unpack48(b), unpack48(c)))
                any_ = True
            elif any_:
                some, bodies = _unpacked_text(a, b, c)
                ids, raws, size = ids + some, raws + bodies, size + sum(map(len, bodies))
                if size >= SLICE:
                    yield ids, raws
                    ids, raws, size = [], [], 0
        if ids:
            yield ids, raws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        places: Asked | None = None
        sent = _Sent(kind, deal)
        for ids, raws in wanted_texts(batches, told):
            if places is None:  # texts come after all that is wanted of them
                places = Asked(*_joined(told))
                told.clear()
            mine = places.those(np.array(ids, np.int64)).tolist()
            ids, raws = [ids[i] for i in mine], [raws[i] for i in mine]
            doc, name = np.array(ids, np.int64), row_names(ids, raws)
            for row, pieces, bounds, starts in slices(raws, kind):
                f = cut(kind.values(pieces), bounds, kind)
                asked, place = places.find(doc[row[f.text]], f.key)
                sent.add(f, asked, place, row, doc, name, pieces, bounds, starts)
            if sent.size() >= HELD // 4:
                yield from sent.flush()
        yield from sent.flush()

    return with_texts(met, docs, deal).mapInArrow(run, PACKED)


@dataclass
class Passages:
    """The passages of the meeting places of one task."""

    place: np.ndarray
    doc: np.ndarray
    times: np.ndarray  # how often a piece of a hot anchor stood in its task, at most 2
    windows: np.ndarray  # how many window starts
    bodies: list[bytes]


Decide = Callable[[Passages], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def decided(fetched: DataFrame, decide: Decide, kind: Kind, deal: Deal) -> DataFrame:
    """``decide`` gives (passage, first, last window) to remove; they come out as verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: list[tuple] = []
        verdicts: list[tuple] = []
        for k, a, b, c, d in _columns(batches):
            if k == VERDICT:
                verdicts.append((_int64(a), _int64(b), _int32(c), _int32(d)))
            else:
                held.append((a, b, c, d))
        if held:
            facts = np.concatenate([_int64(b).reshape(-1, 4) for _, b, _, _ in held])
            shapes = np.concatenate([_int32(d).reshape(-1, 2) for _, _, _, d in held])
            flat = b"".join(zstandard.ZstdDecompressor().decompress(c, max_output_size=max(int(_int32(d)[::2].sum()), 1)) for _, _, c, d in held)
            ends = np.cumsum(shapes[:, 0])
            bodies = [flat[x:y] for x, y in zip((ends - shapes[:, 0]).tolist(), ends.tolist(), strict=True)]
            some = Passages(np.concatenate([unpack48(a) for a, _, _, _ in held]), facts[:, 0], facts[:, 3], shapes[:, 1], bodies)
            held, flat = [], b""
            for at, first, last in decide(some):
                verdicts.append((facts[at, 0], facts[at, 1], facts[at, 2] + first, facts[at, 2] + last + kind.window))
        if verdicts:
            yield from deal.verdicts(*_joined(verdicts))

    return deal.exchange(fetched).mapInArrow(run, PACKED)


def covered(verdicts: DataFrame, docs: DataFrame, kind: Kind, deal: Deal, finish: Callable, columns: str, schema: pa.Schema) -> DataFrame:
    """``finish(raw, gone)`` per document gives its row after doc_id; gone: booleans per symbol covered by a removed window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        lookup = None
        for k, a, b, c, d in _columns(batches):
            if k == VERDICT:
                held.append((_int64(b).view(_U), _int32(c), _int32(d)))
                continue
            if lookup is None:
                name, start, end = _joined(held) if held else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
                lookup, held = Lookup(name), []
            ids, raws = _unpacked_text(a, b, c)
            asked, named = lookup.pairs(row_names(ids, raws))
            edges = np.searchsorted(asked, np.arange(len(ids) + 1)).tolist()
            rows_ = []
            for i, raw in enumerate(raws):
                gone = np.zeros(len(raw.split()) if kind.words else len(raw), bool)
                if edges[i] < edges[i + 1]:
                    mine = named[edges[i] : edges[i + 1]]
                    steps = np.zeros(len(gone) + 1, np.int64)
                    np.add.at(steps, start[mine], 1)
                    np.add.at(steps, end[mine], -1)
                    gone = np.cumsum(steps[:-1]) > 0
                rows_.append((ids[i], *finish(raw, gone)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows_, strict=True), schema, strict=True)], schema=schema)

    out = with_texts(verdicts, docs, deal).mapInArrow(run, columns)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def remove_repeats(docs: DataFrame, kind: Kind, decide: Decide, finish: Callable, columns: str, schema: pa.Schema) -> DataFrame:
    """All steps: two shuffles of the texts, one of who has which anchor, one of the passages that can repeat, and small ones."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), "text")
    deal = Deal(partitions_for(own))
    met = meet(scan(own, kind, deal), kind, deal)
    return covered(decided(fetch(met, own, kind, deal), decide, kind, deal), own, kind, deal, finish, columns, schema)
