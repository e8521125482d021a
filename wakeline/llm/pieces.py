"""SentencePiece BPE encoding and decoding, by vectorised merge rounds.

The library repeats: merge the pair of neighbours of best score, the leftmost of equal ones, until no pair is a piece. Here all words
of a slice of text lie in flat numpy arrays. In a round each word finds its minimum pair rank (a segmented minimum), the leftmost
pairs of that rank merge in all words at once, and the arrays are compacted; words without a pair leave.

A word is what no piece can reach across: blanks and the text up to the next blank. Different words of a slice are encoded once, as
words can't affect each other, and a bounded table remembers them.

That a round merges several pairs of one word changes no result: a merge and all that follows from it stays within ``longest``
characters of its pair. So long words are cut into cells of three times that; a pair may merge if no pair of its cell and the two
beside it has a better rank. Of equal ranks there the first merges, and each next one only if the one before gives no new pair of a
rank as good (else it waits a round). Runs of blanks have pieces of equal rank, which fill from the left: whole ones are cut off first.

Edge cases: a null or empty text has no ids; null doc_ids, repeated rows and further columns are fine; an empty table gives no rows;
unknown characters are byte pieces; texts are encoded in parts of about ``PART`` characters, cut between words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows, text_batches, texts

PART, REMEMBERED = 1_000_000, 400_000
SPACE = "▁"  # stands for a blank
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file


class _Numbers(dict):
    """Words numbered as they come; ``new`` holds those not looked at yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Vocabulary:
    """What a model file says: ids of pieces, and for each pair of symbols the rank and id of the piece it makes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError(f"{path}: not a BPE model without normalisation")
        kinds = np.array([p.type for p in model.pieces])
        if set(kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: pieces of a kind that is not supported")
        self.kinds, self.unknown = kinds, model.trainer_spec.unk_surface
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if len(byte_ids) != 256:
            raise ValueError(f"{path}: no byte pieces")
        self.byte_id = np.array([byte_ids[b] for b in range(256)], np.int32)
        order = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        rank = {p: order[model.pieces[i].score] for p, i in normal.items()}
        self.longest = max(map(len, normal), default=1)
        # characters that are no piece themselves may still be part of one; they get ids above the pieces'
        extra = sorted({c for p in normal for c in p} - set(normal))
        self.symbol = normal | {c: len(kinds) + k for k, c in enumerate(extra)}
        self.n_pieces, self.n_symbols = len(kinds), len(kinds) + len(extra) + 1  # the last: a character in no piece
        self.of_char = np.full(0x110000, self.n_symbols - 1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        pairs = sorted((self.symbol[p[:k]] * self.n_symbols + self.symbol[p[k:]], rank[p], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self.pair_keys = np.array([k for k, _, _ in pairs] + [2**62], np.int64)
        self.pair_rank, self.pair_piece = np.array([r for _, r, _ in pairs] + [NONE], np.int32), np.array([i for _, _, i in pairs] + [0], np.int32)
        # what each id writes
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else self.unknown.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.written = np.frombuffer(b"".join(raw), np.uint8)
        self.n_written = np.array([len(r) for r in raw], np.int64)
        self.at_written = np.cumsum(self.n_written) - self.n_written
        self.starts_blank = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.decimal = [str(i) for i in range(self.n_pieces)]
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal) else None
        # blanks of equal and worst rank; no piece has two of them and another character
        blanks = [p for p in normal if len(p) > 1 and not p.strip(SPACE)]
        mixed = any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal)
        worst = max((r for p, r in rank.items() if len(p) > 1), default=0)
        alike = blanks and all((rank[p] == worst) == (p in blanks) for p in rank if len(p) > 1)
        self.block = 0
        self._forget()
        if alike and not mixed and self.word:  # a whole block comes first, whatever the length of the run
            most = max(map(len, blanks))
            ids = [self.merged([SPACE * n])[0].tolist() for n in range(4 * most + 1)]
            if all(ids[n] == [normal[SPACE * most], *ids[n - most]] for n in range(most, 4 * most + 1)):
                self.block = most

    def _forget(self) -> None:
        self._known = _Numbers()
        self._pool, self._at, self._length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._n = self._n_words = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that the pairs make."""
        keys = left.astype(np.int64) * self.n_symbols + right
        at = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_rank[at], NONE), self.pair_piece[at]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = np.cumsum(np.concatenate([[0], (np.diff(word) != 0) | (place[1:] % (3 * self.longest) == 0)]), dtype=np.int32)
        word_of = word[np.flatnonzero(np.diff(cell, prepend=-1))]
        at, symbol = np.arange(len(chars), dtype=np.int32), self.of_char[chars]
        rank, piece = np.full(len(chars), NONE, np.int32), np.zeros(len(chars), np.int32)
        rank[:-1], piece[:-1] = self._ranks(symbol[:-1], symbol[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            least, of = np.minimum.reduceat(rank, first), word_of[cell[first]]
            same = of[1:] == of[:-1]
            around = least.copy()  # with the cells beside it in the same word
            around[1:][same] = np.minimum(around[1:], least[:-1])[same]
            around[:-1][same] = np.minimum(around[:-1], least[1:])[same]
            if same.any():
                # pairs of a rank wait for those before them of the same rank, so also for a whole cell before that waits
                n = np.arange(len(first))
                go_on = np.concatenate([[False], same & (least[:-1] == around[1:])])
                waits = go_on & np.concatenate([[False], around[:-1] < least[:-1]])
                around[np.maximum.accumulate(np.where(waits, n, -1)) >= np.maximum.accumulate(np.where(go_on, 0, n))] = NONE
            width = np.diff(first, append=len(symbol))
            pairs = np.flatnonzero(rank != NONE)
            hits = pairs[rank[pairs] == np.repeat(around, width)[pairs]]
            hits = self._leftmost(hits, cell, word_of, symbol, rank, piece)
            symbol[hits] = piece[hits]
            # compaction: what has become part of the symbol before it goes, and words without a pair leave
            closed = np.ones(len(words), bool)
            closed[of[least != NONE]] = False
            over = closed[of]
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            if over.any():
                leave = np.repeat(over, width)
                done.append((at[leave], symbol[leave]))
                keep &= ~leave
            moved = (np.cumsum(keep, dtype=np.int32) - 1)[hits]
            stay = np.flatnonzero(keep)
            cell, at, symbol, rank, piece = (x[stay] for x in (cell, at, symbol, rank, piece))
            near = np.zeros(len(symbol), bool)
            near[moved] = near[np.maximum(moved - 1, 0)] = True
            again = np.flatnonzero(near)
            rank[again] = NONE
            inner = again[again < len(symbol) - 1]
            inner = inner[word_of[cell[inner]] == word_of[cell[inner + 1]]]
            rank[inner], piece[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        at, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at)
        at, symbol = at[order], symbol[order].astype(np.int64)
        word = word[at]
        alone = symbol >= self.n_pieces  # characters that are no piece: their bytes are
        if alone.any():
            raw = [chr(c).encode("utf-8", "replace") for c in chars[at[alone]].tolist()]
            n = np.ones(len(symbol), np.int64)
            n[alone] = [len(r) for r in raw]
            word, symbol, alone = np.repeat(word, n), np.repeat(symbol, n), np.repeat(alone, n)
            symbol[alone] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words))

    def _leftmost(self, hits: np.ndarray, cell: np.ndarray, word_of: np.ndarray, symbol: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of pairs that overlap the leftmost; of near ones of one rank those before the first that makes a new pair as good, and that one."""
        step = (np.diff(hits) == 1) & (rank[hits[1:]] == rank[hits[:-1]])
        if step.any():
            n = np.arange(len(hits))
            begun = np.maximum.accumulate(np.where(np.concatenate([[True], ~step]), n, 0))
            hits = hits[(n - begun) % 2 == 0]
        of, where = word_of[cell[hits]], cell[hits]
        linked = np.concatenate([[False], (of[1:] == of[:-1]) & (where[1:] - where[:-1] <= 1)])
        if not linked.any():
            return hits
        some = np.flatnonzero(linked | np.append(linked[1:], False))
        p = hits[some]
        new, last = piece[p], len(symbol) - 1
        left, right = np.maximum(p - 1, 0), np.minimum(p + 2, last)
        has_left = (p > 0) & (word_of[cell[left]] == of[some])
        has_right = (p + 2 <= last) & (word_of[cell[right]] == of[some])
        joined = np.concatenate([[False], p[1:] - p[:-1] == 2])  # its left neighbour has just become a piece
        before = np.where(joined, np.concatenate([[0], new[:-1]]), symbol[left])
        wild = (has_left & (self._ranks(before, new)[0] <= rank[p])) | (has_right & (self._ranks(new, symbol[right])[0] <= rank[p]))
        if not wild.any():
            return hits
        count = np.zeros(len(hits), np.int64)
        count[some] = wild
        total = np.cumsum(count) - count
        head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(hits))))
        return hits[total == total[head]]

    def _words(self, part: str) -> list[str]:
        """The words of a part that begins at a blank or at the start of its text; each without its first blank."""
        if self.word is None:
            return [SPACE.join(part.split(" "))]
        if part[:1] != " " and "  " not in part and SPACE not in part:
            return part.split(" ")
        return [w[1:] for w in self._with_runs(SPACE + part.replace(" ", SPACE))]

    def _with_runs(self, part: str) -> list[str]:
        found = self.word.findall(part)
        if self.block and SPACE * (self.block + 1) in part:
            cut = []
            for w in found:
                run = len(w) - len(w.lstrip(SPACE))
                n = max(run - 1, 0) // self.block  # a blank before the text may join it
                cut += [SPACE * self.block] * n
                cut.append(w[n * self.block :])
            return cut
        return found

    def encode(self, some: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken together up to about ``PART`` characters; longer ones are cut between words."""
        found: list[list[np.ndarray]] = [[] for _ in some]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(some):
            at = 0
            while at < len(text):
                end = self._end(text, at)
                held.append((k, self._words(text[at + (at > 0) : end])))
                size += end - at
                at = end
                if size >= PART:
                    self._flush(held, found)
                    held, size = [], 0
        self._flush(held, found)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in found]

    def _end(self, text: str, at: int) -> int:
        """Where a part that begins at ``at`` ends: before a blank that follows something else."""
        end = at + PART
        while self.word is not None and 0 <= end < len(text):
            if text[end] == " " and text[end - 1] not in f" {SPACE}":
                return end
            end = text.find(" ", end + 1)
        return len(text)

    def _flush(self, held: list[tuple[int, list[str]]], found: list[list[np.ndarray]]) -> None:
        if self._n_words > REMEMBERED or self._n > 8 * REMEMBERED:
            self._forget()
        words = [w for _, own in held for w in own]
        numbers = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        new, self._known.new = self._known.new, []
        if new:
            ids, n = self.merged([SPACE + w for w in new])
            self._pool, self._at, self._length = (_grown(a, k, x) for a, k, x in ((self._pool, self._n, ids), (self._at, self._n_words, self._n + np.cumsum(n) - n), (self._length, self._n_words, n)))
            self._n, self._n_words = self._n + len(ids), self._n_words + len(new)
        n = self._length[numbers]
        ids = self._pool[np.repeat(self._at[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = 0
        for k, own in held:
            found[k].append(ids[ends[at] : ends[at + len(own)]])
            at += len(own)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: the blank that encoding puts before a text goes, and bytes that are no UTF-8 are U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        n = self.n_written[ids]
        raw = self.written[np.repeat(self.at_written[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        blank = len(shown) and self.starts_blank[ids[shown[0]]]
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = _repaired(raw)
        return text[1:] if blank else text


def _grown(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The buffer with ``more`` after its first n items, made longer if need be."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.zeros(max(len(more), len(held)), held.dtype)])
    held[n : n + len(more)] = more
    return held


def _repaired(raw: bytes) -> str:
    """UTF-8 with each byte that begins no whole character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode("utf-8"))
            out.append("�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.large_string()}
_KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def coded(docs: DataFrame, model_path: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the asked columns of each document: n_tokens, ids, decoded (the text the ids stand for), ids_sha256 (of the decimal ids with commas
    between) and decoded_sha256. ``model_path``: a model file readable on every executor, by default the packaged one of 32k pieces."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, _FIELDS[c]) for c in columns)])
    decodes = bool({"decoded", "decoded_sha256"} & set(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        v = vocabulary(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for doc_ids, raws in text_batches(batches):
            out: dict[str, list] = {c: [] for c in columns}
            for ids in v.encode([raw.decode("utf-8", "replace") for raw in raws]):
                text = v.decode(ids) if decodes else ""
                for c, held in out.items():
                    if c == "n_tokens":
                        held.append(len(ids))
                    elif c == "ids":
                        held.append(ids)
                    elif c == "decoded":
                        held.append(text)
                    elif c == "ids_sha256":
                        held.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    else:
                        held.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield rows(schema, doc_ids, *out.values())

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {_KINDS[c]}" for c in columns)]))


def decoded(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids are no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        v = vocabulary(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            yield rows(schema, batch.column("doc_id").to_pylist(), [v.decode(np.array(x or [], np.int64)) for x in lists])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
