"""URL filter: a bit-parallel automaton for glob rules.

All rules are packed into one multiword Shift-And machine. A rule's characters take consecutive bits; ``?`` is a bit that
any byte sets, ``*`` lets the bit before it stay set, a leading ``*`` lets the rule's first bit start anywhere. Each byte
of the canonical URL moves all rules at once: ``D = ((D << 1 | start) & accept[byte]) | (D & stay)``. The work for a URL
is its length times the number of 64-bit words, however many rules there are.

The canonical URL is ``.host`` SEP ``path``, so one glob can bind a host with its subdomains and a path prefix.

Edge cases: a null URL, or one without ``://``, has empty host and path; repeated rows each get their verdict; very long
URLs are stepped in batches of bounded size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

SEP = "\x1e"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A glob over the canonical URL. Of the matching rules of the highest ``rank``, the longest ``name`` decides."""

    name: str
    glob: str
    verdict: str
    rank: int = 0


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: that host and all its subdomains, paths that start with ``/path``."""
    host, _, path = name.partition("/")
    return Rule(name, f"*.{host}{SEP}/{path}*", verdict, rank=1)


#: The operator's own rules, tried where no site rule fits.
DEFAULT_RULES = (
    Rule("host *casino*", f"*casino*{SEP}*", "block"),
    Rule("path */wp-login*", f"*{SEP}*/wp-login*", "block"),
    Rule("path */cart/*", f"*{SEP}*/cart/*", "block"),
    Rule("path *.exe", f"*{SEP}*.exe", "block"),
    Rule("path *.zip", f"*{SEP}*.zip", "block"),
    Rule("path */calendar/????-??*", f"*{SEP}*/calendar/????-??*", "block"),
)


class GlobAutomaton:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        chars, first, floating, stay, last = [], [], [], [], []
        for rule in rules:
            parts = rule.glob.encode()
            body = [b for b in parts if b != 42]
            if not body:
                raise ValueError(f"rule {rule.name!r} has no character besides *")
            first.append(len(chars))
            floating.append(parts[:1] == b"*")
            for b in parts:
                if b == 42:
                    if len(chars) > first[-1]:
                        stay.append(len(chars) - 1)
                else:
                    chars.append(b)
            last.append(len(chars) - 1)
        self.words = -(-len(chars) // 64)
        self.accept = np.zeros((256, self.words), np.uint64)
        for i, b in enumerate(chars):
            for byte in range(256) if b == 63 else (b,):
                self.accept[byte, i // 64] |= np.uint64(1 << i % 64)
        self.first, self.stay = self._mask(first), self._mask(stay)
        self.floating = self._mask([f for f, free in zip(first, floating, strict=True) if free])
        self.last = last

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << i % 64)
        return out

    def _step(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(lengths.max(initial=0))
        flat = np.zeros((len(texts), width), np.uint8)
        flat[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
        state = np.zeros((len(texts), self.words), np.uint64)
        for t in range(width):
            shifted = state << np.uint64(1)
            shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
            shifted &= ~self.first
            shifted |= self.first if t == 0 else self.floating
            new = (shifted & self.accept[flat[:, t]]) | (state & self.stay)
            state = np.where((t < lengths)[:, None], new, state)
        return state

    def matches(self, texts: list[bytes], most_cells: int = 1 << 21) -> np.ndarray:
        """(texts, rules) booleans. Texts are stepped by length, in blocks of at most ``most_cells`` bytes or one text."""
        out = np.zeros((len(texts), len(self.rules)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= most_cells:
                end += 1
            block = order[at:end]
            state = self._step([texts[i] for i in block])
            for r, bit in enumerate(self.last):
                out[block, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            at = end
        return out


def canonical(pages: DataFrame) -> DataFrame:
    """page_id, host, path by built-in string functions."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.expr("case when instr(u, '://') > 0 then substring(u, instr(u, '://') + 3) else '' end")
    found = pages.select("page_id", url.alias("u")).select("page_id", rest.alias("rest"))
    return found.select("page_id", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), _A, _Z).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def judge(pages: DataFrame, site_rules: tuple[Rule, ...], rules: tuple[Rule, ...] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of the site rules, else null), own_rule (of the operator's own, else null), verdict."""
    everything = (*site_rules, *rules)
    automaton = GlobAutomaton(everything)
    order = sorted(range(len(everything)), key=lambda i: (-everything[i].rank, -len(everything[i].name), everything[i].name))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("own_rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            if not hosts:
                continue
            flat = [f".{h.replace(SEP, ' ')}{SEP}{p.replace(SEP, ' ')}".encode() for h, p in zip(hosts, paths, strict=True)]
            hit = automaton.matches(flat)[:, order]
            best = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
            chosen = [everything[order[i]] if i >= 0 else None for i in best]
            yield rows(
                schema, batch.column("page_id").to_pylist(), hosts, paths,
                [c.name if c and c.rank else None for c in chosen], [c.name if c and not c.rank else None for c in chosen], [c.verdict if c else default for c in chosen],
            )

    found = canonical(pages).withColumn("page_id", F.col("page_id").cast("long"))
    return found.mapInArrow(run, "page_id long, host string, path string, rule string, own_rule string, verdict string")
