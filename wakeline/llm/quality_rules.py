"""Quality rules as a bitmask ledger.

``measure`` reads every whole text once and stores its measurements; ``ledger`` evaluates each rule once on them and
packs the failures into one long. A policy is a named, versioned mask over that ledger, so applying another policy, or
asking what a rule alone costs (``ablations``), never touches a text again.

Edge cases: a null text counts as empty (no words: it fails ``few_words``); ratios are written as products, so empty
texts never divide; repeated rows each get their row; an empty table gives an empty ledger; columns of the input other
than doc_id and text are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows, text_batches, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_chars")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
_SYMBOLS, _UPPER, _LOWER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 5

#: Rule -> SQL condition of failing; the position is the rule's bit and never changes, new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "odd_word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "n_upper > n_lower",
    "exclaiming": "10 * n_bangs > 3 * n_words",
}
BIT = {rule: 1 << i for i, rule in enumerate(RULES)}

#: Policy -> the rules that reject; versions stay, so that older decisions can be repeated from a stored ledger.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols"),
    "v2": tuple(RULES),
}


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a ``window``-word run that occurs twice or more in the same text; exact, by ranking pairs of ranks."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
    _, at, counts = np.unique(four[:n] * (ids.max() + 1) + ids[window - 1 :], return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, np.int64)
    start = np.flatnonzero(counts[at] > 1)
    edges[start] += 1
    edges[start + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure_text(raw: bytes) -> tuple[int, ...]:
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]  # strip() without arguments takes the same six blanks
    chars = len(raw.decode("utf-8", "replace"))
    blanks = len(raw) - sum(map(len, words))
    counted = lambda kind: len(raw) - len(raw.translate(None, kind))
    return (
        len(words), chars - blanks, counted(_SYMBOLS), len(lines) - len(set(lines)), repeated_window_words(ids),
        len(lines), counted(_UPPER), counted(_LOWER), raw.count(b"!"), chars,
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every text: one pass in Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in text_batches(batches):
            yield rows(_SCHEMA, ids, *zip(*map(measure_text, raws), strict=True))

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``: bit i is set if rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(BIT[rule])).otherwise(F.lit(0)).cast("long") for rule, condition in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed)


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def passes(policy: str, failed: str | Column = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and that pass without it. One aggregation over the ledger."""
    whole = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    sums = [F.count("*").alias("n"), F.coalesce(F.sum((hit == 0).cast("long")), F.lit(0)).alias("kept")]
    for rule in POLICIES[policy]:
        sums += [F.coalesce(F.sum((hit.bitwiseAND(F.lit(BIT[rule]).cast("long")) != 0).cast("long")), F.lit(0)).alias(f"{rule}__any"), F.coalesce(F.sum((hit == BIT[rule]).cast("long")), F.lit(0)).alias(f"{rule}__only")]
    one = book.agg(*sums)
    parts = ", ".join(f"'{r}', `{r}__any`, `{r}__only`, kept + `{r}__only`" for r in POLICIES[policy])
    return one.selectExpr(f"stack({len(POLICIES[policy])}, {parts}) as (rule, n_failed, n_failed_alone, n_kept_without)")
