"""Removal of repeated multi-line chunks, cut where the content says so. DataFrame functions only.

A text's lines are hashed; a rolling hash, a polynomial modulo a prime over the hashes of ``WINDOW`` lines, ends a chunk
where it is divisible by ``DIVISOR`` and was not the line before. Boundaries depend on four lines alone, so lines put in or
taken out shift only the chunks around them. No boundary stands after the first line or before the last, so every chunk of
a longer text has two lines or more, and a copy of a text goes as a whole.
Chunks of two or more lines (one of them with a word) that occur before, in a document with a smaller doc_id or earlier
in the same one, are removed, once their bytes have been compared with those of the first occurrence.

Only hashes are counted, with partial sums; texts are shuffled once by chunk hash for the comparison and once by doc_id for
the result. What repeats is written down before it is joined, so that both sides of these joins are plain shuffles and
Spark's skew join splits a chunk that is in a third of all documents.

Edge cases: a null text counts as empty; an empty text is one empty line, never removed; rows of equal doc_id are the same document
and judged alike; a null doc_id counts as the smallest; an empty table gives an empty result; columns besides text and n_chars
pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# The rolling hash is sum(BASE**k * hash of the line k before) modulo MODULUS; all terms stay below 2**62.
WINDOW, BASE, MODULUS, DIVISOR = 3, 69_069, 2**31 - 1, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The input and ``_chunks``: array of struct(body, lines) covering the whole text."""
    lines, hashes = F.col("_lines"), F.col("_hashes")
    at = lambda i: F.when(i >= 0, F.element_at(hashes, i + 1)).otherwise(F.lit(0))
    rolling = lambda i: sum((at(i - k) * pow(BASE, k, MODULUS) for k in range(1, WINDOW)), at(i)) % MODULUS
    marks = lambda i: rolling(i) % DIVISOR == 0
    ends_here = lambda i: (i == F.size(lines) - 1) | ((i > 0) & (i < F.size(lines) - 2) & marks(i) & ~marks(i - 1))
    ends = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), ends_here)
    start = lambda k: F.when(k > 0, F.element_at(F.col("_ends"), k) + 1).otherwise(F.lit(0))
    piece = lambda end, k: F.struct(F.array_join(F.slice(lines, start(k) + 1, end - start(k) + 1), "\n").alias("body"), (end - start(k) + 1).alias("lines"))
    staged = docs.withColumn("_lines", _lines(F.col("text"))).withColumn("_hashes", F.transform("_lines", _line_hash)).withColumn("_ends", ends)
    return staged.withColumn("_chunks", F.transform("_ends", piece)).drop("_lines", "_hashes", "_ends")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(_doc, _gone, _n): the positions, ascending, of the chunks to remove, and how many chunks there are, by document."""
    # outer: a plain posexplode adds a filter on the array, which would be pushed down and compute the chunks a second time
    pieces = chunked(docs.select(_key(), "text")).withColumn("_n", F.size("_chunks")).select("_doc", "_n", F.posexplode_outer("_chunks").alias("k", "chunk"))
    pieces = pieces.filter((F.col("chunk.lines") > 1) & F.col("chunk.body").rlike(r"[^\x20\x09-\x0D]")).select("_doc", "_n", "k", F.col("chunk.body").alias("body"))
    pieces = pieces.withColumn("h", F.xxhash64("body"))
    first = pieces.groupBy("h").agg(F.min(F.struct("_doc", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    again = checkpointed(pieces.join(checkpointed(first), "h"))  # read twice below, and only repeated chunks are left
    is_first = (F.col("_doc") == F.col("first._doc")) & (F.col("k") == F.col("first.k"))
    kept = checkpointed(again.filter(is_first).groupBy("h").agg(F.min("body").alias("kept")))
    later = again.filter(~is_first).join(kept, "h").filter(F.col("body") == F.col("kept"))
    return later.groupBy("_doc").agg(F.sort_array(F.collect_set("k")).alias("_gone"), F.max("_n").alias("_n"))  # at most a document's own chunks


def _flags() -> Column:
    """For the chunks up to the last that goes, whether each does: a look at any is one step, however many chunks there are."""
    before = lambda i: F.when(i > 0, F.get("_gone", i - 1)).otherwise(F.lit(-1))
    return F.flatten(F.transform("_gone", lambda k, i: F.concat(F.array_repeat(F.lit(False), k - before(i) - 1), F.array(F.lit(True)))))


def _goes(k: Column) -> Column:
    return F.coalesce(F.get("_flags", k), F.lit(False))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_doc")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``_row`` (the whole input row), ``_chunks``, ``_gone`` and ``_flags`` (never null) and ``_n`` (null if nothing goes)."""
    own = docs.select(_key(), "doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    gone = repeated_chunks(own).withColumn("_flags", _flags())  # before the join, so that it is computed once a document
    joined = own.join(gone.hint("shuffle_hash"), "_doc", "left")
    none = {"_gone": F.coalesce("_gone", F.array().cast("array<int>")), "_flags": F.coalesce("_flags", F.array().cast("array<boolean>"))}
    return chunked(joined.withColumns(none)).drop("_doc")


def _kept_text() -> Column:
    return F.array_join(F.transform(F.filter("_chunks", lambda c, k: ~_goes(k)), lambda c: c["body"]), "\n")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_chunks_removed, n_lines_removed, kept_sha256."""
    lines_in = lambda chunks: F.aggregate(chunks, F.lit(0), lambda s, c: s + c["lines"])
    found = marked(docs.select("doc_id", "text"))
    gone = F.filter("_chunks", lambda c, k: _goes(k))
    return found.select(
        "doc_id", lines_in(F.col("_chunks")).cast("long").alias("n_lines"), F.size("_chunks").cast("long").alias("n_chunks"), F.size("_gone").cast("long").alias("n_chunks_removed"),
        lines_in(gone).cast("long").alias("n_lines_removed"), F.sha2(F.encode(_kept_text(), "UTF-8"), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without repeated chunks; one that loses all its chunks goes. n_chars, if there, follows the text."""
    left = marked(docs).filter(F.col("_n").isNull() | (F.size("_gone") < F.col("_n")))
    changed = F.size("_gone") > 0
    text = left.select("_row", changed.alias("_changed"), F.when(changed, _kept_text()).otherwise(F.col("text").cast("string")).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_changed"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return text.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
