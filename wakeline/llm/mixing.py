"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: all tokens are shared among the sources by weight; no source gets more than ``max_epochs`` times its size, and
what it can't take is shared again (the closed form of that: one level for all sources below their cap).
A target of ``e`` whole sizes and a rest takes every document ``e`` times; the rest goes to documents in the order of
``-ln(u) / w``, u a uniform hash of doc_id and the seed, w the document's quality weight, until their sizes' running sum
reaches it; the last one gives only the tokens still missing.

The running sum is two-level: a source's keys fall into ranges of some two thousand documents, whose totals are summed
first, so a source that holds a third of all rows is no larger a task than any other. Ranges are cut by the share of keys
below a key, which the counts of the source's weight classes give, so low weights don't crowd the last range.
``plan`` shuffles no texts; ``mix`` shuffles each row once, by its range.

Edge cases: a null text has no words, is never needed and takes 0; a null source is a source (the last); equal keys are
ordered by doc_id, then by a hash of the text; repeated rows count as documents of their own; a null doc_id is an id; an
empty table gives an empty result; columns with clashing names pass unchanged.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

ROWS_PER_RANGE, MAX_EPOCHS, SEED = 2048, 3, 17
WEIGHT_CLASSES, MOST_BROADCAST = 60, 20_000
_SYMBOLS = "#*$%&|<>!"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """1 for clean prose, less the more symbols stand among its words."""
    symbols = F.length(F.col(text)) - F.length(F.translate(F.col(text), _SYMBOLS, ""))
    return F.coalesce(F.try_divide(F.col(size), F.col(size) + 20 * symbols), F.lit(1.0))


def uniform(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """In (0, 1), from 32 bits of an MD5 that any engine has."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_docs, target from one row per source; sources are ranked by code point, null last."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(c)) for c in cycle)), (F.col("place") % len(cycle) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    levels = weighted.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("total"),
        (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("capped"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("free_weight"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("free_weight"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place_by_cap", "level"))).over(everything)["level"]
    found = levels.withColumn("place_by_cap", F.row_number().over(by_cap)).withColumn("at", level)
    return found.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """Rows with what the plan needs: doc_id, source, size, weight, key and, for ties, a hash of the text."""
    text = F.col("text").cast("string")
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"),
        text.alias("text"), F.xxhash64(text).alias("tie"), *more,
    )
    return own.withColumn("weight", quality_weight()).drop("text").withColumn("key", -F.log(uniform(seed=seed)) / F.col("weight"))


def _weight_class(weight: Column) -> Column:
    """Weights within a factor of the square root of two of each other; the smallest share the last class."""
    return F.least(F.greatest(F.floor(-2 * F.log2(weight)), F.lit(0)), F.lit(WEIGHT_CLASSES - 1)).cast("int")


def _goals(small: DataFrame, cycle: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: place (a number), target, epochs, rest, how many ranges, and the shares of its weight classes."""
    classes = small.groupBy("source", _weight_class(F.col("weight")).alias("class")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = classes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"), F.sort_array(F.collect_list(F.struct("class", "n"))).alias("classes"),
    )  # fmt: skip  # at most WEIGHT_CLASSES in a list
    goal = targets(sizes.select("source", "source_size", "n_docs"), cycle, max_epochs)
    goal = goal.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    lists = sizes.select(F.col("source").alias("_s"), "classes")
    goal = goal.join(lists, goal["source"].eqNullSafe(lists["_s"])).drop("_s")
    return goal.withColumn("ranges", F.ceil(F.col("n_docs") / ROWS_PER_RANGE))


def _ranged(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``span``: the range of the key, of about ROWS_PER_RANGE rows. It grows with the key, by the share of keys below it that the weight classes make likely."""
    tied = rows.withColumnRenamed("source", "_source").join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    typical = lambda c: F.pow(F.lit(2.0), -(c["class"] + 0.5) / 2)
    below = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["n"] * (1 - F.exp(-typical(c) * F.col("key"))))
    return tied.withColumn("span", F.least(F.floor(below / F.col("n_docs") * F.col("ranges")), F.col("ranges") - 1)).drop("classes")


def _taken(rows: DataFrame, small: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows with source_size, target, epochs, part (words of the fractional selection) and taken."""
    if goal.count() <= MOST_BROADCAST:
        goal = F.broadcast(goal)  # its size has been looked at; beyond it Spark joins by shuffles, which it can split
    totals = _ranged(small, goal).groupBy("place", "span").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("place").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.select("place", "span", (F.sum("held").over(earlier) - F.col("held")).alias("before"))
    upto = Window.partitionBy("place", "span").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = _ranged(rows, goal).withColumn("inside", F.sum("size").over(upto) - F.col("size"))
    summed = inside.join(before, ["place", "span"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside"))).cast("long")
    return summed.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def plan(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, key, part, taken of every row. Texts are read once."""
    small = checkpointed(_keyed(docs, seed))
    taken = _taken(small, small, checkpointed(_goals(small, cycle, max_epochs)))
    return taken.select("doc_id", "source", "size", "source_size", "target", "epochs", "key", "part", "taken")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents: the input's columns, a row per epoch, and the fractional take's row, which may be cut short.

    Each row is planned for itself, so repeated rows and rows of one doc_id take what the plan gives each of them. n_chars, if
    there, follows a text that was cut; other columns pass unchanged.
    """
    small = checkpointed(_keyed(docs, seed))
    goal = checkpointed(_goals(small, cycle, max_epochs))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    planned = _taken(_keyed(docs, seed, whole), small, goal)
    times = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")), F.array_repeat(F.lit(True), (F.col("part") > 0).cast("int")))
    copies = planned.select("_row", "part", "size", F.explode(times).alias("_fraction"))
    short = F.col("_fraction") & (F.col("part") < F.col("size"))
    words = F.slice(F.regexp_extract_all("_row.text", F.lit(f"({WORD})"), 1), 1, F.greatest(F.col("part"), F.lit(1)).cast("int"))
    ready = copies.select("_row", short.alias("_short"), F.when(short, F.array_join(words, " ")).otherwise(F.col("_row.text").cast("string")).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_short"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return ready.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
