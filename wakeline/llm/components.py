"""Connected components of a link table by alternating large-star and small-star rounds, each a join with a minimum.

A node's smallest neighbour comes from an aggregation with partial sums and is joined back to its links, so no task has
to hold the neighbours of a node; Spark splits the join where one node has very many links. Each round is checkpointed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) to new links (a > b). Large: larger neighbours of a node go to its smallest; small: smaller ones do."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = sides.join(least, "u")
    if large:
        new = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link, component being the smallest node; links: columns a, b, any order.

    No links, or only links of a node to itself, give an empty result; null ends are dropped.
    """
    now = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark["n"] == 0 or tuple(mark) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(mark)
        now = checkpointed(_star(_star(now, large=True), large=False))
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links with the same components: each node to its smallest, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)  # what a node was labelled with follows it
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
