"""Several sources in one stream, of which one is active at a time, and bounded backlogs between a stream and its consumers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import InOrder, in_order


def epochs(switches: DataFrame) -> DataFrame:
    """source, epoch, from_t, until_t (null: still active) from switches (source, t): each makes its source the active one and begins an epoch, also of the same source anew."""
    w = Window.orderBy("t")  # switches are made by hand: a few rows
    return switches.select("source", (F.row_number().over(w) - 1).alias("epoch"), F.col("t").alias("from_t"), F.lead("t").over(w).alias("until_t"))


def active(reports: DataFrame, switches: DataFrame) -> DataFrame:
    """The reports (source, t, ...) of the source that was active at their time, with its ``epoch``.

    Keys that take in source and epoch have state of their own: sources never mix, and a switch begins with none. What an older epoch left expires as a silent vessel does.
    """
    held = epochs(switches).withColumnRenamed("source", "_source")
    inside = (F.col("source") == F.col("_source")) & (F.col("t") >= F.col("from_t")) & (F.col("until_t").isNull() | (F.col("t") < F.col("until_t")))
    return reports.join(held, inside).drop("_source", "from_t", "until_t")


class Backlog(InOrder):
    """What waits for a consumer: the newest ``most``; a drain takes up to ``batch`` of the oldest, and asks that come while one is open are one."""

    def __init__(self, most: int, batch: int):
        self.most, self.batch = most, batch

    def advance(self, key, due, past, memo, clock):
        lost, out = memo.get("lost", 0), []
        queue = past[["t", "item"]].to_dict("records") if len(past) else []
        for r in due.sort_values(["t", "drain"], kind="stable").itertuples(index=False):
            if r.drain:
                out += [{"consumer": key[0], "t": q["t"], "item": int(q["item"]), "drained_at": r.t, "lost": lost} for q in queue[: self.batch]]
                del queue[: self.batch]
            else:
                queue.append({"t": r.t, "item": r.item})
                if len(queue) > self.most:
                    lost += len(queue) - self.most
                    del queue[: len(queue) - self.most]
        kept = pd.DataFrame(queue, columns=["t", "item"]) if queue else due.iloc[:0]
        return pd.DataFrame(out) if out else None, kept, {"lost": lost}, None


def drained(items: DataFrame, most: int = 500, batch: int = 100, delay: str = "0 seconds") -> DataFrame:
    """The items (consumer, t, item, drain) that each drain (a row whose ``drain`` is true) takes, oldest first, and how many were lost so far because more than ``most`` waited."""
    own = items.select("consumer", "t", F.col("item").cast("long").alias("item"), F.coalesce("drain", F.lit(False)).alias("drain"))
    return in_order(own, ["consumer"], Backlog(most, batch), f"consumer {items.schema['consumer'].dataType.simpleString()}, t timestamp, item long, drained_at timestamp, lost long", delay)


class Coalesced(InOrder):
    """Asks for a run of some work: one that comes while a run is open only marks it to be run once more when it is done."""

    def advance(self, key, due, past, memo, clock):
        out = []
        running, pending = memo.get("running", False), memo.get("pending", False)
        for r in due.sort_values(["t", "done"], kind="stable").itertuples(index=False):
            if r.done:
                running = pending
                if pending:
                    out.append({"work": key[0], "starts_at": r.t})
                pending = False
            elif running:
                pending = True
            else:
                running = True
                out.append({"work": key[0], "starts_at": r.t})
        return pd.DataFrame(out) if out else None, past.iloc[:0], {"running": bool(np.bool_(running)), "pending": bool(np.bool_(pending))}, None


def runs(asks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """work and starts_at of the runs that asks (work, t, done) lead to; rows whose ``done`` is true say that the open run has ended."""
    own = asks.select("work", "t", F.coalesce("done", F.lit(False)).alias("done"))
    return in_order(own, ["work"], Coalesced(), f"work {asks.schema['work'].dataType.simpleString()}, starts_at timestamp", delay)
