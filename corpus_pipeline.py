"""From raw documents to packed sequences: classify, remove repeated lines, remove near duplicates, mix, pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import classifier, line_dedup, mixing, near_sets, packing
from wakeline.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below 0.5 go; held-out labels stay unused here too.

    Each row is judged by its own text, so repeated rows share a fate and rows with a null doc_id are judged like any other; a
    null or empty text is scored too. Without usable labels all scores are 0.5 and every row stays; an empty table stays empty.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), ~classifier.held_out())
    return classifier.scored_rows(docs, model).filter("score >= 0.5").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, and documents of which nothing is left.

    Rows of one doc_id count as one document and are judged alike, a null doc_id counts as the smallest; null and empty
    texts stay; an empty table stays empty; n_chars follows the text.
    """
    return line_dedup.deduplicated(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word Jaccard index of 0.8 or more one row stays, that with the smallest doc_id.

    A null doc_id counts as the smallest; of rows that repeat each other one stays; null and empty texts are alike; an
    empty table stays empty.
    """
    return near_sets.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole epochs as repeated rows, then the fractional selection, whose last text is cut.

    Every row is planned for itself, repeated rows and null ids too; null and empty texts have no words and may stay or
    go with the epochs; an empty table stays empty.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences of 1024.

    Every row is packed, repeated ones and null ids too; a null or empty text is the separator alone; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer are not SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written to the session's shared folder and read again; the folders go when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
