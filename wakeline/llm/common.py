"""Shared helpers of the text operators: reading, checkpoints, words and Arrow plumbing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators are exactly the ASCII blanks; ``bytes.split()`` without arguments splits on the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's folder that driver and executors share; a local master may use a folder of its own, a cluster has to name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished steps when the driver collects garbage, which may come too late for the disk: have it done now."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended before
        remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder, which goes when the driver ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_at_end, spark, path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int = 32_000_000) -> int:
    """The session's number of shuffle partitions, or more if Spark's estimate of the input's size asks for more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(df.sparkSession), size // bytes_each if size < 1 << 55 else 0)


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts as UTF-8 bytes) in slices of about ``most_bytes``; one longer text makes a slice of its own."""
    for batch in batches:
        ids, column = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
        sizes = pa.compute.binary_length(column).to_pylist()
        at = 0
        while at < len(sizes):
            end, total = at + 1, sizes[at]
            while end < len(sizes) and total + sizes[end] <= most_bytes:
                total += sizes[end]
                end += 1
            yield ids.slice(at, end - at).to_pylist(), column.slice(at, end - at).to_pylist()
            at = end


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
