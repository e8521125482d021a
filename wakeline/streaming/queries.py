"""Streaming pipelines: report folders to state and events. Each names its own checkpoint, so namespaces never share state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import records
from ..operators import events
from ..sources import files, sinks
from . import state


def report_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New CSV files of a folder as they come; the checkpoint remembers which were read."""
    raw = spark.readStream.schema(schema).options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", maxFilesPerTrigger=files_per_trigger).csv(folder)
    named = files.canonical(raw)
    kind = records.message_kind(F.col("msg_type"), records.finite(F.col("lon")), records.finite(F.col("lat")))
    numbers = {c: records.finite(F.col(c)) for c in ("lon", "lat", "speed", "course")}
    return named.withColumns({"kind": kind, "mmsi": records.valid_mmsi(F.col("mmsi")), "t": records.event_time(F.col("timestamp")), **numbers}).filter("mmsi is not null and t is not null and kind <> 'unsupported'").select("mmsi", "kind", "t", *state.POSITION, *state.PARTICULARS)


def write_changes(changes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """State changes as Parquet; ``once`` reads what is there and stops."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def store_events(detections: DataFrame, table: str, checkpoint: str, key: list[str], latest: list[str], once: bool = False, on_failure: Callable[[Exception, int], None] | None = None) -> StreamingQuery:
    """Detections deduplicated per micro-batch and merged into the store; its number goes with the rows, so a replayed micro-batch is
    skipped. Detectors fail apart: one query each; ``on_failure`` may note the error, and the restarted query retries the batch."""

    def merge(batch: DataFrame, number: int) -> None:
        try:
            sinks.upsert_events(events.deduplicated(batch, key, latest), table, key, latest, number)
        except Exception as error:
            if on_failure is not None:
                on_failure(error, number)
            raise

    writer = detections.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
