"""Checkpoint and resume as a stream: new files are scored once, restarts go on where they ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(
    spark: SparkSession,
    source: str,
    schema: StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    keys: tuple[str, ...] = (),
    event_time: str | None = None,
    delay: str = "1 hour",
    files_per_trigger: int = 64,
) -> None:
    """Everything in ``source`` that no earlier call has seen goes through ``transform`` to the Parquet table ``sink``.

    With ``keys``, rows that repeat them are dropped; with ``event_time`` too, only within ``delay``, so that state stays bounded.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    if keys and event_time:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    elif keys:
        rows = rows.dropDuplicates(list(keys))
    q = transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def status_counts(spark: SparkSession, source: str, schema: StructType, status: str, name: str) -> DataFrame:
    """Counts by status of a run log, as a finished streaming aggregate in memory."""
    counts = spark.readStream.schema(schema).parquet(source).groupBy(status).count()
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
