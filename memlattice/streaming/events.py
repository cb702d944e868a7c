"""Streams: windowed counts, idempotent ingestion, batch sinks.

The batch operators have a counterpart here for rows that keep arriving.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def timeseries(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys, closed when the watermark passes."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("bucket"), *keys, "n")


def ledger(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each idempotency key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def new_rows(events: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """Transcript rows by (source, offset, hash), repeats ignored."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def drain(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All rows there are, in batches, each handed to ``work`` exactly once per batch id."""
    return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
