"""Structured Streaming over tables that arrive as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import instant


@contextmanager
def store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Streams that start within the block keep their state by this provider."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def arriving(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", files_a_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in ``folder`` (which may be a pattern, and then match files too) whose names match ``files``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def timed(stream: DataFrame, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """The stream with its ``column`` as an instant (a wall clock: in UTC, whatever the session's zone) and a watermark on it."""
    return stream.withColumn(column, instant(column, dict(stream.dtypes)[column])).withWatermark(column, delay)


def drained(stream: DataFrame, mode: str, checkpoint: str, out: str) -> DataFrame:
    """Run a query over what has arrived and return what it wrote.

    ``append`` writes Parquet at ``out``, exactly once across restarts with the same
    ``checkpoint``. ``complete`` and ``update`` keep their state in a memory table, for small results.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(out)
    name = f"drained_{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return stream.sparkSession.table(name)


def window_counts(stream: DataFrame, length: str, slide: str | None, *keys: str) -> DataFrame:
    """Rows and sums of ``value`` in tumbling (no slide) or sliding windows of ``ts``."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = stream.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(stream: DataFrame, gap: str, key: str) -> DataFrame:
    """Rows in sessions of a key that end after ``gap`` without a row."""
    grouped = stream.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys have not come before within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(list(keys))
