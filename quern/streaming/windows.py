"""Event-time windows, sessions, deduplication, joins and per-batch checks on streams.

Every function takes a batch or a streaming DataFrame: the batch form is what the
streaming one must come to when its input has ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """The time as TIMESTAMP, which watermarks need, and the watermark on streams."""
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late) if df.isStreaming else timed


def aggregated(df: DataFrame, window, keys: list[str], value: str) -> DataFrame:
    found = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def tumbling(df: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return aggregated(with_event_time(df, time, late), F.window(time, size), keys, value)


def sliding(df: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return aggregated(with_event_time(df, time, late), F.window(time, size, step), keys, value)


def sessions(df: DataFrame, time: str, keys: list[str], value: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return aggregated(with_event_time(df, time, late), F.session_window(time, gap), keys, value)


def first_seen(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row for each key; on a stream, keys are forgotten when the watermark has passed them."""
    timed = with_event_time(df, time, late)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def enriched(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stream rows with the columns of a static table."""
    return df.join(table, on, "left")


def checked_batches(stream: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each micro-batch's check (drift, contract ...) appended to ``out`` with its batch number."""

    def one(batch: DataFrame, number: int) -> None:
        check(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
