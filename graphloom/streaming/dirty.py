"""Extension: dirtiness over a stream of summary updates.

The batch rule (a callee newer than its caller makes the caller stale) per micro-batch: updates come as
a stream, edges and current summaries as tables. Late updates are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(updates: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, function_id, updated_at): the newest update of each function in each window."""
    stream = updates.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay)
    return stream.groupBy(F.window("updated_at", window), "function_id").agg(F.max("updated_at").alias("updated_at"))


def stale_callers(updates: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """(caller_id): callers older than an update of a callee, for one batch or a stream of updates."""
    own = summaries.select(F.col("function_id").alias("caller_id"), F.col("updated_at").alias("own"))
    met = updates.select(F.col("function_id").alias("callee_id"), "updated_at").join(edges.select("caller_id", "callee_id"), "callee_id").join(own, "caller_id")
    return met.filter("updated_at > own").select("caller_id")


def follow(updates: DataFrame, edges: DataFrame, summaries: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch's stale callers go to store(df, batch); summaries() gives the current table."""

    def each(batch: DataFrame, number: int) -> None:
        store(stale_callers(batch, edges, summaries()).distinct(), number)

    writer = updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
