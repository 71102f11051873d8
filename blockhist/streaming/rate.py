"""Sliding throughput on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sliding_rate(events: DataFrame, span: str = "10 seconds", step: str = "1 second",
                 watermark: str | None = "1 minute") -> DataFrame:
    """Bytes and events per sliding window; partial sums combine before the shuffle.

    Late events within the watermark still count; ``None`` on batch input.
    """
    src = events.withWatermark("ts", watermark) if watermark else events
    return (src.groupBy("dataset", F.window("ts", span, step).alias("w"))
            .agg(F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("events"))
            .select("dataset", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "bytes", "events"))
