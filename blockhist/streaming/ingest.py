"""Change logs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.changes import judged


def stream_changes(records: DataFrame, path: str, checkpoint: str):
    """Judge streamed records and append data changes and rejects to one table.

    Rows with ``reason`` are rejects. The file sink commits each micro-batch once.
    Returns the started query.
    """
    rows = judged(records).filter("op is not null or reason is not null").select(
        "dataset", "ord", "seq", "op", "off", "len", "reason",
        F.when(F.col("reason").isNotNull(), F.col("line")).alias("raw"))
    return (rows.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
