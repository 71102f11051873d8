"""Progress of a running job from a stream of its events: bytes done, trailing rate, percent and time left.

The state is, per dataset, the instant of its first event, its newest and still open instant and the bytes that have left the
trailing span, and the events inside that span, summed by instant. A batch reads this state and its own events, never what
earlier batches wrote beside it; the state holds one span of events, however long the stream has been running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.progress import MICROS, throughput
from ..session import materialise
from .apply import read_batches, write_batch
from .state import KeyedState, batch_numbers

HEADS = "dataset STRING, first_at BIGINT, newest BIGINT, base BIGINT"
RECENT = "dataset STRING, ts TIMESTAMP, bytes BIGINT"
RATES = "dataset STRING, micros BIGINT, done BIGINT, window_bytes BIGINT, rate BIGINT"
ESTIMATED = RATES + ", total BIGINT, percent BIGINT, eta_seconds BIGINT"


def _states(spark, path: str, buckets: int) -> tuple[KeyedState, KeyedState]:
    # the events of a busy dataset lie in all buckets
    return (KeyedState(spark, f"{path}/heads", HEADS, ["dataset"], buckets),
            KeyedState(spark, f"{path}/recent", RECENT, ["dataset", "ts"], buckets))


def progress_batch(events: DataFrame, batch: int, path: str, span_seconds: int = 10, totals: DataFrame | None = None,
                   buckets: int = 16) -> None:
    """Take in one batch of events ``(dataset, ts, bytes)`` and store the progress at the instants it closes.

    An instant is closed when a newer event of its dataset has arrived. The newest instant stays open, so where batches begin
    and end changes nothing; ``finish_progress`` closes it. An event of a closed instant is late: it goes to ``<path>/late`` and is
    not counted. ``totals`` as in ``throughput``.
    """
    spark = events.sparkSession
    heads, recent = _states(spark, path, buckets)
    every = list(range(buckets))
    head, at = heads.read(batch), F.unix_micros("ts")
    marked = (events.select("dataset", F.col("ts").cast("timestamp").alias("ts"), "bytes")
              .join(head.select("dataset", "newest"), "dataset", "left"))
    late = F.col("newest").isNotNull() & (at < F.col("newest"))
    ticks = materialise(marked.filter(~late).groupBy("dataset", "ts").agg(F.sum("bytes").cast("long").alias("bytes")), "ticks")
    line = materialise(recent.read(batch).unionByName(ticks).groupBy("dataset", "ts").agg(F.sum("bytes").alias("bytes")), "line")

    tops = ticks.groupBy("dataset").agg(F.min(at).alias("_first"), F.max(at).alias("_top"))
    moved = materialise(head.join(tops, "dataset", "full").select(
        "dataset", F.coalesce("first_at", "_first").alias("first_at"), F.coalesce("_top", "newest").alias("newest"),
        F.col("newest").alias("_open"), F.coalesce("base", F.lit(0).cast("long")).alias("base")), "progress-heads")
    rows = throughput(line, totals, span_seconds, earlier=head, summed=True).join(moved.select("dataset", "newest", "_open"), "dataset")
    closed = rows.filter("micros < newest and (_open is null or micros >= _open)").drop("newest", "_open")
    write_batch(closed, f"{path}/progress", batch)
    write_batch(marked.filter(late).drop("newest"), f"{path}/late", batch)

    placed = line.join(moved.select("dataset", "newest"), "dataset").withColumn("_in", at >= F.col("newest") - span_seconds * MICROS)
    left = placed.filter(~F.col("_in")).groupBy("dataset").agg(F.sum("bytes").alias("_left"))
    base = (F.col("base") + F.coalesce("_left", F.lit(0).cast("long"))).alias("base")
    recent.write(placed.filter("_in").select("dataset", "ts", "bytes"), batch, every)
    heads.write(moved.join(left, "dataset", "left").select("dataset", "first_at", "newest", base), batch, every)


def finish_progress(spark, path: str, span_seconds: int = 10, totals: DataFrame | None = None, buckets: int = 16) -> None:
    """Close the open instant of every dataset: nothing more will come for them."""
    last = (batch_numbers(spark, f"{path}/heads/owners") or [-1])[-1]
    heads, recent = _states(spark, path, buckets)
    head = heads.read(last + 1)
    rows = throughput(recent.read(last + 1), totals, span_seconds, earlier=head, summed=True)
    write_batch(rows.join(head.select("dataset", F.col("newest").alias("micros")), ["dataset", "micros"], "left_semi"),
                f"{path}/progress", last + 1)


def stream_progress(events: DataFrame, path: str, checkpoint: str, span_seconds: int = 10, totals: DataFrame | None = None):
    """Start the stream over events ``(dataset, ts, bytes)``."""
    return (events.writeStream
            .foreachBatch(lambda df, batch: progress_batch(df, batch, path, span_seconds, totals))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored_progress(spark, path: str, estimated: bool = True) -> DataFrame:
    """What has been stored so far; ``estimated`` if the stream had ``totals``."""
    return read_batches(spark, f"{path}/progress", ESTIMATED if estimated else RATES)
