"""Throughput of a running job, from its progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ordered

MICROS = 1_000_000


def throughput(events: DataFrame, totals: DataFrame | None = None, span_seconds: int = 10,
               pieces: int | None = None, earlier: DataFrame | None = None, summed: bool = False) -> DataFrame:
    """Bytes done, trailing rate, percent and ETA at every instant of ``events``.

    ``events`` = (dataset, ts, bytes), ``totals`` = (dataset, total), an estimate, 0 = unknown.
    Events of one instant are summed first, unless they are ``summed`` already: one row per instant. The bytes of the trailing window are a difference
    of two running sums: the sum at ``t`` and the sum just before ``t - span``, for which a
    marker row is placed on the same time line. The line is cut by range, so a dataset with
    most of the events is spread over many tasks.

    ``earlier`` = (dataset, first_at, base) stands for events before those of ``events``: the instant of the first
    one in microseconds and the bytes of those that are not in ``events`` any more.
    """
    t = F.expr("unix_micros(cast(ts as timestamp))")
    one = events.select("dataset", "ts", F.col("bytes").cast("long").alias("b"))
    ticks = (one if summed else one.groupBy("dataset", "ts").agg(F.sum("b").alias("b"))).withColumn("_t", t)
    # a marker sorts before the events of its own instant: the window includes its start
    line = ticks.select("dataset", F.explode(F.array(
        F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"), F.col("b").alias("b"), F.col("_t").alias("t")),
        F.struct((F.col("_t") - span_seconds * MICROS).alias("at"), F.lit(0).alias("kind"),
                 F.lit(0).cast("long").alias("b"), F.col("_t").alias("t")))).alias("r")).select("dataset", "r.*")
    cut = ordered.range_chunks(line, ["dataset"], ["at", "kind"], pieces=pieces)
    sums = ordered.running_sums(cut, ["dataset"], ["at", "kind"], {"p": "b"}, "_chunk")
    per_tick = sums.groupBy("dataset", "t").agg(
        F.max(F.when(F.col("kind") == 1, F.col("p"))).alias("done"),
        F.max(F.when(F.col("kind") == 0, F.col("p"))).alias("_before"))
    out = per_tick.select("dataset", F.col("t").alias("micros"), "done",
                          (F.col("done") - F.col("_before")).alias("window_bytes"))
    # early on less than the span has passed
    first = ticks.groupBy("dataset").agg(F.min("_t").alias("_first"))
    if earlier is not None:
        first = (first.join(earlier.select("dataset", "first_at", "base"), "dataset", "left")
                 .select("dataset", F.coalesce("first_at", "_first").alias("_first"), "base"))
        out = (out.join(first.select("dataset", "base"), "dataset")
               .withColumn("done", F.col("done") + F.coalesce("base", F.lit(0).cast("long"))).drop("base"))
        first = first.drop("base")
    elapsed = F.call_function("div", F.col("micros") - F.col("_first"), F.lit(MICROS))
    passed = F.greatest(F.lit(1), F.least(F.lit(span_seconds), elapsed)).cast("long")
    out = out.join(first, "dataset").withColumn("rate", F.call_function("div", F.col("window_bytes"), passed)).drop("_first")
    if totals is None:
        return out
    left = F.col("total") - F.col("done")
    return (out.join(totals, "dataset", "left")
            .withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
            .withColumn("percent", F.when(F.col("total") > 0, F.least(
                F.lit(100).cast("long"), F.expr(
                    "case when total > 0 then cast(done as decimal(38,0)) * 100 div total end"))))
            .withColumn("eta_seconds", F.when((F.col("total") > 0) & (F.col("rate") > 0) & (left > 0),
                                              F.expr("case when rate > 0 then (total - done) div rate end"))))
