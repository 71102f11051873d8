"""The streaming operators, run to completion over files made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.functions import lanes as L
from blockhist.operators.regrain import drop_unchanged
from blockhist.sources import change_log
from blockhist.streaming import apply, fingerprint, ingest, progress, rate

from . import views as V
from .q_fingerprint import HASHES
from .q_history import RESIZED
from .q_policy import SPAN, THROUGHPUT, estimates
from .q_ranges import TOUCHED
from .q_sources import JUDGED, clamped
from .registry import query
from blockhist.session import materialise, scratch_path

D = V.duck


def arrivals(df, label, order, run):
    """Let ``df`` arrive in three parts along ``order``; ``run(path)`` handles what is new.

    Every part is one run of the stream with the same state, so it is one micro-batch.
    """
    path = scratch_path(df.sparkSession, label)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = -(-(hi - lo + 1) // 3)
    for i in range(3):
        part = df.filter(F.col(order).between(lo + i * width, lo + (i + 1) * width - 1))
        part.write.mode("append").parquet(path)
        run(path).awaitTermination()


@query("stream_ingest", f"""with {JUDGED}
select dataset, ord, keyword_op op, case when reason is null then off end off, case when reason is null then len end len, reason, case when reason is not null then line end raw from (
  select *, case when reason is null and (keyword = 'FREE' or starts_with(keyword, 'WRITE')) and o = 1 then case when keyword = 'FREE' then 'FREE' else 'WRITE' end end keyword_op from judged)
where keyword_op is not null or reason is not null""", text=('off', 'len'))
def stream_ingest(spark, sf):
    """Log lines as a stream of text files; changes and rejects in one sink."""
    src, out, ck = (scratch_path(spark, x) for x in ("lines", "ingested", "ingest-state"))
    lines = V.view(spark, sf, V.LOG)
    lines.select(F.concat_ws("\t", "dataset", F.col("ord").cast("string"), F.col("seq").cast("string"), "line").alias("value")) \
        .repartition(3, "dataset").write.text(src)
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
    part = F.split("value", "\t", 4)
    named = raw.select(part[0].alias("dataset"), part[1].cast("int").alias("ord"), part[2].cast("long").alias("seq"),
                       part[3].alias("line"))
    q = ingest.stream_changes(change_log.parse_lines(named), out, ck)
    q.awaitTermination()
    return spark.read.parquet(out).select(
        "dataset", "ord", "op", F.when(F.col("reason").isNull(), F.col("off")).alias("off"),
        F.when(F.col("reason").isNull(), F.col("len")).alias("len"), "reason", "raw")


GRAIN = 4096


def applied(spark, sf):
    changes = clamped(spark, sf)
    out, ck = scratch_path(spark, "applied"), scratch_path(spark, "apply-state")
    ever = changes.filter("op = 'WRITE'").select("dataset", "ord", F.explode(F.sequence(
        F.expr(f"off div {GRAIN}"), F.expr(f"(off + len - 1) div {GRAIN}"))).alias("cell")).distinct()
    text = F.concat_ws(":", F.lit("image"), "dataset", F.col("ord").cast("string"), F.col("cell").cast("string"))
    image = ever.withColumn("payload", text.cast("binary"))

    def run(path):
        stream = spark.readStream.schema(changes.schema).parquet(path)
        return apply.stream_apply(stream, image, out, GRAIN, ck)
    arrivals(changes, "changes", "ord", run)
    return apply.applied_history(spark, out)


@query("stream_apply", f"""with {TOUCHED},
t as (select *, op = 'FREE' and covered gone, bool_or(op = 'WRITE') over (partition by dataset, ord, cell) wrote from touched),
g as (select *, coalesce(sum(gone::int) over (partition by dataset, cell order by ord, seq rows between unbounded preceding and 1 preceding), 0) life from t),
r as (select *, bool_or(not gone and wrote) over (partition by dataset, cell, life) lived from g),
last as (select dataset, ord, cell, arg_max(gone, seq) gone, bool_or(wrote) wrote from r where not gone or lived group by 1, 2, 3)
select dataset, ord, cell, case when not gone and wrote then 'image:'||dataset||':'||ord||':'||cell end payload from last""")
def stream_apply(spark, sf):
    """Changes in three batches of versions; equals the batch form: a free ends the life of a cell once, wherever batches are cut."""
    return applied(spark, sf).withColumn("payload", F.col("payload").cast("string"))


@query("stream_apply_resize", RESIZED)
def stream_apply_resize(spark, sf):
    """Cells that arrive as writes and frees in three batches of versions that shrink and grow; equals the batch form."""
    cells, sizes = V.sized_cells(spark, sf), V.view(spark, sf, V.SIZES)
    op = F.when(F.col("payload").isNull(), "FREE").otherwise("WRITE")
    changes = cells.select("dataset", "ord", F.col("cell").cast("long").alias("seq"), op.alias("op"),
                           (F.col("cell") * V.SIZED).cast("long").alias("off"), F.lit(V.SIZED).cast("long").alias("len"))
    out, ck = scratch_path(spark, "resized"), scratch_path(spark, "resize-state")

    def run(path):
        return apply.stream_apply(spark.readStream.schema(changes.schema).parquet(path), cells, out, V.SIZED, ck)
    arrivals(changes, "sized-changes", "ord", run)
    rows = drop_unchanged(apply.applied_history(spark, out, sizes, V.SIZED), sizes, V.SIZED)
    return rows.select("dataset", "ord", "cell", F.hex("payload").alias("payload"))


@query("stream_fingerprints", f"""with {HASHES}, top as (select dataset, max(ord) last from hist group by 1)
select s.dataset, s.snap, s.ord, acc from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord
join top on top.dataset = s.dataset and s.ord <= last""")
def stream_fingerprints(spark, sf):
    """Cell changes in three batches of versions, the accumulator carried from batch to batch."""
    cells = V.cells(spark, sf)
    out, ck = scratch_path(spark, "prints"), scratch_path(spark, "print-state")

    def run(path):
        stream = spark.readStream.schema(cells.schema).parquet(path)
        return fingerprint.stream_fingerprints(stream, V.spine(spark, sf), out, ck)
    arrivals(cells, "cells", "ord", run)
    fingerprint.finish_fingerprints(spark, V.spine(spark, sf), out)
    return fingerprint.stored_fingerprints(spark, out).select("dataset", "snap", "ord", L.acc_to_text("acc").alias("acc"))


@query("stream_split_versions", f"""with {HASHES}, top as (select dataset, max(ord) last from hist group by 1)
select s.dataset, s.snap, s.ord, acc from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord
join top on top.dataset = s.dataset and s.ord <= last""")
def stream_split_versions(spark, sf):
    """The same cells in three batches that end in the middle of a version."""
    cells = V.cells(spark, sf).withColumn("place", F.col("ord") * 64 + F.col("cell") + 17)
    out, ck = scratch_path(spark, "split-prints"), scratch_path(spark, "split-state")

    def run(path):
        stream = spark.readStream.schema(cells.schema).parquet(path)
        return fingerprint.stream_fingerprints(stream, V.spine(spark, sf), out, ck)
    arrivals(cells, "split-cells", "place", run)
    fingerprint.finish_fingerprints(spark, V.spine(spark, sf), out)
    return fingerprint.stored_fingerprints(spark, out).select("dataset", "snap", "ord", L.acc_to_text("acc").alias("acc"))


@query("stream_rate", f"""with e as (select dataset, ts, bytes from ({D(V.PROGRESS)})),
w as (select dataset, bytes, unnest(range(0, 6)) k, time_bucket(interval '1 hour', ts) h from e)
select dataset, epoch_us(h - to_hours(cast(k as int))) window_start, cast(sum(bytes) as bigint) bytes, count(*) events from w group by 1, 2""")
def stream_rate(spark, sf):
    """Six-hour windows sliding by one hour over a stream of progress events."""
    events = V.view(spark, sf, V.PROGRESS).withColumn("ts", F.col("ts").cast("timestamp"))
    path, out, ck = (scratch_path(spark, x) for x in ("events", "rates", "rate-state"))
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    # every file may be read first: nothing counts as late within the whole span
    rates = rate.sliding_rate(stream, "6 hours", "1 hour", "100 days")
    q = (rates.writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True)
         .foreachBatch(lambda df, b: df.withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{out}/run={b}"))
         .start())
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("dataset", "window_start").agg(F.max_by(F.struct("bytes", "events"), "batch").alias("r"))
    return last.select("dataset", F.unix_micros("window_start").alias("window_start"), "r.bytes", "r.events")


@query("stream_progress", THROUGHPUT, text=("percent", "eta_seconds"))
def stream_progress(spark, sf):
    """Progress events in three batches by time: bytes done, rate, percent and time left equal those of the whole table."""
    events = V.view(spark, sf, V.PROGRESS).withColumn("ts", F.col("ts").cast("timestamp"))
    totals = materialise(estimates(events), "totals")
    out, ck = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    timed = events.select("dataset", "ts", "bytes", F.unix_micros("ts").alias("micros"))

    def run(path):
        return progress.stream_progress(spark.readStream.schema(timed.schema).parquet(path), out, ck, SPAN, totals)
    arrivals(timed, "progress-events", "micros", run)
    progress.finish_progress(spark, out, SPAN, totals)
    return progress.stored_progress(spark, out)
