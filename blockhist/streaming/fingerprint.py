"""Fingerprints carried forward version by version as changes arrive.

The state of a stream is the hash words of every live cell and, per dataset, the accumulator up to and with
its newest, still open version. A batch looks up the cells it changes, adds the difference to the accumulators, and prints
the versions that a newer one has closed. Both states are keyed tables: a batch reads the buckets of its own
cells and datasets, never what earlier batches wrote beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lanes as L, ordered
from ..operators.fingerprint import accumulate, with_seeds
from ..session import materialise
from .apply import read_batches, split_late, write_batch
from .state import KeyedState, batch_numbers

PRINTS = "dataset STRING, snap STRING, ord INT, size BIGINT, version_id DECIMAL(20,0), acc BINARY"
HEADS = "dataset STRING, ord INT, acc BINARY"
#: cells of a dataset that share a bucket of the state
BLOCK = 1 << 12


def _states(spark, path: str, lanes: int, buckets: int) -> tuple[KeyedState, KeyedState]:
    words = ", ".join(f"{w} BIGINT" for w in L.word_names(lanes))
    return (KeyedState(spark, f"{path}/heads", HEADS, ["dataset"], buckets),
            KeyedState(spark, f"{path}/seeds", f"dataset STRING, block BIGINT, cell BIGINT, {words}", ["dataset", "block"], buckets))


def fingerprint_batch(rows: DataFrame, batch: int, versions: DataFrame, path: str, lanes: int = L.LANES,
                      cell_size: int | None = None, buckets: int = 64) -> None:
    """Take in one batch of cell rows ``(dataset, ord, cell, payload)`` and store the versions it closes.

    A version is closed when a newer one of its dataset has arrived; a row of a closed version is late and goes to
    ``<path>/late``. The newest version stays open, so where batches begin and end changes nothing.
    Versions without changes are filled in from ``versions``.
    """
    spark = rows.sparkSession
    heads, seeds = _states(spark, path, lanes, buckets)
    rows = rows.select("dataset", "ord", "cell", "payload")
    of_heads = heads.touched(rows)
    head = heads.read(batch, of_heads)
    fine, late = split_late(rows, head)
    words = L.word_names(lanes)
    block = F.expr(f"cell div {BLOCK}L").alias("block")
    # of several rows of a cell in one version any one counts, but the same everywhere
    one = (with_seeds(fine, lanes, cell_size).groupBy("dataset", "ord", "cell")
           .agg(F.max(F.struct(*words)).alias("_s")).select("dataset", "ord", "cell", "_s.*"))
    new = materialise(one.select("dataset", block, "ord", "cell", *words), "batch")
    of_seeds = seeds.touched(new)
    old = seeds.read(batch, of_seeds)

    # the state of a cell stands before all rows of the batch on its line
    line = (old.join(new.select("dataset", "block", "cell").distinct(), ["dataset", "block", "cell"], "left_semi")
            .withColumn("ord", F.lit(-1)).unionByName(new))
    olds = L.word_names(lanes, "_o")
    moved = ordered.previous(line, ["dataset", "cell"], "ord", dict(zip(olds, words)), ordered.history_chunk(versions))
    deltas = moved.filter("ord >= 0").groupBy("dataset", "ord").agg(*L.lane_totals(lanes, "_w", "_o"))

    tops = new.groupBy("dataset").agg(F.max("ord").alias("_top"))
    known = head.select("dataset", F.col("ord").alias("_open"), F.col("acc").alias("_start"))
    span = tops.join(known, "dataset", "left")
    spine = (versions.select("dataset", "ord").unionByName(new.select("dataset", "ord")).distinct()
             .join(span.select("dataset", "_top", "_open"), "dataset").filter("ord <= _top and (_open is null or ord >= _open)"))
    sums = accumulate(deltas, spine, lanes, ordered.history_chunk(versions)).join(known.select("dataset", "_start"), "dataset", "left")
    total = F.when(F.col("_start").isNull(), F.col("acc")).otherwise(L.acc_add("acc", "_start"))
    done = materialise(sums.withColumn("acc", total).select("dataset", "ord", "_top", "acc"), "accumulated")

    write_batch(_printed(versions, done.filter("ord < _top")), f"{path}/prints", batch)
    write_batch(late, f"{path}/late", batch)
    kept = old.join(new.select("dataset", "block", "cell").distinct(), ["dataset", "block", "cell"], "left_anti")
    last = new.groupBy("dataset", "block", "cell").agg(F.max_by(F.struct(*words), "ord").alias("_s")).select("dataset", "block", "cell", "_s.*")
    # a hole is an absent cell
    seeds.write(kept.unionByName(last.filter(f"{words[0]} is not null")), batch, of_seeds)
    moved_on = done.filter("ord = _top").select("dataset", "ord", "acc")
    heads.write(head.join(moved_on.select("dataset"), "dataset", "left_anti").unionByName(moved_on), batch, of_heads)


def _printed(versions: DataFrame, accs: DataFrame) -> DataFrame:
    return (versions.join(accs.select("dataset", "ord", "acc"), ["dataset", "ord"])
            .select("dataset", "snap", "ord", "size", F.col("version_id").cast("decimal(20,0)").alias("version_id"), "acc"))


def finish_fingerprints(spark, versions: DataFrame, path: str, lanes: int = L.LANES, cell_size: int | None = None,
                        buckets: int = 64) -> None:
    """Close the open version of every dataset: nothing more will come for them."""
    last = (batch_numbers(spark, f"{path}/heads/owners") or [-1])[-1]
    heads, _ = _states(spark, path, lanes, buckets)
    write_batch(_printed(versions, heads.read(last + 1)), f"{path}/prints", last + 1)


def stream_fingerprints(rows: DataFrame, versions: DataFrame, path: str, checkpoint: str,
                        lanes: int = L.LANES, cell_size: int | None = None):
    """Start the stream over cell rows ``(dataset, ord, cell, payload)``."""
    return (rows.writeStream
            .foreachBatch(lambda df, batch: fingerprint_batch(df, batch, versions, path, lanes, cell_size))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored_fingerprints(spark, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/prints", PRINTS)
