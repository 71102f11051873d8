"""Changes applied batch by batch, without reading what earlier batches wrote.

A micro-batch appends what it knows: the cells its records touch, with their content, and its frees as aligned
blocks. Which free ends which cell is settled when the history is read (``applied_history``), where a cell
asks for the first free after each of its touches. So a batch costs what it brings, however long the stream has been
running; ``compact`` settles what has arrived so far, so that a reader starts from there.

Every micro-batch owns one folder (``batch=<id>``) of each table and overwrites it, so a batch that runs again
after a failure leaves the same rows. The only state is the newest version of each dataset, in a keyed
table of which a batch reads and writes the buckets of its own datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ordered
from ..operators.history import apply_resize
from ..operators.ranges import dedupe_cells, ended_touches, enumerated_touches, free_blocks
from ..operators.regrain import overlay_cells
from ..session import delete_folder
from .state import KeyedState, batch_numbers

NEWEST = "dataset STRING, ord INT"
# ended: a free after the touch has been settled already
TOUCHED = "dataset STRING, ord INT, cell BIGINT, seq BIGINT, payload BINARY, ended BOOLEAN"
BLOCKS = "dataset STRING, ord INT, seq BIGINT, _level INT, _block BIGINT"


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark, path: str, schema: str) -> DataFrame:
    """Rows of all batches of a table; none if it has no batch yet."""
    folders = [f"{path}/batch={n}" for n in batch_numbers(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def split_late(changes: DataFrame, newest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A change is late when an earlier batch brought a newer version of its dataset."""
    marked = changes.join(newest.select("dataset", F.col("ord").alias("_top")), "dataset", "left")
    late = F.col("_top").isNotNull() & (F.col("ord") < F.col("_top"))
    return marked.filter(~late).drop("_top"), marked.filter(late).drop("_top")


def apply_batch(changes: DataFrame, batch: int, images: DataFrame, path: str, grain: int, buckets: int = 64) -> None:
    """Apply one batch of clamped changes ``(dataset, ord, seq, op, off, len)``.

    ``images`` are the cells of the versions' images at the grain. Late changes go to ``<path>/late``. A version may
    arrive in several batches, its records in any order.
    """
    spark = changes.sparkSession
    state = KeyedState(spark, f"{path}/newest", NEWEST, ["dataset"], buckets)
    touched = state.touched(changes)
    newest = state.read(batch, touched)
    fine, late = split_late(changes, newest)
    cells = overlay_cells(enumerated_touches(fine, grain), images).select(
        "dataset", "ord", "cell", "seq", "payload", F.lit(None).cast("boolean").alias("ended"))
    write_batch(cells, f"{path}/cells", batch)
    write_batch(free_blocks(fine, grain), f"{path}/frees", batch)
    write_batch(late.select("dataset", "ord", "seq", "op", "off", "len"), f"{path}/late", batch)
    merged = newest.unionByName(fine.select("dataset", "ord")).groupBy("dataset").agg(F.max("ord").alias("ord"))
    state.write(merged, batch, touched)


def stream_apply(changes: DataFrame, images: DataFrame, path: str, grain: int, checkpoint: str):
    """Start the stream; ``path`` receives ``cells``, ``frees`` and ``late``."""
    return (changes.writeStream
            .foreachBatch(lambda df, batch: apply_batch(df, batch, images, path, grain))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def settled_rows(spark, path: str) -> DataFrame:
    """``(dataset, ord, cell, seq, payload, ended)``: the last touch of every cell and version, ends by frees among them."""
    rows = read_batches(spark, f"{path}/cells", TOUCHED)
    live = rows.filter("payload is not null and not coalesce(ended, false)").select("dataset", "cell", "ord", "seq")
    ends = ended_touches(live, read_batches(spark, f"{path}/frees", BLOCKS), ordered.history_chunk(rows))
    gone = ends.select("dataset", "ord", "cell", "seq", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("boolean").alias("ended"))
    marks = ends.select("dataset", "cell", F.col("of_ord").alias("ord"), F.col("of_seq").alias("seq"), F.lit(True).alias("_now"))
    marked = (rows.join(marks, ["dataset", "cell", "ord", "seq"], "left")
              .withColumn("ended", F.coalesce("_now", "ended")).select(*rows.columns))
    return dedupe_cells(marked.unionByName(gone), ["seq", "payload", "ended"])


def applied_history(spark, path: str, versions: DataFrame | None = None, grain: int | None = None) -> DataFrame:
    """The cell history applied so far.

    With ``versions`` (dataset, ord, size) the shrinks among them cut it: what lies past the end of a
    version is gone from that version on, also where the log has no FREE for it.
    """
    rows = settled_rows(spark, path).drop("seq", "ended")
    if versions is None:
        return rows
    cut = apply_resize(rows, versions, grain)
    # a version that writes a cell has the last word over its own shrink
    return cut.groupBy("dataset", "ord", "cell").agg(
        F.max_by(F.struct("payload"), F.col("payload").isNotNull()).alias("_p")).select(
        "dataset", "ord", "cell", F.col("_p.payload").alias("payload"))


def compact(spark, path: str) -> None:
    """Settle all batches so far into one, between two runs of the stream.

    Frees of finished versions have ended what they can end, since later changes of those versions are late;
    those of the newest version of a dataset stay, because the rest of it may still arrive. The settled rows replace
    the newest batch's folder; the older ones go.
    """
    numbers = batch_numbers(spark, f"{path}/cells")
    if len(numbers) < 2:
        return
    newest = KeyedState(spark, f"{path}/newest", NEWEST, ["dataset"]).read(numbers[-1] + 1)
    frees = read_batches(spark, f"{path}/frees", BLOCKS).join(newest, ["dataset", "ord"], "left_semi")
    made = f"{path}/compacted-{numbers[-1]}"
    settled_rows(spark, path).write.mode("overwrite").parquet(f"{made}/cells")
    frees.write.mode("overwrite").parquet(f"{made}/frees")
    for table, schema in (("cells", TOUCHED), ("frees", BLOCKS)):
        write_batch(spark.read.schema(schema).parquet(f"{made}/{table}"), f"{path}/{table}", numbers[-1])
        for n in numbers[:-1]:
            delete_folder(spark, f"{path}/{table}/batch={n}")
    delete_folder(spark, made)
