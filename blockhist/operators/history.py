"""Version chains and cell histories.

A cell history keeps, per (dataset, cell), only the versions in which the cell changed;
``payload`` NULL (tombstone) says that the cell became a hole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ordered
from ..functions.cells import align_size, cell_count, hole_to_null, is_hole, pad_cell
from ..functions.filters import possible
from ..session import listed, materialise
from .ranges import cells_in_ranges, merge_adjacent

KEY = ["dataset", "cell"]


def chain_versions(versions: DataFrame) -> DataFrame:
    """Pair each version with its predecessor; the first one is a full step."""
    prev = ordered.previous(versions, ["dataset"], "ord", {"prev_snap": "snap"}, ordered.history_chunk(versions))
    return prev.withColumn("step", F.when(F.col("prev_snap").isNull(), "full").otherwise("incremental"))


def latest_rows(rows: DataFrame) -> DataFrame:
    """The row of the highest ``ord`` of every cell, with all columns of ``rows``.

    It is found on (dataset, cell, ord) alone, so no payload is sorted or held by an aggregate; payloads are
    read by a semi join. Its keys are those of the aggregate (no ``ord`` is above the highest, so ``>=`` says
    equal without becoming a key): a history stored by ``write_bucketed`` is not exchanged for either.
    """
    newest = rows.groupBy(*KEY).agg(F.max("ord").alias("_last")).alias("newest")
    same = [F.col(f"row.{k}") == F.col(f"newest.{k}") for k in KEY]
    return rows.alias("row").join(newest, [*same, F.col("row.ord") >= F.col("newest._last")], "left_semi")


def as_of(history: DataFrame, ord: int | DataFrame) -> DataFrame:
    """Live cells ``(dataset, cell, payload)`` of one version.

    ``ord`` is a version number for all datasets, or a DataFrame ``(dataset, at)``. A history has one row per
    (dataset, ord, cell).
    """
    if isinstance(ord, DataFrame):
        rows = _up_to(history, ord)
    else:
        rows = history.filter(F.col("ord") <= ord)
    return latest_rows(rows).select(*KEY, "payload").filter(~is_hole("payload"))


def _up_to(history: DataFrame, at: DataFrame) -> DataFrame:
    """Rows up to one version per dataset (``at`` = (dataset, at)).

    The list is written first: with its size known Spark joins it without moving the
    history when it is small, and splits skewed datasets when it is not.
    """
    points = materialise(at.select("dataset", F.col("at").alias("_at")), "points")
    return history.join(points, "dataset").filter("ord <= _at")


def validity(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Add ``nxt``: the next version that changes the cell (NULL = none)."""
    chunk = ordered.history_chunk(versions)
    rows = history
    if chunk is None:
        return rows.withColumn("nxt", F.lead("ord").over(Window.partitionBy(*KEY).orderBy("ord")))
    # the successor is the predecessor in descending order
    back = rows.withColumn("_back", -F.col("ord").cast("long"))
    found = ordered.previous(back, KEY, "_back", {"nxt": "ord"},
                             -ordered.int_chunk("ord"))
    return found.drop("_back")


def shrinks(versions: DataFrame) -> DataFrame:
    """Versions smaller than their predecessor: ``(dataset, at, size, prev_size)``."""
    prev = ordered.previous(versions.select("dataset", "ord", "size"), ["dataset"], "ord",
                            {"prev_size": "size"}, ordered.history_chunk(versions))
    return prev.filter("size < prev_size").select("dataset", F.col("ord").alias("at"), "size", "prev_size")


def cut_rows(rows: DataFrame, versions: DataFrame, cell_size: int, chunk) -> DataFrame:
    """What shrinks leave of the rows ``(dataset, ord, cell, live)`` they meet: ``(dataset, ord, cell, at, _least)``.

    A shrink meets the cells (not the rows) it reaches; on the line of its cell it then finds the one row
    that holds at that moment. So the work is rows plus shrunk cells, not rows times shrinks. Of several shrinks
    that meet one row the cell keeps the smallest part that any of them left over.
    """
    lost = materialise(shrinks(versions).withColumn("off", F.col("size")).withColumn("len", F.col("prev_size") - F.col("size")), "shrinks")
    rows = possible(rows, lost, ["dataset"])
    met = cells_in_ranges(lost, rows.select(*KEY).distinct(), cell_size).select(
        *KEY, F.col("at").alias("ord"), "size", (F.col("at").cast("long") * 2 + 1).alias("_o"))
    # a row stands before a shrink of its own version: what that version writes is not cut by it
    known = rows.select(*KEY, "ord", (F.col("ord").cast("long") * 2).alias("_o"), F.struct("ord", "live").alias("_row"))
    line = ordered.carry_forward(known.unionByName(met, allowMissingColumns=True), KEY, "_o", ["_row"], chunk)
    hit = line.filter("_o % 2 = 1 and _row.live and _row.ord < ord").select(
        *KEY, F.col("_row.ord").alias("ord"), F.col("ord").alias("at"), "size")
    kept = F.greatest(F.col("size") - F.col("cell") * cell_size, F.lit(0)).cast("long")
    w = Window.partitionBy(*KEY, "ord").orderBy("at")
    return (hit.select(*KEY, "ord", "at", F.least(kept, F.lit(cell_size)).alias("_keep"))
            .withColumn("_least", F.min("_keep").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_was", F.lag("_least").over(w))
            .filter(F.col("_was").isNull() | (F.col("_least") < F.col("_was")))
            .select(*KEY, "ord", "at", "_least"))


def apply_resize(history: DataFrame, versions: DataFrame, cell_size: int) -> DataFrame:
    """Add the rows that shrinking versions imply.

    A shrink turns live cells past the new end into holes and cuts the boundary cell; what
    is regrown later reads as zero.
    """
    rows = history.select("dataset", "ord", "cell", "payload")
    narrow = rows.select("dataset", "ord", "cell", F.isnotnull("payload").alias("live"))
    return rows.unionByName(resize_rows(rows, narrow, versions, cell_size))


def resize_rows(rows: DataFrame, narrow: DataFrame, versions: DataFrame, cell_size: int) -> DataFrame:
    """The rows that shrinking versions add to ``rows``; ``narrow`` = (dataset, ord, cell, live) of the same rows."""
    # written once: its size is known then, and payloads are fetched for the few cut cells only
    cut = materialise(cut_rows(narrow, versions, cell_size, ordered.history_chunk(versions)), "cuts")
    holes = cut.filter("_least = 0").select("dataset", F.col("at").alias("ord"), "cell",
                                            F.lit(None).cast("binary").alias("payload"))
    short = pad_cell(F.substring("payload", F.lit(1), F.col("_least").cast("int")), cell_size)
    partly = cut.filter("_least > 0")
    parts = (possible(rows, partly, KEY + ["ord"]).join(listed(partly), KEY + ["ord"])
             .select("dataset", F.col("at").alias("ord"), "cell", hole_to_null(short, cell_size).alias("payload")))
    return holes.unionByName(parts)


def _digest(history: DataFrame) -> DataFrame:
    return history.withColumn("_d", F.when(~is_hole("payload"), F.sha2("payload", 256)))


def version_delta(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Cells that really differ between adjacent versions: ``(dataset, ord, cell, op)``.

    ``WRITE`` = new content, ``FREE`` = became a hole. Content is compared by digest, so the
    payload stays where it is.
    """
    narrow = _digest(history).select("dataset", "ord", "cell", "_d")
    prev = ordered.previous(narrow, KEY, "ord", {"_pd": "_d"}, ordered.history_chunk(versions))
    return (prev.filter(~F.col("_d").eqNullSafe(F.col("_pd")))
            .select("dataset", "ord", "cell", F.when(F.col("_d").isNull(), "FREE").otherwise("WRITE").alias("op")))


def cells_to_ranges(delta: DataFrame, cell_size: int, chunk_width: int = ordered.SAFE_GROUP) -> DataFrame:
    """Join runs of neighbouring cells with one ``op`` into ranges ``(off, len)``."""
    pieces = delta.select("dataset", "ord", "cell", "op", (F.col("cell") * cell_size).alias("off"),
                          F.lit(cell_size).cast("long").alias("len"))
    return merge_adjacent(pieces, ["dataset", "ord"], "cell", ordered.int_chunk("cell", chunk_width), "true").select(
        "dataset", "ord", "op", "off", "len")


def delta_between(history: DataFrame, i: int | Column, j: int | Column) -> DataFrame:
    """Cells that differ between versions ``i`` and ``j``, whatever lies between them."""
    o = F.col("ord")
    rows = _digest(history).filter(o <= j).select(*KEY, "ord", "_d")
    state = rows.groupBy(*KEY).agg(
        F.max_by(F.struct("_d"), F.when(o <= i, o)).alias("_a"),
        F.max_by(F.struct("_d"), o).alias("_b"))
    a, b = F.col("_a._d"), F.col("_b._d")
    return (state.filter(~a.eqNullSafe(b))
            .select(*KEY, F.when(b.isNull(), "FREE").otherwise("WRITE").alias("op")))


def written_since(history: DataFrame, points: DataFrame) -> DataFrame:
    """Bytes that differ between a version and a later state, per dataset.

    ``points`` = (dataset, base, head) as version numbers. The result must be 0 before
    work on the dataset starts.
    """
    rows = (_digest(history).withColumn("_n", F.coalesce(F.octet_length("payload"), F.lit(0)))
            .join(materialise(points, "points"), "dataset").filter("ord <= head"))
    o = F.col("ord")
    state = rows.groupBy(*KEY).agg(
        F.max_by(F.struct("_d", "_n"), F.when(o <= F.col("base"), o)).alias("_a"),
        F.max_by(F.struct("_d", "_n"), o).alias("_b"))
    differs = ~F.col("_a._d").eqNullSafe(F.col("_b._d"))
    size = F.greatest(F.coalesce(F.col("_a._n"), F.lit(0)), F.coalesce(F.col("_b._n"), F.lit(0)))
    sums = state.groupBy("dataset").agg(F.sum(F.when(differs, size).otherwise(0)).cast("long").alias("bytes"))
    return (points.select("dataset").distinct().join(sums, "dataset", "left")
            .select("dataset", F.coalesce("bytes", F.lit(0).cast("long")).alias("written")))


def referenced(history: DataFrame, at: DataFrame) -> DataFrame:
    """Bytes held by the live cells of one version per dataset (``at`` = (dataset, at))."""
    rows = _up_to(history, at)
    size = F.when(is_hole("payload"), 0).otherwise(F.octet_length("payload"))
    live = (rows.withColumn("_n", size).groupBy(*KEY).agg(F.max_by("_n", "ord").alias("_n")))
    return live.groupBy("dataset").agg(F.sum("_n").cast("long").alias("referenced"))


def with_new_sizes(versions: DataFrame, grain: int) -> DataFrame:
    """Add the size rounded up to the grain and the number of cells of the version."""
    return (versions.withColumn("new_size", align_size("size", grain))
            .withColumn("cells", cell_count("size", grain)))
