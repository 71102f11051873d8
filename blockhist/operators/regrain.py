"""The same bytes cut at another cell size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordered
from ..functions.cells import full_cell, hole_to_null, idiv, is_hole, zeros


def ratio(big: int, small: int) -> int:
    if big % small:
        raise ValueError("one cell size must be a multiple of the other")
    return big // small


def to_finer(cells: DataFrame, old: int, new: int) -> DataFrame:
    """Cut every cell into ``old / new`` smaller ones; no shuffle.

    A hole (NULL payload) becomes that many holes; all-zero pieces become holes.
    """
    k = ratio(old, new)
    rest = [c for c in cells.columns if c not in ("cell", "payload")]
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_k")
    piece = F.substring(full_cell("payload", old), F.col("_k") * new + 1, F.lit(new))
    return (cells.select("*", at)
            .select(*rest, (F.col("cell") * k + F.col("_k")).alias("cell"), hole_to_null(piece, new).alias("payload")))


def assemble(parts: DataFrame, keys: list[str], old: int, new: int) -> DataFrame:
    """Join cells ``(keys, cell, payload)`` of one grain into bigger ones.

    Missing and NULL parts read as zeros, and so does the end of a short payload. Each part brings the zeros between itself and the
    part before it, the end is padded. A group has at most ``new / old`` rows.
    """
    k = ratio(new, old)
    live = parts.filter(F.col("payload").isNotNull()).select(
        *keys, idiv("cell", k).alias("_t"), F.pmod("cell", F.lit(k)).cast("int").alias("_k"),
        full_cell("payload", old).alias("payload"))
    group = keys + ["_t"]
    gap = (F.col("_k") - F.coalesce(F.col("_before"), F.lit(-1)) - 1) * old
    spaced = ordered.previous(live, group, "_k", {"_before": "_k"}).withColumn(
        "_p", F.concat(F.substring(zeros(new), F.lit(1), gap), F.col("payload")))
    joined = spaced.groupBy(*group).agg(F.expr("listagg(_p) within group (order by _k)").alias("_p"))
    return joined.select(*keys, F.col("_t").alias("cell"), F.rpad("_p", F.lit(new), F.lit(b"\0")).alias("payload"))


def regrain(cells: DataFrame, keys: list[str], old: int, new: int) -> DataFrame:
    """Re-cut complete images ``(keys, cell, payload)``; all-zero cells are dropped."""
    live = cells.select(*keys, "cell", "payload").filter(~is_hole("payload", old))
    if new == old:
        return live
    if new < old:
        return to_finer(live, old, new).filter(F.col("payload").isNotNull())
    return assemble(live, keys, old, new)


def regrain_history(history: DataFrame, versions: DataFrame, old: int, new: int) -> DataFrame:
    """Re-cut a cell history ``(dataset, ord, cell, payload)``, all versions in one job.

    A bigger cell changes whenever one of its parts does; the other parts keep the value
    they had, which is carried forward per part. Cost follows the size of the result.
    """
    rows = history.select("dataset", "ord", "cell", "payload")
    if new == old:
        return rows
    if new < old:
        return drop_unchanged(to_finer(rows, old, new), versions)
    k = ratio(new, old)
    changed = rows.select("dataset", "ord", idiv("cell", k).alias("_t")).distinct()
    parts = changed.select("dataset", "ord",
                           F.explode(F.sequence(F.col("_t") * k, F.col("_t") * k + (k - 1))).alias("cell"))
    # slots and known rows stand on one line per part, a slot right after the row of its own
    # version: payloads are shuffled once to be carried forward, without a join before it
    slots = parts.select("dataset", "ord", "cell", (F.col("ord").cast("long") * 2 + 1).alias("_o"),
                         F.lit(None).cast("struct<payload: binary>").alias("_v"))
    known = rows.select("dataset", "ord", "cell", (F.col("ord").cast("long") * 2).alias("_o"),
                        F.struct("payload").alias("_v"))
    full = ordered.carry_forward(known.unionByName(slots), ["dataset", "cell"], "_o", ["_v"],
                                 ordered.history_chunk(versions)).filter("_o % 2 = 1")
    whole = assemble(full.select("dataset", "ord", "cell", F.col("_v.payload").alias("payload")),
                     ["dataset", "ord"], old, new)
    return (changed.withColumnRenamed("_t", "cell")
            .join(whole, ["dataset", "ord", "cell"], "left")
            .select("dataset", "ord", "cell", "payload"))


def with_digest(rows: DataFrame, cell_size: int | None = None) -> DataFrame:
    """Add ``digest``, the SHA-256 of the payload, NULL for a hole: what later steps compare instead of payloads."""
    return rows.withColumn("digest", F.when(~is_hole("payload", cell_size), F.unhex(F.sha2("payload", 256))))


def drop_unchanged(history: DataFrame, versions: DataFrame, cell_size: int | None = None) -> DataFrame:
    """Remove rows whose content equals the cell's content before (a hole, if none).

    Only 32-byte digests go through the ordering shuffle next to the row's own payload.
    """
    prev = ordered.previous(with_digest(history, cell_size), ["dataset", "cell"], "ord", {"_pd": "digest"},
                            ordered.history_chunk(versions))
    return prev.filter(~F.col("digest").eqNullSafe(F.col("_pd"))).drop("digest", "_pd")


def unchanged_rows(narrow: DataFrame, chunk) -> DataFrame:
    """Keys of the rows ``(dataset, ord, cell, digest)`` that :func:`drop_unchanged` removes."""
    prev = ordered.previous(narrow, ["dataset", "cell"], "ord", {"_pd": "digest"}, chunk)
    return prev.filter(F.col("digest").eqNullSafe(F.col("_pd"))).select("dataset", "ord", "cell")


def overlay_cells(touched: DataFrame, image_cells: DataFrame) -> DataFrame:
    """New content of touched cells ``(dataset, ord, cell, op, covered)``.

    A cell fully covered by a FREE is a hole. Any other touched cell, in particular one
    whose edges lie outside the range, takes its whole content from the version's image.
    """
    image = image_cells.select("dataset", "ord", "cell", F.col("payload").alias("_image"))
    return (touched.join(image, ["dataset", "ord", "cell"], "left")
            .withColumn("payload", F.when(~_is_gone(), hole_to_null("_image"))).drop("_image"))


def overlay_parts(touched: DataFrame, image_cells: DataFrame, old: int, new: int) -> DataFrame:
    """:func:`overlay_cells` from image cells that hold ``old / new`` touched cells each.

    A touched cell meets the image cell it lies in and takes its part of it behind the join: an image cell is moved
    once, whole, however many cells it holds.
    """
    k = ratio(old, new)
    image = image_cells.select("dataset", "ord", F.col("cell").alias("_whole"), F.col("payload").alias("_image"))
    part = F.substring(full_cell("_image", old), (F.pmod("cell", F.lit(k)) * new + 1).cast("int"), F.lit(new))
    return (touched.withColumn("_whole", idiv("cell", k)).join(image, ["dataset", "ord", "_whole"], "left")
            .withColumn("_part", part).withColumn("payload", F.when(~_is_gone(), hole_to_null("_part", new)))
            .drop("_whole", "_image", "_part"))


def _is_gone() -> Column:
    return (F.col("op") == "FREE") & F.col("covered")
