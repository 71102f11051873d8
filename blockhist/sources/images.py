"""Byte images as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ordered
from ..functions.cells import hole_to_null, idiv, is_hole, pad_cell


def to_cells(df: DataFrame, keys: list[str], data: str, cell_size: int,
             keep_holes: bool = False, pad: bool = True) -> DataFrame:
    """Cut a byte column into cells ``(keys, cell, payload)``.

    The last cell is zero-padded. NULL and empty images have no cells; all-zero cells are
    holes and have no rows unless ``keep_holes``.
    """
    last = idiv(F.octet_length(data).cast("long") - 1, cell_size)
    cut = (df.filter(F.octet_length(data) > 0)
             .select(*keys, F.col(data).alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("cell")))
    piece = F.substring("_b", (F.col("cell") * cell_size + 1).cast("int"), F.lit(cell_size))
    out = cut.select(*keys, "cell", (pad_cell(piece, cell_size) if pad else piece).alias("payload"))
    return out if keep_holes else out.filter(~is_hole("payload", cell_size))


def to_history(df: DataFrame, data: str, cell_size: int) -> DataFrame:
    """Cell history ``(dataset, ord, cell, payload)`` of images ``(dataset, ord, <data>)``: what each image changes in the one before.

    An image stands beside its predecessor before either is cut: bytes are moved once, and only cells that
    differ become rows. A cell past the end of a shorter image becomes a hole; an empty or NULL image has holes only.
    """
    line = ordered.previous(df.select("dataset", "ord", F.col(data).alias("_b")), ["dataset"], "ord", {"_was": "_b"},
                            ordered.history_chunk(df))
    size, before = (F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in ("_b", "_was"))
    cut = (line.filter(~F.col("_b").eqNullSafe(F.col("_was")) & (F.greatest(size, before) > 0))
           .select("*", F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.greatest(size, before) - 1, cell_size))).alias("cell")))

    def piece(c):
        part = F.substring(c, (F.col("cell") * cell_size + 1).cast("int"), F.lit(cell_size))
        return hole_to_null(pad_cell(part, cell_size), cell_size)
    changed = cut.select("dataset", "ord", "cell", piece("_b").alias("payload"), piece("_was").alias("_old"))
    return changed.filter(~F.col("payload").eqNullSafe(F.col("_old"))).drop("_old")
