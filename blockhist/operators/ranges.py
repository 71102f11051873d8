"""Ranges and the cells they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ordered
from ..functions.cells import align_size, idiv
from ..functions.filters import possible
from ..session import materialise

#: cells enumerated by one generated row; longer ranges are first cut into spans, twice
SPANS = (1 << 24, 1 << 12)
#: sizes (as powers of two) of the aligned blocks that stand for the inside of a range
BLOCK_LEVELS = (0, 6, 12, 18)


def merge_adjacent(rows: DataFrame, keys: list[str], order: str, chunk: Column, condition: str) -> DataFrame:
    """Merge rows ``(keys, order, op, off, len)`` into the row right before them.

    A row continues its predecessor when it has the same ``op``, starts where that one ends
    and ``condition`` holds for it. Runs are formed inside chunks of the order column, in one
    shuffle and one sort: a run is read off its first and its last row, which look at their neighbours. Only the
    first and the last run of each chunk can go on across its border, and these are merged in a second step over at
    most two rows per chunk.
    """
    part = keys + ["_chunk"]
    line = Window.partitionBy(*part).orderBy(order)
    base = rows.select(*keys, order, "op", "off", (F.col("off") + F.col("len")).alias("_end"), chunk.alias("_chunk"),
                       F.expr(condition).alias("_may"))
    # plain columns: a struct would be made, and moved, before the window
    placed = base.withColumns({
        "_n": F.row_number().over(line), **{f"_was_{c}": F.lag(c).over(line) for c in ("op", "_end")},
        **{f"_next_{c}": F.lead(c).over(line) for c in ("op", "off", "_may")}})
    joins = F.expr("_may and op = _was_op and off = _was__end")
    goes_on = F.expr("_next__may and _next_op = op and _next_off = _end")
    ends = placed.select(*part, order, "op", "off", "_end", "_n", (~F.coalesce(joins, F.lit(False))).alias("_new"),
                         (~F.coalesce(goes_on, F.lit(False))).alias("_stop")).filter("_new or _stop")
    # a first row that is not the last one of its run has that one next to it
    to = {f"_to_{c}": F.when(F.col("_stop"), F.col(c)).otherwise(F.lead(c).over(line)) for c in ("_end", "_n")}
    starts = ends.withColumns(to).filter("_new").select(
        *part, order, "op", "off", F.col("_to__end").alias("_end"), (F.col("_to__n") - F.col("_n") + 1).cast("long").alias("merged"))
    local = starts.withColumns({"_first": F.lag(order).over(line).isNull(), "_last": F.lead(order).over(line).isNull()})
    edge = F.expr("_first or _last")
    inner = local.filter(~edge).select(*keys, order, "op", "off", "_end", "merged")

    across = Window.partitionBy(*keys).orderBy(order)
    chained = (local.filter(edge).withColumns({f"_was_{c}": F.lag(c).over(across) for c in ("op", "_end")})
               .withColumn("_new", F.when(F.expr(f"_first and op = _was_op and off = _was__end and {condition}"), 0).otherwise(1))
               .withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))))
    outer = chained.groupBy(*keys, "_run").agg(
        F.min(order).alias(order), F.first("op").alias("op"), F.min("off").alias("off"), F.max("_end").alias("_end"),
        F.sum("merged").alias("merged")).select(*keys, order, "op", "off", "_end", "merged")
    return inner.unionByName(outer).select(*keys, order, "op", "off", (F.col("_end") - F.col("off")).alias("len"), "merged")


def coalesce_ranges(changes: DataFrame, chunk_width: int = ordered.SAFE_GROUP) -> DataFrame:
    """Merge each WRITE into the one right before it when it starts where that one ends.

    Any FREE in between, also an adjacent one, stops the merge, so the order of the two
    kinds is kept. Works in chunks of the log position: a version with most of the changes
    is spread over many tasks.
    """
    return merge_adjacent(changes, ["dataset", "ord"], "seq", ordered.int_chunk("seq", chunk_width), "op = 'WRITE'")


def ranges_to_cells(changes: DataFrame, cell_size: int, spread: bool = False) -> DataFrame:
    """One row per (range, touched cell); ``covered`` = the cell lies fully in the range.

    A long range is enumerated span by span; with ``spread`` the spans are shuffled first,
    so that one range over a whole dataset is not one task's work.
    """
    spans = (changes.withColumn("_first", idiv("off", cell_size))
             .withColumn("_last", idiv(F.col("off") + F.col("len") - 1, cell_size)))
    for width in SPANS:
        spans = (spans.withColumn("_at", F.explode(F.sequence("_first", "_last", F.lit(width).cast("long"))))
                 .withColumn("_last", F.least(F.col("_at") + (width - 1), F.col("_last")))
                 .withColumn("_first", F.col("_at")).drop("_at"))
    if spread:
        spans = spans.repartition("dataset", "ord", "_first")
    at = F.col("cell") * cell_size
    return (spans.withColumn("cell", F.explode(F.sequence("_first", "_last")))
            .withColumn("covered", (at >= F.col("off")) & (at + cell_size <= F.col("off") + F.col("len")))
            .drop("_first", "_last"))


def dedupe_cells(touched: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Keep the last touch (by ``seq``) of every cell of a version.

    An aggregate, not a window: repeated touches shrink before the shuffle.
    """
    cols = cols or [c for c in touched.columns if c not in ("dataset", "ord", "cell")]
    last = touched.groupBy("dataset", "ord", "cell").agg(
        F.max_by(F.struct(*cols), F.col("seq")).alias("_r"))
    return last.select("dataset", "ord", "cell", *[F.col(f"_r.{c}").alias(c) for c in cols])


def split_free(changes: DataFrame, grain: int) -> DataFrame:
    """Split every FREE into whole target cells (``discard``) and partial edges (``zero``).

    A range that holds no whole cell is zeroed only; empty pieces go.
    """
    end = F.col("off") + F.col("len")
    lo, hi = align_size("off", grain), idiv(end, grain) * F.lit(grain)

    def piece(action, start, stop):
        return F.struct(F.lit(action).alias("action"), start.alias("off"), (stop - start).alias("len"))
    whole = F.array(piece("discard", lo, hi), piece("zero", F.col("off"), lo), piece("zero", hi, end))
    part = F.array(piece("zero", F.col("off"), end))
    return (changes.filter("op = 'FREE'")
            .select("dataset", "ord", "seq", F.explode(F.when(lo < hi, whole).otherwise(part)).alias("p"))
            .select("dataset", "ord", "seq", "p.action", "p.off", "p.len").filter("len > 0"))


def _blocks() -> Column:
    """Aligned blocks that make up the cells ``_lo .. _hi``: whole blocks of the biggest size
    inside, smaller ones towards both ends (at most 126 per smaller size)."""
    def run(first, end):
        return f"if({first} < {end}, sequence({first}, {end} - 1L), cast(array() as array<bigint>))"

    def start(level):
        return f"shiftright(_lo + {(1 << level) - 1}L, {level})"

    def stop(level):
        return f"shiftright(_hi + 1L, {level})"
    parts = []
    for level, bigger in zip(BLOCK_LEVELS, BLOCK_LEVELS[1:] + (None,)):
        a, b = start(level), stop(level)
        blocks = run(a, b)
        if bigger is not None:
            step = bigger - level
            inner_a, inner_b = f"({start(bigger)} << {step})", f"({stop(bigger)} << {step})"
            ends = f"concat({run(a, inner_a)}, {run(inner_b, b)})"
            blocks = f"if({start(bigger)} < {stop(bigger)}, {ends}, {blocks})"
        parts.append(f"transform({blocks}, x -> struct({level} as _level, x as _block))")
    return F.expr(f"concat({', '.join(parts)})")


def cells_in_ranges(ranges: DataFrame, cells: DataFrame, cell_size: int) -> DataFrame:
    """Match byte ranges with existing cells without enumerating the cells of a range.

    A range becomes aligned blocks of a few sizes, a cell names the block of each size it lies
    in, and both meet in an equi join in which every pair is a true match. A block holds at
    most 2^18 cells, which bounds the rows under one join key. ``cells`` should be narrow.
    Rows: all columns of both sides, and ``covered``.
    """
    r = (ranges.withColumn("_lo", idiv("off", cell_size))
               .withColumn("_hi", idiv(F.col("off") + F.col("len") - 1, cell_size))
               .select(*ranges.columns, F.inline(_blocks())))
    ups = ", ".join(f"struct({n} as _level, shiftright(cell, {n}) as _block)" for n in BLOCK_LEVELS)
    c = possible(cells.select("*", F.expr(f"inline(array({ups}))")), r, ["dataset", "_level", "_block"])
    at = F.col("cell") * cell_size
    # Spark takes the blocks for as small as the ranges they are made of, and would send them whole through the driver
    return (c.join(r.hint("merge"), ["dataset", "_level", "_block"])
            .withColumn("covered", (at >= F.col("off")) & (at + cell_size <= F.col("off") + F.col("len")))
            .drop("_level", "_block"))


def _edges(frees: DataFrame, cell_size: int) -> DataFrame:
    """The cells that a free reaches into without covering them: two at most."""
    lo, hi = idiv("off", cell_size), idiv(F.col("off") + F.col("len") - 1, cell_size)
    left = F.when(F.col("off") > lo * cell_size, lo)
    right = F.when(F.col("off") + F.col("len") < (hi + 1) * cell_size, hi)
    return frees.select("dataset", "ord", "seq", F.explode(F.array_distinct(F.array_compact(F.array(left, right)))).alias("cell"))


def enumerated_touches(changes: DataFrame, cell_size: int, spread: bool = True) -> DataFrame:
    """The touches that are listed cell by cell, ``(dataset, ord, cell, seq, op, covered)``: those of writes (the last one
    per version and cell), and the edges of frees."""
    writes = ranges_to_cells(changes.filter("op = 'WRITE'"), cell_size, spread).groupBy("dataset", "ord", "cell").agg(
        F.max("seq").alias("seq"))
    return (writes.withColumn("op", F.lit("WRITE"))
            .unionByName(_edges(changes.filter("op = 'FREE'"), cell_size).withColumn("op", F.lit("FREE")))
            .withColumn("covered", F.lit(False)))


def free_blocks(changes: DataFrame, cell_size: int) -> DataFrame:
    """Aligned blocks of the cells that frees cover whole: ``(dataset, ord, seq, _level, _block)``."""
    whole = (changes.filter("op = 'FREE'").withColumn("_lo", idiv(F.col("off") + (cell_size - 1), cell_size))
             .withColumn("_hi", idiv(F.col("off") + F.col("len"), cell_size) - 1).filter("_lo <= _hi"))
    return whole.select("dataset", F.col("ord").cast("int").alias("ord"), "seq", F.inline(_blocks()))


def ended_touches(live: DataFrame, blocks: DataFrame, chunk: Column | None) -> DataFrame:
    """For each touch ``(dataset, cell, ord, seq)`` the first free after it that covers its cell, as a row
    ``(dataset, ord, cell, seq, op, covered, of_ord, of_seq)``, the last two naming the touch. ``blocks`` come from
    ``free_blocks`` and should be written."""
    ups = ", ".join(f"struct({n} as _level, shiftright(cell, {n}) as _block)" for n in BLOCK_LEVELS)
    line = ["dataset", "_level", "_block"]
    # a touch that no free answers is left out at the end; most are before they are shuffled
    asked = possible(live.select("*", F.expr(f"inline(array({ups}))")), blocks, line)
    both = (asked.withColumn("_free", F.lit(None).cast("struct<ord:int,seq:bigint>"))
            .unionByName(blocks.withColumn("_free", F.struct("ord", "seq")), allowMissingColumns=True)
            .withColumn("_at", F.struct((-F.col("ord")).alias("o"), (-F.col("seq")).alias("s"))))
    # time runs backwards, and so do the chunks
    answered = ordered.carry_forward(both, line, "_at", ["_free"], None if chunk is None else -chunk)
    return (answered.filter("cell is not null and _free is not null")
            .groupBy("dataset", "cell", "ord", "seq").agg(F.min("_free").alias("_free"))
            .select("dataset", F.col("_free.ord").alias("ord"), "cell", F.col("_free.seq").alias("seq"),
                    F.lit("FREE").alias("op"), F.lit(True).alias("covered"), F.col("ord").alias("of_ord"), F.col("seq").alias("of_seq")))


def resolve_touches(changes: DataFrame, cell_size: int, chunk: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """The last touch of every cell in every version: ``(dataset, ord, cell, seq, op, covered)``.

    Writes are enumerated, their bytes are read anyway; so are the two edges of a free. A free over whole
    cells is not: it ends the life of cells, and each touch asks for the first free after it that covers
    its cell. The free becomes aligned blocks of a few sizes, a touch names its block of each size, and on the line of a block, from
    the last version back to the first, the free seen last is the answer. So the rows are the touches and
    at most one free for each of them, whatever number of frees reaches a cell; a free over holes leaves none.

    ``known`` = (dataset, cell, ord): cells that are live at ``ord`` already. ``chunk`` cuts long lines
    (``ordered.history_chunk``).
    """
    touches = enumerated_touches(changes, cell_size)
    live = touches.select("dataset", "cell", "ord", "seq")
    if known is not None:
        live = live.unionByName(known.select("dataset", "cell", "ord", F.lit(-1).cast("long").alias("seq")))
    # written: read twice, and small enough to be broadcast unless the log is mostly frees
    blocks = materialise(free_blocks(changes, cell_size), "free-blocks")
    ended = ended_touches(live, blocks, chunk).drop("of_ord", "of_seq")
    return dedupe_cells(touches.unionByName(ended), ["seq", "op", "covered"])
