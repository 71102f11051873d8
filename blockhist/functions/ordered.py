"""Ordered operations that never put a whole key into one task.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here every key is cut into
*chunks* that follow the order of the rows. The work inside a chunk is an ordinary window over
``(keys, chunk)``; what crosses chunk borders travels through one row per ``(keys, chunk)``.

A chunk column is either ``ord div width`` (order column is an integer) or comes from
``range_chunks`` (any order, any skew, cut by a range shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .cells import idiv

#: largest number of narrow rows that an ordinary window may receive per key
SAFE_GROUP = 1 << 16
#: width of a chunk of the version spine; its rows carry whole accumulators
SPINE_CHUNK = 1 << 10


def int_chunk(order_col: str, width: int = SAFE_GROUP) -> Column:
    return idiv(F.col(order_col).cast("long"), width)


def range_chunks(df: DataFrame, keys: list[str], order: list[str], chunk: str = "_chunk",
                 pieces: int | None = None) -> DataFrame:
    """Add a chunk column by a range shuffle on ``keys + order``.

    The range bounds are sampled, so the result is written once: all branches that read
    the chunk number must agree on it. ``order`` must be (nearly) unique inside a key,
    because equal values stay together.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = (df.repartitionByRange(n, *keys, *order)
             .withColumn(chunk, F.spark_partition_id().cast("long")))
    return materialise(cut, "chunks")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key; a count with map-side combine, one number to the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def history_chunk(versions: DataFrame) -> Column | None:
    """Chunk expression for tables with at most one row per (key, ord).

    Such a group has at most ``max(ord) + 1`` rows; below ``SAFE_GROUP`` a plain window is
    safe and ``None`` is returned.
    """
    row = versions.agg(F.max("ord")).first()
    return None if (row[0] or 0) < SAFE_GROUP else int_chunk("ord")


def _with_chunk(df: DataFrame, chunk) -> tuple[DataFrame, str, bool]:
    if isinstance(chunk, str):
        return df, chunk, False
    return df.withColumn("_chunk", chunk), "_chunk", True


def row_numbers(df: DataFrame, keys: list[str], order: list, out: str, chunk=None) -> DataFrame:
    """1-based position of each row inside its key."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w))
    df, c, drop = _with_chunk(df, chunk)
    sizes = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, c, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, c).orderBy(*order)
    res = (df.withColumn(out, F.row_number().over(local))
             .join(offsets, keys + [c])
             .withColumn(out, F.col(out) + F.col("_before")).drop("_before"))
    return res.drop(c) if drop else res


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, str | Column],
                 chunk=None) -> DataFrame:
    """Running totals (current row included). ``sums`` maps new column -> summed expression."""
    args = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(w).alias(k) for k, v in args.items()])
    df, c, drop = _with_chunk(df, chunk)
    base = df.columns
    totals = df.groupBy(*keys, c).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in args.items()])
    earlier = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, c, *[F.sum(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in args])
    local = Window.partitionBy(*keys, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    res = (df.select("*", *[F.sum(v).over(local).alias(f"_l_{k}") for k, v in args.items()])
             .join(before, keys + [c])
             .select(*base, *[(F.coalesce(F.col(f"_b_{k}"), F.lit(0)) + F.col(f"_l_{k}")).alias(k)
                              for k in args]))
    return res.drop(c) if drop else res


def previous(df: DataFrame, keys: list[str], order: str, cols: dict[str, str], chunk=None) -> DataFrame:
    """Add the values of the preceding row of the key. ``cols`` maps new column -> source."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[F.lag(src).over(w).alias(new) for new, src in cols.items()])
    df, c, drop = _with_chunk(df, chunk)
    base = df.columns
    pack = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    last = df.groupBy(*keys, c).agg(F.max_by(pack, F.col(order)).alias("_last"))
    edge = last.select(*keys, c, F.lag("_last").over(Window.partitionBy(*keys).orderBy(c)).alias("_edge"))
    local = Window.partitionBy(*keys, c).orderBy(order)
    res = (df.withColumn("_prev", F.lag(pack).over(local))
             .join(edge, keys + [c], "left")
             .withColumn("_prev", F.coalesce("_prev", "_edge"))
             .select(*base, *[F.col(f"_prev.{new}").alias(new) for new in cols]))
    return res.drop(c) if drop else res


def carry_forward(df: DataFrame, keys: list[str], order: str, cols: list[str], chunk=None) -> DataFrame:
    """Replace NULLs of ``cols`` by the last value before them inside the key."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in cols})
    df, c, drop = _with_chunk(df, chunk)
    base = df.columns
    last = df.groupBy(*keys, c).agg(
        *[F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(order))).alias(f"_l_{x}") for x in cols])
    earlier = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    edge = last.select(*keys, c, *[F.last(f"_l_{x}", ignorenulls=True).over(earlier).alias(f"_e_{x}")
                                   for x in cols])
    local = Window.partitionBy(*keys, c).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    res = (df.withColumns({x: F.last(x, ignorenulls=True).over(local) for x in cols})
             .join(edge, keys + [c], "left")
             .withColumns({x: F.coalesce(F.col(x), F.col(f"_e_{x}")) for x in cols})
             .select(*base))
    return res.drop(c) if drop else res
