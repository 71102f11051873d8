"""A filter of a fixed size in front of a join: most rows without a partner are not shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 2^24 bits are 2^18 words of 64, the most rows a filter has, whatever the number of keys.
BITS = 1 << 24


def possible(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "left_semi", bits: int = BITS) -> DataFrame:
    """The rows whose ``keys`` may be among those of ``found``, or, with ``how`` "left_anti", the others: none of these
    has a partner in ``found``, some of the first may have none either.

    The keys set bits of a table of ``bits`` bits, which every task gets: rows stay where they are. Of n keys about
    n / ``bits`` of the rows without a partner pass. ``found`` should be written.
    """
    kinds = {k: rows.schema[k].dataType for k in keys}

    def place() -> Column:
        # the hash depends on the type
        return F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys]).bitwiseAND(bits - 1)
    set_bits = found.select(place().alias("_place")).select(
        F.shiftright("_place", 6).alias("_word"), F.expr("shiftleft(1L, cast(_place & 63 as int))").alias("_bit"))
    words = set_bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    same = F.shiftright(place(), 6) == F.col("_word")
    is_set = F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place().bitwiseAND(63).cast("int"))) != 0
    return rows.join(F.broadcast(words), same & is_set, how)
