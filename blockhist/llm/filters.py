"""A filter of a fixed size over a set of LONG keys: never refuses a key of the set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^24 bits are 2 MiB, sent to every executor once, whatever the number of keys.
BITS = 1 << 24


def key_filter(keys: DataFrame, bits: int = BITS):
    """A function from a LONG column to BOOLEAN: false only for values that are not in the one column
    of ``keys``. At most bits / 64 rows come to the driver."""
    key = F.col(keys.columns[0]).bitwiseAND(bits - 1)
    words = (keys.select(F.shiftright(key, 6).alias("word"), key.bitwiseAND(63).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    table = np.zeros(bits // 64, dtype=np.int64)
    for word, value in words.toLocalIterator():
        table[word] = value
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(x: pd.Series) -> pd.Series:
        at = x.to_numpy() & (bits - 1)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
    udf = F.pandas_udf(may_hold, "boolean")
    return lambda column: udf(column)


