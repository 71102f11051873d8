"""Column names that cannot clash with the caller's, and a column made by Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def with_struct(df: DataFrame, wish: str, column: str, kind: pa.StructType, start: Callable,
                carry: list[str] | None = None) -> DataFrame:
    """``df`` with a struct column made from ``column``.

    ``start()`` runs once in each task and gives a function from an Arrow array to the arrays of the
    struct's fields. ``carry`` names the columns that are returned beside it (default: all).
    """
    out = free_name(df, wish)
    carry = df.columns if carry is None else carry
    extra = free_name(df, "in")

    def run(batches):
        judge = start()
        for batch in batches:
            made = pa.StructArray.from_arrays(judge(batch.column(len(carry))), fields=list(kind))
            yield pa.record_batch([*batch.columns[:len(carry)], made], names=[*batch.schema.names[:len(carry)], out])
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField(out, from_arrow_type(kind))])
    return df.select(*carry, df[column].alias(extra)).mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of about ``size`` for what runs meanwhile: wide rows would else fill 64 MiB at a time,
    several times over in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
