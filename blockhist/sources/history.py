"""Stored cell history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def write_history(history: DataFrame, path: str, cell_size: int, mode: str = "error",
                  folders: bool = True) -> None:
    """Write a sparse cell history (``payload`` NULL = tombstone), one folder per dataset.

    With very many small datasets use ``folders=False``: they then share files. Rows are spread by
    (dataset, cell range) first: a dataset that holds most of the rows is written by many tasks, a small one by one task, and files come out sorted so that row
    groups can be skipped by cell and version.
    """
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (history.select("dataset", "ord", "cell", "payload")
           .withColumn("cell_size", F.lit(cell_size).cast("long"))
           .repartitionByRange(n, "dataset", "cell", "ord")
           .sortWithinPartitions("dataset", "cell", "ord").write.mode(mode))
    (out.partitionBy("dataset") if folders else out).parquet(path)


def write_bucketed(history: DataFrame, table: str, buckets: int, mode: str = "error", location: str | None = None) -> None:
    """Save a history as a table in ``buckets`` buckets by (dataset, cell), sorted by cell and version.

    States, differences and joins by cell of such a table need no exchange. A dataset is spread over all buckets, whatever its share
    of the rows; choose their number so that one fits in the memory of a task. Rows are brought together by
    bucket first, so that each bucket is one file.
    """
    out = (history.select("dataset", "ord", "cell", "payload").repartition(buckets, "dataset", "cell")
           .write.mode(mode).bucketBy(buckets, "dataset", "cell").sortBy("dataset", "cell", "ord"))
    (out.option("path", location) if location else out).saveAsTable(table)


def read_history(spark: SparkSession, path: str, cell_size: int) -> DataFrame:
    """Read a history; a stored cell size other than ``cell_size`` is an error."""
    df = spark.read.schema("ord INT, cell BIGINT, payload BINARY, cell_size BIGINT, dataset STRING").parquet(path)
    # checked once, by a filter that the statistics of the files answer; the columns stay bare, so
    # that filters on them reach the scan
    other = df.filter(~F.col("cell_size").eqNullSafe(F.lit(cell_size))).select("cell_size").first()
    if other is not None:
        raise ValueError(f"history has cell size {other[0]}, not {cell_size}")
    return df.select(*[f.name for f in schemas.CELL_VERSIONS])
