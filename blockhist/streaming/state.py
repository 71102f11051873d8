"""State of a stream as a keyed table that is rewritten bucket by bucket.

Rows are dealt to a fixed number of buckets by a hash of their key. A batch reads the buckets that its
keys lie in and writes those buckets anew, into a folder of its own; a list of owners says which batch holds the
current content of each bucket. So a batch reads and writes what its keys' buckets hold, however many batches
came before, and a batch that runs again starts from the owners before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import delete_folder

OWNERS = "bucket INT, owner BIGINT"


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """The batches with a folder ``batch=<n>`` under ``path``, one listing, no rows read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


@dataclass
class KeyedState:
    """``schema`` of the rows, ``keys`` that decide the bucket, number of ``buckets``."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def owners(self, before: int) -> dict[int, int]:
        """Which batch holds each bucket, as of the last batch before ``before``: at most ``buckets`` rows."""
        earlier = [n for n in batch_numbers(self.spark, f"{self.path}/owners") if n < before]
        if not earlier:
            return {}
        rows = self.spark.read.schema(OWNERS).parquet(f"{self.path}/owners/batch={earlier[-1]}").collect()
        return {r["bucket"]: r["owner"] for r in rows}

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def read(self, before: int, touched: list[int] | None = None) -> DataFrame:
        """The rows of the ``touched`` buckets (all of them, if None) as the batches before ``before`` left them."""
        owners = self.owners(before)
        folders = [f"{self.path}/rows/batch={owner}/_bucket={b}" for b, owner in owners.items()
                   if touched is None or b in touched]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, batch: int, touched: list[int]) -> None:
        """Make ``rows`` the content of the ``touched`` buckets from ``batch`` on.

        The owners are written last: until then the batch has not happened. Folders that no list of owners from the batch
        before on names are deleted; the one before may be wanted again, by a run of ``batch`` after a failure.
        """
        owners = self.owners(batch)
        (rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
         .write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/rows/batch={batch}"))
        held = {r for r in self._filled(batch)}
        new = {**{b: o for b, o in owners.items() if b not in touched}, **{b: batch for b in touched if b in held}}
        (self.spark.createDataFrame([(b, o) for b, o in new.items()], OWNERS).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/owners/batch={batch}"))
        wanted = {*new.values(), *owners.values(), batch}
        for n in batch_numbers(self.spark, f"{self.path}/rows"):
            if n < batch and n not in wanted:
                delete_folder(self.spark, f"{self.path}/rows/batch={n}")
        for n in batch_numbers(self.spark, f"{self.path}/owners")[:-2]:
            if n < batch - 1:
                delete_folder(self.spark, f"{self.path}/owners/batch={n}")

    def _filled(self, batch: int) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/batch={batch}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return [int(n.split("=")[1]) for n in names if n.startswith("_bucket=")]
