"""Shared-folder helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where the driver is the only machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="blockhist-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_folder(spark)}/blockhist/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later branches see the same rows
    even when executors are lost and tasks are run again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


#: Rows of a written table that a join may send through the driver.
FEW = 1 << 17


def listed(table: DataFrame) -> DataFrame:
    """A written table of narrow rows as a side of a join: it is broadcast only if it has few rows.

    Spark takes a table for as small as its files, in which keys that follow each other take a few bytes a row;
    in a broadcast, which is built on the driver, they take a hundred and more.
    """
    return table if table.count() <= FEW else table.hint("merge")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned; nothing may read them, or what was derived from them, again."""
    for table in tables:
        delete_folder(table.sparkSession, table.scratch_folder)
