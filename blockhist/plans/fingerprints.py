"""Fingerprints as a job that can be interrupted, and verification of a file made at another cell size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lanes as L
from ..operators.fingerprint import SQL, WY, covered_prefix, extend_fingerprints, extend_wy_fingerprints, fingerprint_history, verify_fingerprints
from ..operators.regrain import regrain_history
from ..session import delete_folder, materialise
from ..streaming.state import batch_numbers

ROWS = "dataset STRING, snap STRING, ord INT, size BIGINT, version_id DECIMAL(20,0), cell_size BIGINT, lanes INT, algo STRING, acc BINARY"


def finished_rows(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of the rounds that were finished: those with a marker."""
    done = batch_numbers(spark, f"{path}/done")
    folders = [f"{path}/rows/batch={n}" for n in batch_numbers(spark, f"{path}/rows") if n in done]
    return spark.read.schema(ROWS).parquet(*folders) if folders else spark.createDataFrame([], ROWS)


def fingerprint_job(spark: SparkSession, history: DataFrame, versions: DataFrame, path: str, grain: int,
                    cell_size: int | None = None, lanes: int = L.LANES, algo: str = SQL, at_once: int = 64) -> DataFrame:
    """Fingerprints of all ``versions`` (dataset, snap, ord, size, version_id), persisted in rounds of ``at_once`` versions.

    ``history`` is kept at ``grain`` and re-cut to ``cell_size`` if that is another one. A round is written to a
    folder of its own and counts when its marker exists, which is written after it; a job that starts again
    goes on after the last marked round. What was stored is kept as far as names, ids and sizes agree
    and redone from there on.
    """
    cell_size = cell_size or grain
    lanes = 1024 if algo == WY else lanes
    versions = materialise(versions.select("dataset", "snap", "ord", "size", F.col("version_id").cast("decimal(20,0)").alias("version_id")), "versions")
    first, last = versions.agg(F.min("ord"), F.max("ord")).first()
    if last is None:
        return spark.createDataFrame([], ROWS)
    if cell_size != grain:
        history = materialise(regrain_history(history, versions, grain, cell_size), "recut")
    bases = covered_prefix(finished_rows(spark, path), versions)
    # where every dataset is covered up to here, or as far as it goes
    safe = bases.agg(F.min(F.when(F.expr("base = last"), F.lit(last)).otherwise(F.coalesce("base", F.lit(first - 1))))).first()[0]
    rounds = batch_numbers(spark, f"{path}/done")
    start = max([n for n in rounds if n <= safe], default=first - 1)
    for n in batch_numbers(spark, f"{path}/rows"):
        if n > start:                       # not finished, or no longer true; the marker goes first
            delete_folder(spark, f"{path}/done/batch={n}")
            delete_folder(spark, f"{path}/rows/batch={n}")
    for low in range(start, last, at_once):
        high = min(low + at_once, last)
        known, upto = finished_rows(spark, path).filter(F.col("ord") <= low), versions.filter(F.col("ord") <= high)
        part = history.filter(F.col("ord") <= high)
        rows = (extend_wy_fingerprints(known, part, upto, cell_size) if algo == WY
                else extend_fingerprints(known, part, upto, lanes, cell_size))
        _write_round(rows.filter(F.col("ord") > low).select(
            "dataset", "snap", "ord", "size", "version_id", F.lit(cell_size).cast("long").alias("cell_size"),
            F.lit(lanes).alias("lanes"), F.lit(algo).alias("algo"), "acc"), path, high)
    return finished_rows(spark, path).filter(F.col("ord") <= last)


def _write_round(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    rows.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")


def verify_stored(stored: DataFrame, history: DataFrame, versions: DataFrame, grain: int) -> DataFrame:
    """Status of stored fingerprints (dataset, snap, size, version_id, cell_size, acc [, lanes, algo]) against a history kept at
    ``grain``: the history is re-cut to the cell size the fingerprints were made at, for each such size."""
    made = [c for c in ("lanes", "algo") if c in stored.columns]
    ways = stored.select("cell_size", *made).distinct().collect()      # one row per way of making, not per version
    out = None
    for way in ways:
        cell, lanes, algo = way["cell_size"], (way["lanes"] if "lanes" in made else L.LANES), (way["algo"] if "algo" in made else SQL)
        mine = stored
        for c in ("cell_size", *made):
            mine = mine.filter(F.col(c) == way[c])
        asked = versions.join(mine.select("dataset").distinct(), "dataset", "left_semi")
        cut = history if cell == grain else materialise(regrain_history(history, versions, grain, cell), "recut")
        actual = fingerprint_history(cut, asked, lanes, cell, algo).withColumn("cell_size", F.lit(cell).cast("long"))
        status = verify_fingerprints(mine, actual)
        out = status if out is None else out.unionByName(status)
    if out is None:
        raise ValueError("no stored fingerprints to verify")
    return out
