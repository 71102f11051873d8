"""Verified publishing of a rebuilt table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def promote(spark: SparkSession, new: str, table: str, backup: str, renamer=rename) -> None:
    """original -> backup, new -> original. If the second step fails the first is undone,
    so that the table never stays without its name.

    Tables with an explicit location only change their catalog entry; no data moves.
    """
    if spark.catalog.tableExists(backup):
        raise ValueError(f"{backup} already exists")
    renamer(spark, table, backup)
    try:
        renamer(spark, new, table)
    except Exception as failure:
        try:
            renamer(spark, backup, table)
        except Exception as second:
            raise RuntimeError(f"{new} could not take the name {table}, and the way back failed: the "
                               f"original is now {backup}; rename both by hand") from second
        raise failure


def publish_verified(spark: SparkSession, new: str, table: str, report: DataFrame | None,
                     backup_suffix: str = "_old", no_swap: bool = False, keep_backup: bool = True,
                     dry_run: bool = False, datasets: DataFrame | None = None) -> str:
    """Give ``new`` the name ``table`` if the comparison ``report`` has only ``same`` rows.

    An empty report proves nothing and is refused; with ``datasets`` (dataset) given, every one of
    them must have a row.

    Returns what was done: ``published``, ``left`` (``no_swap``) or ``planned`` (``dry_run``).
    A failed comparison raises before anything is renamed. ``report=None`` skips the check.
    """
    backup = table + backup_suffix
    if dry_run:
        return "planned"
    if report is not None:
        if report.isEmpty():
            raise ValueError("the comparison is empty: nothing has been verified")
        if datasets is not None:
            absent = datasets.select("dataset").distinct().join(report.select("dataset"), "dataset", "left_anti")
            names = [r["dataset"] for r in absent.limit(8).collect()]
            if names:
                raise ValueError("not compared: " + ", ".join(names))
        bad = report.filter("status <> 'same'").limit(8).collect()
        if bad:
            raise ValueError("comparison failed: " + ", ".join(
                f"{r['dataset']}@{r['snap']} {r['status']} at {r['first_diff']}" for r in bad))
    if no_swap:
        return "left"
    promote(spark, new, table, backup)
    if not keep_backup:
        spark.sql(f"DROP TABLE {backup}")
    return "published"
