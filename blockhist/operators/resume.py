"""Continuing an interrupted rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import short_name
from .history import referenced, written_since


def resume_point(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve ``wanted`` = (dataset, resume_from), spelled ``ds@s``, ``@s`` or ``s``.

    Returns (dataset, start): ``start`` is the version's ord, NULL if the source has none of
    that name.
    """
    w = wanted.select("dataset", short_name("resume_from").alias("snap"))
    return w.join(source.select("dataset", "snap", F.col("ord").alias("start")), ["dataset", "snap"], "left").select(
        "dataset", "snap", "start")


def resume_plan(source: DataFrame, target: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of each source version: ``done``, ``todo``, ``missing`` (an earlier version is
    not in the target) or ``unknown`` (no such version to resume from).

    A dataset can be resumed when it has no ``missing`` and no ``unknown`` rows. Resuming
    from the first version is a full run.
    """
    point = resume_point(source, wanted)
    have = target.select("dataset", "snap", F.lit(True).alias("_have"))
    rows = (source.select("dataset", "snap", "ord").join(point.select("dataset", "start"), "dataset")
            .filter("start is not null").join(have, ["dataset", "snap"], "left"))
    status = (F.when(F.col("ord") >= F.col("start"), "todo")
               .when(F.col("_have").isNull(), "missing").otherwise("done"))
    known = rows.select("dataset", "snap", "ord", status.alias("status"))
    lost = point.filter("start is null").select("dataset", "snap", F.lit(None).cast("int").alias("ord"),
                                                F.lit("unknown").alias("status"))
    return known.unionByName(lost)


def resume_bases(plan: DataFrame) -> DataFrame:
    """The version a resume builds on: the newest ``done`` one (dataset, snap, ord)."""
    return (plan.filter("status = 'done'").groupBy("dataset")
            .agg(F.max("ord").alias("ord"), F.max_by("snap", "ord").alias("snap")).select("dataset", "snap", "ord"))


def base_report(bases: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Bytes referenced by the resume base on both sides.

    ``bases`` = (dataset, snap, ord_source, ord_target); the histories are cell histories.
    """
    left = referenced(source, bases.select("dataset", F.col("ord_source").alias("at")))
    right = referenced(target, bases.select("dataset", F.col("ord_target").alias("at")))
    zero = F.lit(0).cast("long")
    return (bases.select("dataset", "snap")
            .join(left.withColumnRenamed("referenced", "source_bytes"), "dataset", "left")
            .join(right.withColumnRenamed("referenced", "target_bytes"), "dataset", "left")
            .select("dataset", "snap", F.coalesce("source_bytes", zero).alias("source_bytes"),
                    F.coalesce("target_bytes", zero).alias("target_bytes")))


def diverged(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Bytes written after the newest version, per dataset that has a head row.

    ``versions`` holds the named versions and, with ``is_head``, the live state.
    """
    o = F.col("ord")
    points = versions.groupBy("dataset").agg(
        F.max(F.when(~F.col("is_head"), o)).alias("base"), F.max(F.when(F.col("is_head"), o)).alias("head"))
    return written_since(history, points.filter("head is not null"))
