"""What a rebuild would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.changes import change_stats
from ..operators.history import chain_versions, with_new_sizes


def plan(versions: DataFrame, changes: DataFrame, grain: int, checks: DataFrame | None = None,
         start: DataFrame | None = None) -> DataFrame:
    """Planned steps, one per version, with sizes and estimated bytes; nothing is written.

    ``checks`` (a pre-flight report) blocks the steps of datasets with a failed rule;
    ``start`` = (dataset, start) leaves out the versions before a resume point.
    """
    steps = with_new_sizes(chain_versions(versions), grain)
    estimate = change_stats(changes).select("dataset", "ord", F.col("written").alias("estimate"))
    out = steps.join(estimate, ["dataset", "ord"], "left").withColumn(
        "estimate", F.coalesce("estimate", F.lit(0).cast("long")))
    if start is not None:
        out = out.join(start, "dataset", "left").filter("start is null or ord >= start").drop("start")
    blocked = F.lit(False)
    if checks is not None:
        bad = checks.filter("not ok").select("dataset").distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, "dataset", "left")
        blocked = F.coalesce("_bad", F.lit(False))
    return out.select("dataset", "ord", "snap", "prev_snap", "step", "size", "new_size", "cells", "estimate",
                      blocked.alias("blocked"))
