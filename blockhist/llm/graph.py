"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id that can be reached.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    chains shrink by more than half a round. All steps are joins and minima, which combine before the
    shuffle; no neighbourhood is gathered. Repeated links, links in both directions and loops are fine.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        better = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        # hook the old root too, so that whole trees move at once
        hooked = (better.where("new < old").groupBy(F.col("old").alias("root")).agg(F.min("new").alias("to")))
        moved = better.join(hooked, better["new"] == hooked["root"], "left").select(
            "id", F.coalesce("to", "new").alias("label"), "old")
        jumped = moved.alias("x").join(moved.select(F.col("id").alias("at"), F.col("label").alias("next")), F.col("x.label") == F.col("at"), "left")
        after = materialise(jumped.select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "labels")
        labels = after.select("id", "label")
        if after.where("label <> old").isEmpty():
            return labels
