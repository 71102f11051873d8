"""Version catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ordered

#: above this many versions of one dataset the numbering is cut into range chunks
PLAIN_LIMIT = 1 << 20


def version_catalog(df: DataFrame, order: tuple[str, ...] = ("created", "version_id"),
                    chunked: bool | None = None) -> DataFrame:
    """Number the versions of every dataset in creation order (``ord`` starts at 1).

    The tie-break by ``version_id`` makes the order total. A dataset too large for one task
    is numbered through range chunks; ``chunked`` forces either way.
    """
    keys = ["dataset"]
    if chunked is None:
        chunked = ordered.largest_group(df, keys) > PLAIN_LIMIT
    chunk = None
    if chunked:
        df = ordered.range_chunks(df, keys, list(order))
        chunk = "_chunk"
    out = ordered.row_numbers(df, keys, list(order), "ord", chunk)
    return out.withColumn("ord", F.col("ord").cast("int")).drop("_chunk")


def require_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets that have no version at all (must be empty before any work starts)."""
    return datasets.select("dataset").distinct().join(versions.select("dataset").distinct(),
                                                      "dataset", "left_anti")
