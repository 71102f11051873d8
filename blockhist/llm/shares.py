"""Joins in which no key holds more than a small share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast.
HEAVY = 1 << 12


def join_by_share(rows: DataFrame, found: DataFrame, key: str, weight: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``found`` (key, ..., weight) by ``key``; ``weight`` is the number of rows that key
    has in ``rows``, and goes.

    A key with at least 1 / ``heavy`` of all matching rows, of which there are ``heavy`` at most, is broadcast; the
    others meet their rows in a shuffle. Both parts add up to the whole join. ``found`` is read several
    times, so it should be written; its keys must be distinct.
    """
    total = found.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * heavy >= total
    hot = F.broadcast(found.where(often).drop(weight))
    rest = rows.join(hot.select(key), key, "left_anti").join(found.where(~often).drop(weight), key)
    return rows.join(hot, key).unionByName(rest)
