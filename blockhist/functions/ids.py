"""Version ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cells import col


def derived_id(version_id) -> Column:
    """Deterministic id: the first 8 bytes (big-endian) of sha-256 over the 8 little-endian
    bytes of the given id; 0 becomes 1. Full unsigned range, as DECIMAL(20,0)."""
    big_endian = F.lpad(F.conv(col(version_id).cast("string"), 10, 16), 16, "0")
    little = F.concat(*[F.substring(big_endian, 15 - 2 * i, 2) for i in range(8)])
    head = F.substring(F.sha2(F.unhex(little), 256), 1, 16)
    number = F.conv(head, 16, 10).cast("decimal(20,0)")
    return F.when(number == 0, F.lit(1).cast("decimal(20,0)")).otherwise(number)
