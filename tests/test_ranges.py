"""Ranges against enumerated cells; log order in coalescing."""

import random

import pytest
from pyspark.sql import functions as F

from blockhist.operators import changes as C, ranges as R

CH = "dataset string, ord int, seq bigint, op string, off bigint, len bigint"


def df(spark, rows):
    return spark.createDataFrame(rows, CH)


def test_cells_in_ranges_of_all_sizes(spark):
    rnd = random.Random(4)
    top = 1 << 32
    ranges = []
    for i in range(60):
        lo = rnd.randrange(top)
        n = 1 << rnd.randrange(31)
        ranges.append(("d", 1, i, "FREE", lo * 16 + rnd.randrange(16), rnd.randrange(1, n + 1) * 16 + rnd.randrange(16)))
    ranges.append(("d", 1, 99, "FREE", 0, top * 16))
    cells = {rnd.randrange(top) for _ in range(150)}
    for _, _, _, _, off, n in ranges:       # borders are where mistakes would be
        for c in (off // 16, (off + n - 1) // 16):
            cells |= {max(c - 1, 0), c, c + 1}
    cdf = spark.createDataFrame([("d", c) for c in sorted(cells)], "dataset string, cell bigint")
    got = sorted((r["seq"], r["cell"], r["covered"]) for r in R.cells_in_ranges(df(spark, ranges), cdf, 16).collect())
    want = sorted((s, c, c * 16 >= off and (c + 1) * 16 <= off + n) for _, _, s, _, off, n in ranges for c in cells
                  if off // 16 <= c <= (off + n - 1) // 16)
    assert got == want


def test_few_blocks_per_range(spark):
    one = df(spark, [("d", 1, 1, "FREE", 12345, (1 << 24) * 16)]).withColumn("_lo", F.expr("off div 16")).withColumn(
        "_hi", F.expr("(off + len - 1) div 16"))
    assert one.select(F.size(R._blocks())).first()[0] <= 3 * 126 + (1 << 6)


def test_enumerated_cells(spark):
    rows = [("d", 1, 1, "WRITE", 100, 1), ("d", 1, 2, "WRITE", 64, 128), ("d", 1, 3, "FREE", 8, 64 * 10000)]
    for spread in (False, True):
        got = sorted((r["seq"], r["cell"], r["covered"]) for r in R.ranges_to_cells(df(spark, rows), 64, spread).collect())
        want = sorted((s, c, c * 64 >= off and (c + 1) * 64 <= off + n) for _, _, s, _, off, n in rows
                      for c in range(off // 64, (off + n - 1) // 64 + 1))
        assert got == want


def test_last_touch_wins(spark):
    rows = [("d", 1, 1, "FREE", 0, 64), ("d", 1, 2, "WRITE", 0, 64), ("d", 1, 3, "WRITE", 64, 64), ("d", 1, 4, "FREE", 64, 64)]
    got = R.dedupe_cells(R.ranges_to_cells(df(spark, rows), 64), ["seq", "op", "covered"]).collect()
    assert {(r["cell"], r["op"]) for r in got} == {(0, "WRITE"), (1, "FREE")}


@pytest.mark.parametrize("width", [1, 3, 65536])
def test_coalesce_in_log_order(spark, width):
    rows = [("WRITE", 0, 8), ("WRITE", 8, 8), ("WRITE", 16, 4), ("FREE", 20, 4), ("WRITE", 20, 4), ("WRITE", 24, 4),
            ("WRITE", 0, 8), ("FREE", 8, 8), ("FREE", 16, 8), ("WRITE", 40, 8), ("WRITE", 49, 8)]
    data = [("d", 1, i, *r) for i, r in enumerate(rows)]
    got = sorted((r["seq"], r["op"], r["off"], r["len"], r["merged"])
                 for r in R.coalesce_ranges(df(spark, data), chunk_width=width).collect())
    assert got == [(0, "WRITE", 0, 20, 3), (3, "FREE", 20, 4, 1), (4, "WRITE", 20, 8, 2), (6, "WRITE", 0, 8, 1),
                   (7, "FREE", 8, 8, 1), (8, "FREE", 16, 8, 1), (9, "WRITE", 40, 8, 1), (10, "WRITE", 49, 8, 1)]


def test_split_free(spark):
    rows = [("d", 1, 1, "FREE", 100, 1000), ("d", 1, 2, "FREE", 128, 256), ("d", 1, 3, "FREE", 130, 100), ("d", 1, 4, "WRITE", 0, 999)]
    got = sorted((r["seq"], r["action"], r["off"], r["len"]) for r in R.split_free(df(spark, rows), 128).collect())
    assert got == [(1, "discard", 128, 896), (1, "zero", 100, 28), (1, "zero", 1024, 76), (2, "discard", 128, 256),
                   (3, "zero", 130, 100)]


def test_stats(spark):
    rows = [("d", 1, 1, "WRITE", 0, 10), ("d", 1, 2, "FREE", 0, 4), ("d", 2, 1, "WRITE", 0, 7)]
    stats = C.change_stats(df(spark, rows))
    assert sorted(map(tuple, stats.collect())) == [("d", 1, 10, 4, 1, 1), ("d", 2, 7, 0, 1, 0)]
    assert tuple(C.total_stats(stats).first()) == ("d", 17, 4, 2, 1)
