"""Skew-proof ordered steps against plain windows, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from blockhist.functions import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    seqs = rnd.sample(range(100000), 900)
    data = [("hot" if i < 600 else f"k{i % 40}", s, rnd.randrange(100), None if rnd.random() < 0.5 else s)
            for i, s in enumerate(seqs)]
    return spark.createDataFrame(data, "k string, seq bigint, x bigint, y bigint").repartition(7)


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)


def forms(df):
    """The chunk columns to try: fixed width, and a range shuffle."""
    yield df, ordered.int_chunk("seq", 1000)
    yield df, ordered.int_chunk("seq", 1)
    yield ordered.range_chunks(df, ["k"], ["seq"], pieces=9), "_chunk"


def test_row_numbers(rows):
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("seq")))
    for df, chunk in forms(rows):
        same(ordered.row_numbers(df, ["k"], ["seq"], "n", chunk).drop("_chunk"), want)


def test_running_sums(rows):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("s", F.sum("x").over(w)).withColumn("c", F.sum(F.lit(1)).over(w))
    for df, chunk in forms(rows):
        same(ordered.running_sums(df, ["k"], ["seq"], {"s": "x", "c": F.lit(1)}, chunk).drop("_chunk"), want)


def test_previous_and_descending(rows):
    want = rows.withColumn("p", F.lag("x").over(Window.partitionBy("k").orderBy("seq")))
    for df, chunk in forms(rows):
        same(ordered.previous(df, ["k"], "seq", {"p": "x"}, chunk).drop("_chunk"), want)
    back = rows.withColumn("b", -F.col("seq"))
    want = back.withColumn("p", F.lead("x").over(Window.partitionBy("k").orderBy("seq")))
    same(ordered.previous(back, ["k"], "b", {"p": "x"}, -ordered.int_chunk("seq", 500)), want)


def test_carry_forward(rows):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("y", F.last("y", ignorenulls=True).over(w))
    for df, chunk in forms(rows):
        same(ordered.carry_forward(df, ["k"], "seq", ["y"], chunk).drop("_chunk"), want)


def test_range_chunks_split_a_hot_key(rows):
    cut = ordered.range_chunks(rows, ["k"], ["seq"], pieces=9)
    sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 300 and sum(sizes) == 900


def test_largest_group(rows):
    assert ordered.largest_group(rows, ["k"]) == 600
    assert ordered.largest_group(rows.filter("false"), ["k"]) == 0
