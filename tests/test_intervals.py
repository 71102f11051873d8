"""Which touch of a cell counts, over versions: against a replay cell by cell; the number of rows; writes taken back."""

import random

import pytest
from pyspark.sql import functions as F

from blockhist.operators import changes as C, ranges as R
from blockhist.plans import replay
from blockhist.functions import ordered

CH = "dataset string, ord int, seq bigint, op string, off bigint, len bigint"
V = "dataset string, ord int, size bigint"


def random_log(seed, versions=9, cells=40, grain=16, unit=4):
    rnd = random.Random(seed)
    rows = []
    for v in range(1, versions + 1):
        for s in range(rnd.randint(0, 9)):
            off = rnd.randrange(cells * grain // unit) * unit
            n = min(rnd.choice([unit, grain, 3 * grain, 20 * grain]), cells * grain - off)
            rows.append(("d", v, s, rnd.choice(["WRITE", "FREE"]), off, n))
    return rows


def touched(rows, grain):
    """Cells with bytes written last by a WRITE, or partly freed, are touched; fully freed ones that were touched since
    their last end become holes."""
    alive, out = set(), {}
    for _, v, s, op, off, n in sorted(rows, key=lambda r: (r[1], r[2])):
        for c in range(off // grain, (off + n - 1) // grain + 1):
            covered = c * grain >= off and (c + 1) * grain <= off + n
            if op == "WRITE" or not covered:
                alive.add(c)
                out[(v, c)] = (s, op, False)
            elif c in alive:
                alive.discard(c)
                out[(v, c)] = (s, op, True)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_last_touch_of_every_cell(spark, seed, monkeypatch):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, CH)
    for chunk in (None, ordered.int_chunk("ord", 3)):
        got = {(r.ord, r.cell): (r.seq, r.op, r.covered and r.op == "FREE") for r in R.resolve_touches(df, 16, chunk).collect()}
        assert got == touched(rows, 16)


def test_rows_follow_real_changes(spark):
    """1,000 cells, 200 frees over all of them: each cell ends once."""
    rows = [("d", 1, i, "WRITE", i * 16, 16) for i in range(1000)] + [("d", 2 + i, 0, "FREE", 0, 16 * (1 << 30)) for i in range(200)]
    out = R.resolve_touches(spark.createDataFrame(rows, CH), 16)
    assert {(r.ord, r.op): r["count"] for r in out.groupBy("ord", "op").count().collect()} == {(1, "WRITE"): 1000, (2, "FREE"): 1000}


def test_no_row_of_the_plan_is_a_pair(spark):
    """Rows that meet on a line are the touches once per block size and the blocks of the frees, not their product."""
    rows = [("d", 1, i, "WRITE", i * 16, 16) for i in range(1000)] + [("d", 2 + i, 0, "FREE", 0, 16 * 4096) for i in range(200)]
    frees = spark.createDataFrame(rows, CH).filter("op = 'FREE'").withColumn("_lo", F.lit(0).cast("long")).withColumn("_hi", F.lit(4095).cast("long"))
    assert frees.select(F.inline(R._blocks())).count() == 200


def test_frees_on_known_cells(spark):
    rows = [("d", 5, 0, "FREE", 0, 64), ("d", 6, 0, "FREE", 0, 640)]
    known = spark.createDataFrame([("d", 1, 4), ("d", 20, 4), ("e", 1, 4), ("d", 50, 4)], "dataset string, cell bigint, ord int")
    out = R.resolve_touches(spark.createDataFrame(rows, CH), 16, known=known)
    assert sorted((r.ord, r.cell) for r in out.collect()) == [(5, 1), (6, 20)]


def lost(rows, sizes):
    """Bytes past the end that some write set and no later free of the version cleared, by writing all of them down."""
    out = set()
    for _, v, s, op, off, n in rows:
        if op == "WRITE" and n != 0:
            size = sizes.get(v)
            if size is None:
                out.add((v, s))
                continue
            left = set(range(max(off, size), off + n)) if n > 0 else set()
            for _, w, t, o, foff, fn in rows:
                if w == v and o == "FREE" and t > s:
                    left -= {b for b in left if b >= foff and (fn < 0 or b < foff + fn)}
            if left:
                out.add((v, s))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_what_later_frees_leave_of_a_write(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "PAGE", 16)
    rnd = random.Random(seed)
    rows = []
    for v in range(1, 25):
        for s in range(rnd.randint(1, 8)):
            off, n = rnd.randrange(100), rnd.choice([0, 1, 5, 30, 60])
            op = rnd.choice(["WRITE", "FREE", "FREE"])
            rows.append(("d", v, s, op, off, -1 if op == "FREE" and rnd.random() < .2 else n))
    sizes = {v: rnd.randrange(20, 110) for v in range(1, 24)}
    df = spark.createDataFrame(rows, CH)
    got = {(r.ord, r.seq) for r in C.lost_writes(df, spark.createDataFrame([("d", v, n) for v, n in sizes.items()], V)).collect()}
    want = lost(rows, sizes)
    assert got == want and len(want) > 5
    assert {(r.ord, r.seq) for r in C.writes_past_end(df, spark.createDataFrame([("d", v, n) for v, n in sizes.items()], V)).collect()} > got


def test_a_write_taken_back_is_no_error(spark):
    """The log of a version that grew, was written and shrank again."""
    images = spark.createDataFrame([("d", 1, 0, bytearray(b"a" * 16)), ("d", 2, 0, bytearray(b"a" * 16)), ("d", 2, 1, bytearray(b"b" * 16))],
                                   "dataset string, ord int, cell long, payload binary")
    v = spark.createDataFrame([("d", 1, 64), ("d", 2, 32)], V)
    log = [("d", 1, 1, "WRITE", 0, 16), ("d", 2, 1, "WRITE", 16, 16), ("d", 2, 2, "WRITE", 40, 8)]
    taken = spark.createDataFrame(log + [("d", 2, 3, "FREE", 32, -1)], CH)
    rows = replay.replay(images, taken, v, 16, 16).collect()
    assert sorted((r.ord, r.cell, bytes(r.payload)) for r in rows) == [(1, 0, b"a" * 16), (2, 1, b"b" * 16)]
    for late in ([], [("d", 2, 3, "FREE", 44, -1)], [("d", 2, 0, "FREE", 32, -1)], [("d", 1, 3, "FREE", 32, -1)]):
        with pytest.raises(ValueError, match="starts past the end"):
            replay.replay(images, spark.createDataFrame(log + late, CH), v, 16, 16)
    in_pieces = [("d", 2, 4, "FREE", 40, 4), ("d", 2, 3, "FREE", 44, 4)]
    assert replay.replay(images, spark.createDataFrame(log + in_pieces, CH), v, 16, 16).count() == 2
