"""Batches that run again, versions split over batches, late changes."""

import pytest

from blockhist.operators import fingerprint as FP, history as H
from blockhist.session import scratch_path
from blockhist.streaming import apply, fingerprint

CH = "dataset string, ord int, seq bigint, op string, off bigint, len bigint"
CELL = "dataset string, ord int, cell bigint, payload binary"


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([("d", o, c, f"{o}/{c}".encode()) for o in (1, 2, 3) for c in range(8)], CELL)


def run(spark, images, batches, path):
    for number, rows in batches:
        apply.apply_batch(spark.createDataFrame(rows, CH), number, images, path, 8)
    return {(r["ord"], r["cell"]): None if r["payload"] is None else bytes(r["payload"]).decode()
            for r in apply.applied_history(spark, path).collect()}


def test_apply(spark, images):
    path = scratch_path(spark, "apply")
    first = [("d", 1, 1, "WRITE", 0, 32)]
    second = [("d", 2, 1, "FREE", 8, 12), ("d", 2, 2, "WRITE", 40, 8)]
    third = [("d", 2, 3, "WRITE", 8, 8), ("d", 1, 9, "WRITE", 56, 8)]
    want = {(1, c): f"1/{c}" for c in range(4)} | {(2, 1): "2/1", (2, 2): "2/2", (2, 5): "2/5"}
    # the middle batch runs twice, the last holds the rest of version 2 and a late change
    got = run(spark, images, [(0, first), (1, second), (1, second), (2, third), (2, third)], path)
    assert got == want
    late = spark.read.parquet(f"{path}/late")
    assert [(r["ord"], r["seq"]) for r in late.collect()] == [(1, 9)]


def test_fingerprints_carried_over_batches(spark):
    rows = [("d", 1, 0, b"a"), ("d", 1, 1, b"b"), ("d", 3, 0, b"c"), ("d", 4, 1, None), ("e", 1, 0, b"z"), ("e", 4, 0, b"y")]
    versions = spark.createDataFrame([(n, f"s{o}", o, 100, o * 10) for n in "de" for o in (1, 2, 3, 4, 5)],
                                     "dataset string, snap string, ord int, size bigint, version_id bigint")
    versions = versions.withColumn("version_id", versions.version_id.cast("decimal(20,0)"))
    path = scratch_path(spark, "fp")
    def batch(*ords):
        return spark.createDataFrame([r for r in rows if r[1] in ords], CELL)
    for number, ords in [(0, (1,)), (1, (3,)), (1, (3,)), (2, (4,))]:
        fingerprint.fingerprint_batch(batch(*ords), number, versions, path)
    late = spark.createDataFrame([("d", 2, 5, b"late")], CELL)
    fingerprint.fingerprint_batch(late, 3, versions, path)
    fingerprint.finish_fingerprints(spark, versions, path)
    got = {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in fingerprint.stored_fingerprints(spark, path).collect()}
    whole = FP.fingerprint_history(spark.createDataFrame(rows, CELL), versions).filter("ord <= 4")
    assert got == {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in whole.collect()}
    assert spark.read.parquet(f"{path}/late").count() == 1


def test_a_version_split_over_batches(spark):
    rows = [("d", 1, 0, b"a"), ("d", 2, 0, b"b"), ("d", 2, 1, b"c"), ("d", 3, 0, b"d"), ("e", 2, 0, b"z"), ("e", 2, 5, b"y")]
    versions = spark.createDataFrame([(n, f"s{o}", o, 100, o * 10) for n in "de" for o in (1, 2, 3)],
                                     "dataset string, snap string, ord int, size bigint, version_id bigint")
    versions = versions.withColumn("version_id", versions.version_id.cast("decimal(20,0)"))
    path = scratch_path(spark, "fp")
    for number, part in [(0, rows[:2] + rows[4:5]), (1, rows[2:3]), (1, rows[2:3]), (2, rows[3:4] + rows[5:])]:
        fingerprint.fingerprint_batch(spark.createDataFrame(part, CELL), number, versions, path)
    fingerprint.finish_fingerprints(spark, versions, path)
    got = {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in fingerprint.stored_fingerprints(spark, path).collect()}
    whole = FP.fingerprint_history(spark.createDataFrame(rows, CELL), versions).filter("dataset = 'd' or ord <= 2")
    assert got == {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in whole.collect()}
    assert spark.read.parquet(f"{path}/late").count() == 0


def test_shrinks_cut_the_applied_history(spark):
    images = spark.createDataFrame([("d", 1, c, f"{c}".encode() * 8) for c in range(8)] + [("d", 3, 0, b"n" * 8)], CELL)
    versions = spark.createDataFrame([("d", 1, 64), ("d", 2, 20), ("d", 3, 64)], "dataset string, ord int, size bigint")
    path = scratch_path(spark, "apply")
    for number, part in enumerate([[("d", 1, 1, "WRITE", 0, 64)], [("d", 3, 1, "WRITE", 0, 8)]]):
        apply.apply_batch(spark.createDataFrame(part, CH), number, images, path, 8)
    rows = apply.applied_history(spark, path, versions, 8)
    live = {r["cell"]: bytes(r["payload"]) for r in H.as_of(rows, 3).collect()}
    assert live == {0: b"n" * 8, 1: b"1" * 8, 2: b"2222" + bytes(4)}


def damaged(path, *numbers):
    """Make the files of earlier batches unreadable."""
    import glob
    for n in numbers:
        for f in glob.glob(f"{path}/batch={n}/*.parquet"):
            with open(f, "wb") as out:
                out.write(b"not a table")


def test_a_batch_reads_nothing_of_earlier_ones(spark, images):
    """Tables of finished batches are damaged before the next batch runs; restored, they are read as one history."""
    import shutil
    path, saved = scratch_path(spark, "apply"), scratch_path(spark, "saved")
    batches = [[("d", 1, 1, "WRITE", 0, 64)], [("d", 2, 1, "FREE", 0, 40)], [("d", 2, 2, "WRITE", 8, 8), ("d", 3, 1, "FREE", 0, 64)]]
    for n, rows in enumerate(batches):
        if n:
            damaged(f"{path}/cells", n - 1)
            damaged(f"{path}/frees", n - 1)
        apply.apply_batch(spark.createDataFrame(rows, CH), n, images, path, 8)
        for table in ("cells", "frees"):
            shutil.copytree(f"{path}/{table}/batch={n}", f"{saved}/{table}/batch={n}")
    got = {(r["ord"], r["cell"]): r["payload"] and bytes(r["payload"]).decode() for r in apply.applied_history(spark, saved).collect()}
    assert got == {(1, c): f"1/{c}" for c in range(8)} | {(2, c): None for c in (0, 2, 3, 4)} | {(2, 1): "2/1"} | {(3, c): None for c in (1, 5, 6, 7)}


def test_rows_of_the_state_do_not_grow_with_batches(spark):
    from blockhist.streaming.state import KeyedState, batch_numbers
    versions = spark.createDataFrame([("d", f"s{o}", o, 100, o) for o in range(1, 12)], "dataset string, snap string, ord int, size bigint, version_id bigint")
    path = scratch_path(spark, "fp")
    seen = []
    for n in range(8):
        rows = spark.createDataFrame([("d", n + 1, c, f"{n}/{c}".encode()) for c in range(20)], CELL)
        heads, seeds = fingerprint._states(spark, path, 16, 64)
        seen.append(heads.read(n).count() + seeds.read(n).count())
        fingerprint.fingerprint_batch(rows, n, versions, path)
    assert seen == [0] + [21] * 7
    assert len(batch_numbers(spark, f"{path}/seeds/rows")) <= 2 and len(batch_numbers(spark, f"{path}/heads/owners")) <= 3
    state = KeyedState(spark, scratch_path(spark, "state"), "k STRING, v INT", ["k"], 4)
    for n in range(5):
        rows = spark.createDataFrame([(f"k{n % 3}", n)], "k string, v int")
        touched = state.touched(rows)
        old = state.read(n, touched)
        state.write(old.join(rows.select("k"), "k", "left_anti").unionByName(rows), n, touched)
    assert sorted(map(tuple, state.read(5).collect())) == [("k0", 3), ("k1", 4), ("k2", 2)]
    assert sorted(map(tuple, state.read(4).collect())) == [("k0", 3), ("k1", 1), ("k2", 2)]    # as a run of batch 4 after a failure sees it


def test_compacted_history_goes_on(spark, images):
    path = scratch_path(spark, "apply")
    batches = [[("d", 1, 1, "WRITE", 0, 64)], [("d", 2, 9, "FREE", 0, 32)], [("d", 2, 7, "WRITE", 8, 8), ("d", 2, 10, "WRITE", 0, 8)], [("d", 3, 1, "FREE", 0, 64)]]
    plain = scratch_path(spark, "apply")
    for n, rows in enumerate(batches):
        apply.apply_batch(spark.createDataFrame(rows, CH), n, images, plain, 8)
        apply.apply_batch(spark.createDataFrame(rows, CH), n, images, path, 8)
        apply.compact(spark, path)
    def rows_of(p):
        return sorted((r["ord"], r["cell"], r["payload"] and bytes(r["payload"])) for r in apply.applied_history(spark, p).collect())
    assert rows_of(path) == rows_of(plain)
    assert [r for r in rows_of(plain) if r[0] == 2] == [(2, 0, b"2/0"), (2, 1, None), (2, 2, None), (2, 3, None)]


def test_progress_is_the_same_however_batches_are_cut(spark):
    import datetime as dt
    from blockhist.operators.progress import throughput
    from blockhist.streaming import progress
    t0 = dt.datetime(2024, 1, 1)
    at = lambda rows: [(n, t0 + dt.timedelta(seconds=s), b) for n, s, b in rows]
    schema = "dataset string, ts timestamp, bytes bigint"
    rows = [("d", 0, 100), ("d", 5, 50), ("d", 5, 50), ("d", 10, 10), ("d", 11, 20), ("d", 30, 5), ("e", 3, 7), ("e", 40, 9)]
    totals = spark.createDataFrame([("d", 300)], "dataset string, total bigint")
    path = scratch_path(spark, "progress")
    # the second batch runs twice, an instant of d lies in two batches, e has nothing in the middle ones
    for number, part in [(0, rows[:2] + rows[6:7]), (1, rows[2:4]), (1, rows[2:4]), (2, rows[4:5]), (3, rows[5:6] + rows[7:] + [("d", 9, 1000)])]:
        progress.progress_batch(spark.createDataFrame(at(part), schema), number, path, 10, totals, 4)
    progress.finish_progress(spark, path, 10, totals, 4)
    got = sorted(tuple(r) for r in progress.stored_progress(spark, path).collect())
    assert got == sorted(tuple(r) for r in throughput(spark.createDataFrame(at(rows), schema), totals, 10).collect())
    assert [r["bytes"] for r in spark.read.parquet(f"{path}/late").collect()] == [1000]


def test_the_state_of_progress_holds_one_span(spark):
    import datetime as dt
    from blockhist.streaming import progress
    path, seen = scratch_path(spark, "progress"), []
    for n in range(5):
        rows = [("d", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n * 20 + i), 1) for i in range(20)]
        progress.progress_batch(spark.createDataFrame(rows, "dataset string, ts timestamp, bytes bigint"), n, path, 5, None, 4)
        seen.append(progress._states(spark, path, 4)[1].read(n + 1).count())
    assert seen == [6] * 5
    done = [r["done"] for r in progress.stored_progress(spark, path, False).orderBy("micros").collect()]
    assert done == list(range(1, 100))
