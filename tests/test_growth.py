"""Plans that must not grow faster than their input, and what they return."""

import random
import re

from pyspark.sql import functions as F

from blockhist import session
from blockhist.functions.filters import possible
from blockhist.operators import compare as CMP, history as H, progress, ranges as R
from blockhist.plans import replay
from blockhist.session import materialise
from blockhist.sources import image_files, images as IMG
from tests.model import cells_of
from workloads import q_sources


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_version_each(spark, n):
    return materialise(spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("dataset"), F.lit("s1").alias("snap"), F.lit(False).alias("is_head"), F.lit(1).alias("ord_a"),
        F.lit(1).alias("ord_b"), F.lit(64).cast("long").alias("size_a"), F.lit(64).cast("long").alias("size_b")), "pairs")


def test_versions_meet_spans_without_the_driver(spark):
    pairs = one_version_each(spark, 500)
    spans = spark.createDataFrame([("d7", 3, 1, None, True, 9, 1, 1), ("d8", 2, 0, 1, True, 9, 1, 1), ("d8", 4, 1, 2, True, 5, 1, 1)],
                                  "dataset string, cell bigint, v int, nxt int, differs boolean, last bigint, at_a int, at_b int")
    found = CMP.first_cells(materialise(spans, "spans"), pairs)
    assert not re.search(r"BroadcastHashJoin \[dataset#\d+, level#", plan_of(found))
    assert sorted((r["dataset"], r["cell"]) for r in found.collect()) == [("d7", 3), ("d8", 4)]


def test_history_of_images_moves_each_image_once(spark):
    rnd, rows, want = random.Random(5), [], []
    for name in ("a", "b", "c"):
        image, before = bytes(rnd.randrange(256) for _ in range(70)), {}
        for ord_ in range(1, 9):
            rows.append((name, ord_, image))
            now = cells_of(image, 16)
            want += [(name, ord_, c, now.get(c)) for c in set(now) | set(before) if now.get(c) != before.get(c)]
            before, cut = now, rnd.choice([0, 5, 33, 64, 70, 90])
            image = b"" if cut == 0 else (image + bytes(20))[:cut] if cut != 70 else image[:10] + b"x" + image[11:]
    made = IMG.to_history(spark.createDataFrame(rows, "dataset string, ord int, bytes binary"), "bytes", 16)
    assert plan_of(made).count("Exchange hashpartitioning") == 1
    key = lambda r: (r[0], r[1], r[2])
    got = sorted(((r["dataset"], r["ord"], r["cell"], None if r["payload"] is None else bytes(r["payload"])) for r in made.collect()), key=key)
    assert got == sorted(want, key=key)


def test_log_files_are_written_in_the_order_of_the_log(spark):
    """The writer's own sort by folder takes the place of any other sort below it: the order of lines must be part of it."""
    q_sources.log_files(spark, "/root/testdata/sf0.001", "log")
    last = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    sorts = re.findall(r"^\(\d+\) Sort\b.*\n.*\nArguments: (.*)$", last, re.M)
    assert sorts and all(re.match(r"\[version#\d+ ASC NULLS FIRST, seq#", x) for x in sorts)


def test_image_is_written_by_many_tasks(spark, tmp_path):
    """Pieces of one image lie in several tasks; the file is what one task would write, and a version without cells has one."""
    cells = spark.range(4000).filter("id % 3 > 0").select(
        F.lit("v").alias("dataset"), F.lit(1).alias("ord"), F.col("id").alias("cell"), F.rpad(F.col("id").cast("string").cast("binary"), F.lit(64), F.lit(b"x")).alias("payload"))
    versions = spark.createDataFrame([("v", 1, 3990 * 64 + 5), ("v", 2, 100)], "dataset string, ord int, size bigint")
    image_files.write_images(cells, versions, str(tmp_path), 64, piece=64 * 10)
    want = b"".join(str(i).encode().ljust(64, b"x") if i % 3 else bytes(64) for i in range(4000))[:3990 * 64 + 5]
    assert (tmp_path / "v@1.img").read_bytes() == want and (tmp_path / "v@2.img").read_bytes() == bytes(100)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v@1.img", "v@2.img"]


def test_splits_grow_with_what_there_is_to_read(tmp_path, monkeypatch):
    (tmp_path / "v@1.img").write_bytes(b"x" * 10_000)
    assert len(image_files.splits(str(tmp_path), 16, 16)) == 625
    monkeypatch.setattr(image_files, "MOST_SPLITS", 10)
    few = image_files.splits(str(tmp_path), 16, 16)
    assert len(few) == 11 and sum(s.length for s in few) == 10_000 and all(s.offset % 16 == 0 for s in few)


def test_rows_that_may_have_a_partner(spark):
    """No row with a partner is lost, none goes both ways, and few without a partner pass; types and NULLs may differ."""
    rows = spark.range(20000).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("m"))
    found = rows.filter("k % 100 = 3").select(F.col("k").cast("long").alias("k"), "m")
    some = {r["k"] for r in possible(rows, found, ["k", "m"]).collect()}
    rest = {r["k"] for r in possible(rows, found, ["k", "m"], "left_anti").collect()}
    assert {r["k"] for r in found.collect()} <= some and len(some) < 250 and not some & rest and len(some | rest) == 20000
    full = {r["k"] for r in possible(rows, found, ["k", "m"], bits=64).collect()}
    assert some <= full and len(full) > 15000      # a filter that is too small lets more through, and loses none


def test_an_image_is_shuffled_once_when_it_is_replayed(spark):
    """Cells of an image go through one shuffle at their own grain, whatever the size of the cells they are cut into, and
    images that no touch asks for through none."""
    rnd = random.Random(3)
    image = {(d, o, c): bytes(rnd.choice(b"\0ab") for _ in range(32)) for d in "xy" for o in (1, 2) for c in range(6)}
    images = materialise(spark.createDataFrame([(*k, v) for k, v in image.items()], "dataset string, ord int, cell bigint, payload binary"), "images")
    fine = [("x", 1, c, 1, "WRITE", False) for c in range(3, 30)] + [("x", 2, 5, 2, "FREE", True), ("x", 2, 6, 3, "FREE", False)]
    touched = materialise(spark.createDataFrame(fine, "dataset string, ord int, cell bigint, seq bigint, op string, covered boolean"), "touched")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = replay.overlay_images(touched, images, 32, 8)
        moved = re.findall(r"\bExchange hashpartitioning\(dataset#\d+, ord#\d+, \w+#\d+L", plan_of(made))
        rows = made.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(moved) == 2      # the touches and the image cells
    want = {}
    for d, o, c, _, op, covered in fine:
        whole = image.get((d, o, c // 4))
        part = whole[c % 4 * 8:c % 4 * 8 + 8] if whole and not (op == "FREE" and covered) else None
        want[d, o, c] = part if part and part.strip(b"\0") else None
    assert {(r["dataset"], r["ord"], r["cell"]): None if r["payload"] is None else bytes(r["payload"]) for r in rows} == want


def test_a_resumed_replay_reads_payloads_of_what_goes_on(spark, monkeypatch):
    """Of the target only cells of datasets with a later change or a shrink are read again: a dataset without stays as it is."""
    versions = spark.createDataFrame([(d, o, 8 if d == "shrinks" and o == 2 else 32) for d in ("idle", "moves", "shrinks") for o in (1, 2)],
                                     "dataset string, ord int, size bigint")
    images = spark.createDataFrame([(d, o, c, bytes([65 + o]) * 8) for d in ("idle", "moves", "shrinks") for o in (1, 2) for c in range(4)
                                    if (d, o) == ("moves", 2) or o == 1], "dataset string, ord int, cell bigint, payload binary")
    changes = spark.createDataFrame([(d, 1, 1, "WRITE", 0, 32) for d in ("idle", "moves", "shrinks")] + [("moves", 2, 2, "WRITE", 8, 8)],
                                    "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    whole = materialise(replay.replay(images, changes, versions, 8, 8), "whole")
    bases = spark.createDataFrame([(d, 1) for d in ("idle", "moves", "shrinks")], "dataset string, base int")
    written = {}
    monkeypatch.setattr(replay, "materialise", lambda df, label: written.setdefault(label, materialise(df, label)))
    again = replay.replay(images, changes, versions, 8, 8, target=whole.filter("ord = 1"), bases=bases)
    key = lambda r: (r["dataset"], r["ord"], r["cell"])
    assert sorted(again.collect(), key=key) == sorted(whole.select(*again.columns).collect(), key=key)
    assert sorted({r["dataset"] for r in written["state"].collect()}) == ["moves", "shrinks"]
    assert whole.filter("dataset = 'shrinks' and ord = 2 and payload is null").count() == 3


def test_runs_are_formed_in_one_sort(spark):
    """No aggregate, with a sort of its own, over all rows of a chunk; runs over several chunks come out whole."""
    rnd, rows, at = random.Random(9), [], 0
    for seq in range(300):
        at = at if rnd.random() < 0.8 else at + 8
        rows.append(("d", 1, seq, "FREE" if rnd.random() < 0.1 else "WRITE", at, 8))
        at += 8
    merged = R.coalesce_ranges(spark.createDataFrame(rows, "dataset string, ord int, seq bigint, op string, off bigint, len bigint"), chunk_width=7)
    assert not re.search(r"Aggregate\(key=\[[^\]]*_chunk", plan_of(merged))
    want = []
    for _, _, seq, op, off, n in rows:
        if want and op == "WRITE" == want[-1][1] and want[-1][2] + want[-1][3] == off:
            want[-1] = (*want[-1][:3], want[-1][3] + n, want[-1][4] + 1)
        else:
            want.append((seq, op, off, n, 1))
    assert sorted((r["seq"], r["op"], r["off"], r["len"], r["merged"]) for r in merged.collect()) == want


def test_summed_instants_are_not_grouped_again(spark):
    """A stream hands over one row per instant: it is not shuffled to be summed once more, and gives what its events give."""
    events = spark.range(60).selectExpr("concat('d', id % 2) dataset", "timestamp_seconds(id div 3 * 4) ts", "id * id bytes")
    summed = materialise(events.groupBy("dataset", "ts").agg(F.sum("bytes").alias("bytes")), "ticks")
    made = progress.throughput(summed, None, 10, summed=True)
    assert not re.search(r"Aggregate\(keys?=\[dataset#\d+, ts#", plan_of(made))
    assert sorted(made.collect()) == sorted(progress.throughput(events, None, 10).collect())


def test_blocks_of_ranges_stay_off_the_driver(spark):
    """Ranges become blocks, of which Spark knows no more than the size of the ranges' files."""
    ranges = materialise(spark.range(300).select(F.concat(F.lit("d"), F.col("id") % 50).alias("dataset"), F.col("id").alias("seq"),
                                                 (F.col("id") * 8 + 3).alias("off"), (F.col("id") % 40 + 1).alias("len")), "ranges")
    cells = materialise(spark.range(600).select(F.concat(F.lit("d"), F.col("id") % 50).alias("dataset"), F.col("id").alias("cell")), "cells")
    met = R.cells_in_ranges(ranges, cells, 8)
    assert not re.search(r"BroadcastHashJoin \[dataset#\d+, _level#", plan_of(met))
    want = [(f"d{i % 50}", i, c, c * 8 >= i * 8 + 3 and c * 8 + 8 <= i * 8 + 3 + i % 40 + 1) for i in range(300) for c in range(600)
            if c % 50 == i % 50 and (i * 8 + 3) // 8 <= c <= (i * 8 + 3 + i % 40) // 8]
    assert sorted((r["dataset"], r["seq"], r["cell"], r["covered"]) for r in met.collect()) == sorted(want)


def test_replay_broadcasts_tables_of_few_rows_only(spark, monkeypatch):
    """Versions, cut cells and unchanged cells go through the driver if they are few, whatever the size of their files."""
    names = [f"d{i}" for i in range(50)]
    versions = spark.createDataFrame([(d, o, s) for d in names for o, s in ((1, 64), (2, 20))], "dataset string, ord int, size bigint")
    images = spark.createDataFrame([(d, o, c, b"x" * (4 if (o, c) == (2, 2) else 8)) for d in names for o, n in ((1, 8), (2, 3)) for c in range(n)],
                                   "dataset string, ord int, cell bigint, payload binary")
    changes = spark.createDataFrame([(d, o, o, "WRITE", 0, n) for d in names for o, n in ((1, 64), (2, 8))],
                                    "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    want = sorted((d, o, c, p) for d in names for o, c, p in [(1, c, b"x" * 8) for c in range(8)] + [(2, 2, b"xxxx" + bytes(4))] + [(2, c, b"") for c in range(3, 8)])
    seen = []

    def written(df, label):
        seen.append(plan_of(df))
        return materialise(df, label)
    for module in (replay, H, R):
        monkeypatch.setattr(module, "materialise", written)

    def joined():
        """Keys of broadcast joins, without those of filters."""
        seen.clear()
        made = replay.replay(images, changes, versions, 8, 8)
        assert sorted((r["dataset"], r["ord"], r["cell"], bytes(r["payload"] or b"")) for r in made.collect()) == want
        keys = re.findall(r"BroadcastHashJoin \[(.*?)\], \[(?!_word)", "\n".join([*seen, plan_of(made)]))
        return {re.sub(r"#\d+L?", "", x) for x in keys}
    assert joined() == {"dataset, ord", "dataset, cell, ord", "dataset, ord, cell"}
    monkeypatch.setattr(session, "FEW", 10)
    assert not joined()
