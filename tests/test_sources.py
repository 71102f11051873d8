"""Logs, fingerprint texts, histories on disk."""

import random

import pytest

from blockhist.operators import changes as C, history as H
from blockhist.sources import catalog, change_log, fingerprints as fp, history, image_files, images

LOG = """BEGIN record
    hdrtype = 1
  toguid = 77 = 8
OBJECT object = 1 type = 23 bonustype = 0
FREEOBJECTS firstobj = 3 numobjs = 29
WRITE object = 1 type = 23 offset = 4096 logical_size = 8192 length = 100
WRITE_EMBEDDED object = 1 offset = 512 lsize = 64 length = 9
WRITE_BYREF object = 1 offset = 0 length = 512
FREE object = 1 offset = 16384 length = -1
FREE object = 2 offset = 0 length = -1
WRITE object = 1 offset = 5 offset = 6 length = 7

END checksum = 0/0/0/0
SUMMARY:
    Total DRR_BEGIN records = 1
Total write size = 5"""
WANT = [("WRITE", 4096, 8192), ("WRITE", 512, 64), ("WRITE", 0, 512), ("FREE", 16384, -1), ("WRITE", 6, 7)]


def lines_df(spark, text):
    rows = [("d", 1, i, t) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "dataset string, ord int, seq bigint, line string")


def test_log_records(spark):
    rec = change_log.parse_lines(lines_df(spark, LOG))
    got = C.classify_changes(rec).orderBy("seq").collect()
    assert [(r["op"], r["off"], r["len"]) for r in got] == WANT
    assert C.quarantine_changes(rec).count() == 0
    assert C.strict_changes(rec).count() == len(WANT)


@pytest.mark.parametrize("line,reason", [
    ("REDACT object = 1", "redacted"), ("SPILL object = 1 length = 5", "unknown keyword"),
    ("OBJECT_RANGE firstobj = 0", "unknown keyword"),
    ("WRITE object = 7 offset = 0 length = 5", "unexpected object"), ("WRITE object = 1 offset = 0", "no length"),
    ("FREE object = 1 offset = 0", "field missing"), ("WRITE object = 1 length = 4", "field missing"),
    ("FREEOBJECTS firstobj = 3 numobjs = 28", "unexpected object range"),
    ("FREEOBJECTS firstobj = 4 numobjs = 28", "unexpected object range"),
    ("FREEOBJECTS firstobj = 9223372036854775807 numobjs = 5", "unexpected object range"),
    ("WRITE object = 1 offset = 0x10 length = 5", "not a number"),
    ("WRITE object = 1 offset = 99999999999999999999 length = 5", "not a number"),
    ("FREE object = one offset = 0 length = 5", "not a number")])
def test_rejects(spark, line, reason):
    rec = change_log.parse_lines(lines_df(spark, line))
    assert [(r["raw"], r["reason"]) for r in C.quarantine_changes(rec).collect()] == [(line, reason)]
    assert C.classify_changes(rec).count() == 0
    with pytest.raises(Exception, match=reason):
        C.strict_changes(rec).collect()


def test_splits_too_fine_for_line_numbers_are_refused(spark, tmp_path):
    with open(tmp_path / "d@3.log", "w") as f:
        for i in range(30000):
            f.write(f"WRITE object = 1 offset = {i} length = 1\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(1 << 18))
        with pytest.raises(Exception, match="raise spark.sql.files.maxPartitionBytes"):
            change_log.read_change_log(spark, str(tmp_path)).select("seq").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # one whole file below the bound is its own last split
    assert change_log.read_change_log(spark, str(tmp_path)).select("seq").distinct().count() == 30000


def test_line_numbers_follow_the_file_across_splits(spark, tmp_path):
    path = tmp_path / "d@3.log"
    n = 90000
    with open(path, "w") as f:
        for i in range(n):
            f.write(f"WRITE object = 1 offset = {i} length = {1 + i % 7}{' ' * (i % 90)}\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(1 << 20))
        rec = change_log.read_change_log(spark, str(tmp_path))
        assert rec.rdd.getNumPartitions() > 3
        got = C.classify_changes(rec).orderBy("seq").select("dataset", "ord", "off").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["off"] for r in got] == list(range(n))
    assert {(r["dataset"], r["ord"]) for r in got} == {("d", 3)}


def test_clamp(spark):
    rows = [("d", 1, 1, "WRITE", 0, 50), ("d", 1, 2, "WRITE", 90, 50), ("d", 1, 3, "FREE", 40, -1), ("d", 1, 4, "FREE", 100, 5),
            ("d", 1, 5, "FREE", 7, 0), ("d", 1, 6, "FREE", 10, 9223372036854775807)]
    ch = spark.createDataFrame(rows, "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    v = spark.createDataFrame([("d", 1, 100)], "dataset string, ord int, size bigint")
    got = {r["seq"]: r["len"] for r in C.clamp_ranges(ch, v).collect()}
    assert got == {1: 50, 2: 10, 3: 60, 6: 90}


def test_fingerprint_text_checks(spark):
    head = ["# x fingerprint v1", "# cellsize 512"]
    ok = "s0 1024 " + "ab" * 32 + " 18446744073709551615"
    files = {"good": head + ["", ok, "s0 1024 " + "cd" * 32 + " 7"], "no_header": ["# cellsize 512", ok],
             "no_size": [head[0], ok], "zero_size": [head[0], "# cellsize 0", ok], "empty": head,
             "bad_rows": head + [ok, "s1 12 zz 5", "s2 1 2", "s3 -5 abcd 1", "s4 5 abcd 99999999999999999999"]}
    rows = [(d, i, t) for d, ls in files.items() for i, t in enumerate(ls)]
    df = spark.createDataFrame(rows, "dataset string, line_no bigint, line string")
    good, bad = fp.import_text(df)
    got = {(r["dataset"], r["snap"]): (r["size"], bytes(r["acc"]).hex(), int(r["version_id"]), r["cell_size"])
           for r in good.collect()}
    assert got == {("good", "s0"): (1024, "cd" * 32, 7, 512),        # of equal names the last wins
                   ("bad_rows", "s0"): (1024, "ab" * 32, 18446744073709551615, 512)}
    reasons = sorted((r["dataset"], r["reason"]) for r in bad.collect())
    assert reasons == [("bad_rows", "id is not a number"), ("bad_rows", "not four fields"),
                       ("bad_rows", "size is not a number"), ("bad_rows", "state is not hex"),
                       ("empty", "no entries"), ("no_header", "no header"), ("no_size", "no cell size"),
                       ("zero_size", "no cell size")]


def test_history_of_another_grain_is_refused(spark, tmp_path):
    h = spark.createDataFrame([("a@b", 1, 0, b"x"), ("a@b", 2, 0, None)], "dataset string, ord int, cell bigint, payload binary")
    for name, folders in (("h", True), ("flat", False)):
        history.write_history(h, str(tmp_path / name), 64, folders=folders)
        assert sorted(map(tuple, history.read_history(spark, str(tmp_path / name), 64).collect()), key=str) == sorted(
            map(tuple, h.collect()), key=str)
    with pytest.raises(Exception, match="cell size 64"):
        history.read_history(spark, str(tmp_path / "h"), 128).collect()


def test_to_cells(spark):
    df = spark.createDataFrame([("a", b"12345"), ("b", None), ("c", b""), ("d", bytes(9)), ("e", bytes(4) + b"x")], "k string, b binary")
    got = {(r["k"], r["cell"]): bytes(r["payload"]) for r in images.to_cells(df, ["k"], "b", 4).collect()}
    assert got == {("a", 0): b"1234", ("a", 1): b"5\0\0\0", ("e", 1): b"x\0\0\0"}


def test_catalog_order_and_missing(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else "cold", f"s{i}", rnd.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "dataset string, snap string, created int, version_id bigint")
    want = {}
    for name in ("hot", "cold"):
        for n, r in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[3]))):
            want[r[1]] = n + 1
    for chunked in (None, True):
        assert {r["snap"]: r["ord"] for r in catalog.version_catalog(df, chunked=chunked).collect()} == want
    all_ = spark.createDataFrame([("hot",), ("cold",), ("none",)], "dataset string")
    assert [r[0] for r in catalog.require_versions(all_, df).collect()] == ["none"]


def test_image_files_in_splits(spark, tmp_path):
    """Several splits per file, a tail shorter than a cell, holes, an empty image, odd names; the same as the images as rows."""
    rnd = random.Random(3)
    data = {("d", 1): rnd.randbytes(100_003), ("d", 2): bytes(50_000) + rnd.randbytes(7) + bytes(3 << 20) + b"end", ("a@b/c", 11): b"x",
            ("empty", 1): b"", ("zero", 3): bytes(4096)}
    rows = spark.createDataFrame([(n, o, b) for (n, o), b in data.items()], "dataset string, ord int, bytes binary")
    cells = images.to_cells(rows, ["dataset", "ord"], "bytes", 512)
    versions = spark.createDataFrame([(n, o, len(b)) for (n, o), b in data.items()], "dataset string, ord int, size long")
    path = str(tmp_path / "images")
    image_files.write_images(cells, versions, path, 512)
    files = {f.name: f for f in (tmp_path / "images").iterdir()}
    assert set(files) == {"d@1.img", "d@2.img", "a%40b%2Fc@11.img", "empty@1.img", "zero@3.img"}
    assert all(files[f"{n}@{o}.img".replace("a@b/c", "a%40b%2Fc")].read_bytes() == b for (n, o), b in data.items())
    assert files["d@2.img"].stat().st_blocks * 512 < 1 << 20          # holes take no room
    want = sorted((r.dataset, r.ord, r.cell, bytes(r.payload)) for r in cells.collect())
    for split in (512, 5000, 1 << 27):
        back = image_files.read_images(spark, path, 512, split)
        assert sorted((r.dataset, r.ord, r.cell, bytes(r.payload)) for r in back.collect()) == want
    assert image_files.read_images(spark, path, 512, 5000).rdd.getNumPartitions() > 600
    assert {r.dataset for r in image_files.read_images(spark, path, 512, files="d@*").collect()} == {"d"}
    big = image_files.read_images(spark, path, 4096, 8192)
    assert sorted((r.dataset, r.ord, r.cell, bytes(r.payload)) for r in big.collect()) == sorted(
        (r.dataset, r.ord, r.cell, bytes(r.payload)) for r in images.to_cells(rows, ["dataset", "ord"], "bytes", 4096).collect())


def test_image_above_two_gib(spark, tmp_path):
    """A sparse file of 3 GiB: only its data is read."""
    with open(tmp_path / "big@1.img", "wb") as f:
        f.seek(3 << 30)
        f.write(b"tail")
        f.seek(5000)
        f.write(b"head")
    rows = image_files.read_images(spark, str(tmp_path), 4096).collect()
    assert [(r.cell, bytes(r.payload).rstrip(b"\0")) for r in sorted(rows, key=lambda r: r.cell)] == [(1, bytes(904) + b"head"), ((3 << 30) // 4096, b"tail")]
    assert image_files.read_images(spark, str(tmp_path), 4096).rdd.getNumPartitions() == 25


def test_image_names_are_versions(spark, tmp_path):
    (tmp_path / "noversion.img").write_bytes(b"x")
    with pytest.raises(Exception, match="not an image of a version"):
        image_files.read_images(spark, str(tmp_path), 512).collect()


def test_a_bucketed_history_is_not_exchanged(spark, tmp_path):
    rows = [("d", o, c, f"{o}/{c}".encode() if (o + c) % 4 else None) for o in range(6) for c in range(40) if (o * c) % 3 < 2]
    flat = spark.createDataFrame(rows, "dataset string, ord int, cell bigint, payload binary")
    history.write_bucketed(flat, "bucketed_history", 4, location=str(tmp_path / "h"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = H.as_of(spark.table("bucketed_history"), 4)
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortAggregate" not in plan and "max_by" not in plan
        delta = H.delta_between(spark.table("bucketed_history"), 2, 4)
        assert "Exchange" not in delta._jdf.queryExecution().executedPlan().toString()
        got = {(r["cell"], bytes(r["payload"])) for r in state.collect()}
        changed = {(r["cell"], r["op"]) for r in delta.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("drop table bucketed_history")
    assert got == {(r["cell"], bytes(r["payload"])) for r in H.as_of(flat, 4).collect()}
    at = [{c: p for _, o, c, p in rows if o <= v} for v in (2, 4)]
    assert got == {(c, p) for c, p in at[1].items() if p is not None}
    assert changed == {(c, "WRITE" if p else "FREE") for c, p in at[1].items() if p != at[0].get(c)}
