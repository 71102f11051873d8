"""What must never pass: damaged, absent or unknown content, cut writes, tables in the scratch folder."""

import pytest
from pyspark.sql import functions as F

from blockhist.operators import changes, compare, fingerprint, identity, policy, regrain
from blockhist.plans import publish, replay
from blockhist.sources import fingerprints as store, history as stored

CELLS = "dataset string, ord int, cell long, payload binary"
VERSIONS = "dataset string, snap string, ord int, size long, is_head boolean"


def cells(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], CELLS)


def versions(spark, *rows):
    return spark.createDataFrame([("d", *r, False) for r in rows], VERSIONS)


def test_padding_is_no_difference_and_hides_none(spark):
    v = versions(spark, ("s1", 1, 32))
    a = cells(spark, (1, 0, b"abc"), (1, 1, b"x"))
    b = cells(spark, (1, 0, b"abc" + bytes(13)), (1, 1, b"y"))
    r = compare.compare_history(a, v, b, v, 16).first()
    assert (r.status, r.cells_differ, r.first_diff) == ("differs", 1, 16)
    same = compare.compare_history(a, v, cells(spark, (1, 0, b"abc" + bytes(13)), (1, 1, b"x\0")), v, 16).first()
    assert (same.status, same.cells_differ, same.first_diff) == ("same", 0, None)


def test_equal_bytes_past_the_common_size_fail(spark):
    a = cells(spark, (1, 0, b"a" * 16), (1, 1, b"b\0\0"), (2, 1, None))
    long, short = versions(spark, ("s1", 1, 32), ("s2", 2, 32)), versions(spark, ("s1", 1, 16), ("s2", 2, 16))
    got = {r.snap: (r.status, r.first_diff) for r in compare.compare_history(a, long, a, short, 16).collect()}
    assert got == {"s1": ("tail", 16), "s2": ("same", None)}


def test_an_absent_version_cannot_be_verified(spark):
    v, a = versions(spark, ("s1", 1, 16)), cells(spark, (1, 0, b"a"))
    with pytest.raises(Exception, match="not a version of the original"):
        compare.verify_only(a, v, a, v, 16, mode="one", snap="s9").collect()
    with pytest.raises(ValueError):
        compare.verify_only(a, v, a, v, 16, mode="one")


def test_an_empty_report_publishes_nothing(spark):
    report = spark.createDataFrame([], "dataset string, snap string, status string, first_diff long")
    with pytest.raises(ValueError, match="nothing has been verified"):
        publish.publish_verified(spark, "new", "old", report)
    one = spark.createDataFrame([("d", "s1", "same", None)], report.schema)
    with pytest.raises(ValueError, match="not compared: e"):
        publish.publish_verified(spark, "new", "old", one, datasets=spark.createDataFrame([("d",), ("e",)], "dataset string"))


def test_short_payloads_are_full_cells(spark):
    short = spark.createDataFrame([("d", 0, b"abc"), ("d", 1, b"def")], "dataset string, cell long, payload binary")
    big = regrain.regrain(short, ["dataset"], 16, 32).first().payload
    assert bytes(big) == b"abc" + bytes(13) + b"def" + bytes(13)
    small = {r.cell: bytes(r.payload) for r in regrain.regrain(short, ["dataset"], 16, 2).collect()}
    assert small == {0: b"ab", 1: b"c\0", 8: b"de", 9: b"f\0"}
    with pytest.raises(Exception, match="longer than the cell"):
        regrain.regrain(short, ["dataset"], 2, 4).collect()


def test_unknown_content_agrees_with_nothing(spark):
    schema = "dataset string, snap string, ord int, size long, acc binary, version_id long, cell_size long"
    mine = spark.createDataFrame([("d", "s1", 1, 5, None, 1, 16), ("d", "s2", 2, 5, bytearray(b"a"), 2, 16), ("d", "s3", 3, 5, bytearray(b"a"), 3, 16)], schema)
    theirs = spark.createDataFrame([("d", "s1", 1, 5, None, 7, 16), ("d", "s2", 2, 5, bytearray(b"a"), 8, 16), ("d", "s3", 3, 5, bytearray(b"a"), 9, 32)], schema)
    got = {r.snap: r.id_origin for r in identity.align_ids(mine, theirs).collect()}
    assert got == {"s1": "differs", "s2": "reference", "s3": "differs"}
    status = {r.snap: r.status for r in fingerprint.verify_fingerprints(theirs, mine).collect()}
    assert status == {"s1": "DIFFER", "s2": "OK", "s3": "DIFFER"}
    lost = mine.withColumn("version_id", F.lit(None).cast("long"))
    assert identity.resume_conflicts(lost, theirs, mine.limit(0)).count() == 3


def test_accumulators_of_another_make_are_not_continued(spark):
    v = versions(spark, ("s1", 1, 32), ("s2", 2, 32)).withColumn("version_id", F.col("ord").cast("decimal(20,0)"))
    h = cells(spark, (1, 0, b"a" * 16), (2, 1, b"b" * 16))
    base = fingerprint.fingerprint_history(h, v.where("ord = 1")).withColumn("cell_size", F.lit(32).cast("long"))
    with pytest.raises(Exception, match="made in another way"):
        fingerprint.extend_fingerprints(base, h, v, cell_size=16).collect()
    with pytest.raises(Exception, match="made in another way"):
        fingerprint.extend_fingerprints(base, h, v, lanes=32).collect()
    assert fingerprint.extend_fingerprints(base, h, v, cell_size=32).count() == 2


def test_writes_past_the_end(spark):
    ch = spark.createDataFrame([("d", 1, 1, "WRITE", 90, 20), ("d", 1, 2, "WRITE", 100, 1), ("d", 1, 3, "WRITE", 50, -1),
                                ("d", 1, 4, "FREE", 90, 900), ("d", 7, 5, "WRITE", 0, 1)], "dataset string, ord int, seq long, op string, off long, len long")
    v = versions(spark, ("s1", 1, 100))
    got = {r.seq: r.reason for r in changes.writes_past_end(ch, v).collect()}
    assert got == {1: "runs past the end", 2: "starts past the end", 5: "no such version"}
    with pytest.raises(ValueError, match="runs past the end"):
        replay.replay(cells(spark), ch.where("seq = 1"), v, 16, 16, strict=True)


def test_a_head_alone_is_no_version(spark):
    settings = spark.createDataFrame([("d", "on", "t", "b")], "dataset string, readonly string, target string, backup string")
    head = spark.createDataFrame([("d", "head", 1, 16, True)], VERSIONS)
    none = spark.createDataFrame([], "dataset string, written long")
    names = spark.createDataFrame([], "name string")
    rules = {r.rule: r.passed for r in policy.preflight(settings, head, none, names, 512).collect()}
    assert rules["has_versions"] is False


def test_history_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    stored.write_history(cells(spark, (1, 0, b"a"), (2, 0, b"b")), path, 16)
    plan = stored.read_history(spark, path, 16).where("ord > 1")._jdf.queryExecution().toString()
    assert "GreaterThan(ord,1)" in plan
    with pytest.raises(ValueError, match="cell size 16"):
        stored.read_history(spark, path, 32)


def test_a_damaged_file_gives_no_fingerprints(spark):
    lines = [("d", 1, "# blockhist fingerprint v1"), ("d", 2, "# dataset d"), ("d", 3, "# cellsize 16"), ("d", 4, "s1 5 00ff 1"), ("d", 5, "s2 x 00ff 2")]
    df = spark.createDataFrame(lines, "dataset string, line_no long, line string")
    with pytest.raises(ValueError, match="1 bad lines, line 5"):
        store.strict_import(df)
    assert store.strict_import(df.where("line_no < 5")).count() == 1


def test_replay_refuses_writes_past_the_end_by_default(spark):
    images = spark.createDataFrame([("d", 1, 0, bytearray(b"a" * 16))], "dataset string, ord int, cell long, payload binary")
    v = spark.createDataFrame([("d", 1, 16)], "dataset string, ord int, size long")
    bases = spark.createDataFrame([("d", 0)], "dataset string, base int")
    for off, reason in ((16, "starts past the end"), (8, "runs past the end")):
        ch = spark.createDataFrame([("d", 1, 1, "WRITE", off, 16)], "dataset string, ord int, seq long, op string, off long, len long")
        with pytest.raises(ValueError, match=reason):
            replay.replay(images, ch, v, 16, 16)
        with pytest.raises(ValueError, match=reason):
            replay.replay(images, ch, v, 16, 16, target=images.where("false"), bases=bases)


def test_table_fingerprint_sees_every_column(spark):
    from workloads import q_fingerprint as Q
    row = "1L l_orderkey, 1 l_linenumber, 2L l_partkey, 3L l_suppkey, 4.0D l_quantity, 5.25D l_extendedprice, 0.05D l_discount, 0.02D l_tax, 'A' l_returnflag, 'O' l_linestatus, timestamp'2020-01-02' l_shipdate"
    items = spark.sql(f"select {row}")
    change = {"l_partkey": "l_partkey + 1", "l_suppkey": "l_suppkey + 1", "l_quantity": "l_quantity + 1", "l_extendedprice": "l_extendedprice + 0.01D",
              "l_discount": "l_discount + 0.01D", "l_tax": "l_tax + 0.01D", "l_linestatus": "'F'", "l_shipdate": "l_shipdate + interval 1 day"}
    rows = [Q.whole_fingerprint(items).first()] + [Q.whole_fingerprint(items.withColumn(c, F.expr(x))).first() for c, x in change.items()]
    assert len({r["acc"] for r in rows}) == len(change) + 1
