"""Properties, holds, pre-flight, resume, drift, progress, publishing."""

import datetime as dt

import pytest

from blockhist.operators import changes as C, policy, progress, resume
from blockhist.plans import dry_run, publish
from blockhist.session import scratch_path


def test_properties_and_reservations(spark):
    rows = [("d", "compression", "lz4", "local"), ("d", "checksum", "sha256", "received"), ("d", "logbias", "latency", "default"),
            ("d", "user:note", "x", "local"), ("d", "volsize", "5", "local"), ("d", "utf8only", "on", "local"),
            ("d", "refreservation", "1048576", "local"), ("d", "reservation", "4096", "local"), ("e", "refreservation", "none", "local"),
            ("e", "reservation", "0", "local")]
    df = spark.createDataFrame(rows, "dataset string, property string, value string, source string")
    assert {r["property"] for r in policy.carry_properties(df).collect()} == {"compression", "checksum", "user:note"}
    got = {(r["dataset"], r["property"]): r["value"] for r in policy.reservation_rows(df).collect()}
    assert got == {("d", "refreservation"): "auto", ("d", "reservation"): "4096"}
    unset = spark.createDataFrame([("",), ("0",), ("none",), ("-",), (None,), ("1",)], "v string")
    assert [r[0] for r in unset.select(policy.is_set("v")).collect()] == [False] * 5 + [True]


def test_holds(spark):
    h = spark.createDataFrame([("d", "s0", "keep"), ("d", "gone", "keep"), ("d", "s1", "")], "dataset string, snap string, tag string")
    v = spark.createDataFrame([("d", "s0"), ("d", "s1")], "dataset string, snap string")
    assert [tuple(r) for r in policy.copy_holds(h, v).collect()] == [("d", "s0", "keep")]


def test_protection(spark):
    df = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)],
                               "s boolean, p boolean, ok boolean")
    got = {tuple(r)[:3]: r["o"] for r in df.withColumn("o", policy.protection_outcome("s", "p", "ok")).collect()}
    assert got[(True, False, False)] == "refuse" and got[(True, False, True)] == "allowed plain"
    assert got[(True, True, False)] == got[(True, True, True)] == "inherit"
    assert {v for k, v in got.items() if not k[0]} == {"plain"}


def checks(spark, grain=4096, written=0, readonly="on", taken=(), versions=1, **kw):
    d = spark.createDataFrame([("d", readonly, "d-new", "d-old")], "dataset string, readonly string, target string, backup string")
    v = spark.createDataFrame([("d", f"s{i}", i) for i in range(versions)], "dataset string, snap string, ord int")
    w = spark.createDataFrame([("d", written)], "dataset string, written bigint")
    n = spark.createDataFrame([(t,) for t in taken], "name string")
    return {r["rule"]: (r["passed"], r["ok"]) for r in policy.preflight(d, v, w, n, grain, **kw).collect()}


def failed(result, what=1):
    return {k for k, v in result.items() if not v[what]}


def test_preflight(spark):
    assert failed(checks(spark)) == set()
    assert failed(checks(spark, grain=3000)) == failed(checks(spark, grain=256)) == {"grain"}
    assert failed(checks(spark, written=5, readonly="off")) == {"read_only", "head_is_newest"}
    forced = checks(spark, written=5, readonly="off", force=True)
    assert failed(forced) == set() and failed(forced, 0) == {"read_only", "head_is_newest"}
    assert failed(checks(spark, versions=0, force=True)) == {"has_versions"}
    assert failed(checks(spark, taken=["d-new", "d-old"], force=True)) == {"target_free", "backup_free"}
    assert failed(checks(spark, taken=["d-old"], no_swap=True)) == set()
    assert failed(checks(spark, resuming=True)) == {"target_exists"}
    assert failed(checks(spark, resuming=True, taken=["d-new"])) == set()


@pytest.mark.parametrize("spelled", ["pool/d@s2", "@s2", "s2"])
def test_resume(spark, spelled):
    src = spark.createDataFrame([("d", f"s{i}", i + 1) for i in range(4)], "dataset string, snap string, ord int")
    want = spark.createDataFrame([("d", spelled)], "dataset string, resume_from string")
    plan = resume.resume_plan(src, src.filter("ord <= 2"), want)
    assert {r["snap"]: r["status"] for r in plan.collect()} == {"s0": "done", "s1": "done", "s2": "todo", "s3": "todo"}
    assert resume.resume_bases(plan).first()["snap"] == "s1"
    lost = resume.resume_plan(src, src.filter("ord = 2"), want)
    assert {r["snap"] for r in lost.filter("status = 'missing'").collect()} == {"s0"}


def test_resume_from_unknown_and_from_first(spark):
    src = spark.createDataFrame([("d", f"s{i}", i + 1) for i in range(3)], "dataset string, snap string, ord int")
    none = spark.createDataFrame([], src.schema)
    def plan(name):
        want = spark.createDataFrame([("d", name)], "dataset string, resume_from string")
        return [r["status"] for r in resume.resume_plan(src, none, want).collect()]
    assert plan("nope") == ["unknown"]
    assert plan("s0") == ["todo"] * 3


def test_head_that_moved_on(spark):
    h = spark.createDataFrame([("d", 1, 0, b"aaaa"), ("d", 2, 0, b"bbbb"), ("e", 1, 0, b"aaaa"), ("e", 2, 0, b"aaaa")],
                              "dataset string, ord int, cell bigint, payload binary")
    v = spark.createDataFrame([(d, o, o == 2) for d in "de" for o in (1, 2)], "dataset string, ord int, is_head boolean")
    assert {r["dataset"]: r["written"] for r in resume.diverged(h, v).collect()} == {"d": 4, "e": 0}


def test_drift(spark):
    K = 1024
    rows = [("a", 1, 0, 10**9), ("a", 2, 1000 * K, 1100 * K), ("a", 3, 1000 * K, 1129 * K), ("a", 4, 10_000 * K, 10_900 * K),
            ("a", 5, 10_000 * K, 8_000 * K), ("a", 6, 100 * K, 228 * K), ("a", 7, 100 * K, 228 * K + 1)]
    df = spark.createDataFrame(rows, "dataset string, ord int, estimate bigint, written bigint")
    got = {r["ord"]: r["drift"] for r in C.drift_report(df.drop("written"), df.drop("estimate")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True}


def test_dry_run_leaves_out_done_versions(spark):
    v = spark.createDataFrame([("d", "s0", 1, 5000), ("d", "s1", 2, 9000)], "dataset string, snap string, ord int, size bigint")
    ch = spark.createDataFrame([("d", 1, 1, "WRITE", 0, 70)], "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    got = [tuple(r) for r in dry_run.plan(v, ch, 4096).orderBy("ord").collect()]
    assert got == [("d", 1, "s0", None, "full", 5000, 8192, 2, 70, False), ("d", 2, "s1", "s0", "incremental", 9000, 12288, 3, 0, False)]
    start = spark.createDataFrame([("d", 2)], "dataset string, start int")
    assert [r["snap"] for r in dry_run.plan(v, ch, 4096, start=start).collect()] == ["s1"]


def test_throughput_by_hand(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("d", t0 + dt.timedelta(seconds=s), b) for s, b in [(0, 100), (5, 50), (5, 50), (10, 10), (11, 20), (30, 5)]]
    e = spark.createDataFrame(rows, "dataset string, ts timestamp, bytes bigint")
    total = spark.createDataFrame([("d", 300)], "dataset string, total bigint")
    got = [tuple(r)[2:] for r in progress.throughput(e, total, 10, pieces=3).orderBy("micros").collect()]
    # done, window, rate, total, percent, eta; the window includes its first instant and is no
    # longer than what has passed
    assert got == [(100, 100, 100, 300, 33, 2), (200, 200, 40, 300, 66, 2), (210, 210, 21, 300, 70, 4),
                   (230, 130, 13, 300, 76, 5), (235, 5, 0, 300, 78, None)]


def table(spark, name, value):
    spark.createDataFrame([(value,)], "v string").write.option("path", scratch_path(spark, name)).saveAsTable(name)


def verdict(spark, status):
    return spark.createDataFrame([("d", "s", status, None)], "dataset string, snap string, status string, first_diff bigint")


def content(spark, name):
    return spark.table(name).first()[0] if spark.catalog.tableExists(name) else None


def test_publish(spark):
    for i, (status, kw, want) in enumerate([("same", {}, ("new", "old")), ("same", {"keep_backup": False}, ("new", None)),
                                            ("same", {"no_swap": True}, ("old", None)), ("same", {"dry_run": True}, ("old", None))]):
        t = f"pub{i}"
        table(spark, t, "old")
        table(spark, t + "_new", "new")
        publish.publish_verified(spark, t + "_new", t, verdict(spark, status), **kw)
        assert (content(spark, t), content(spark, t + "_old")) == want


def test_failed_comparison_and_failed_rename_leave_the_original(spark):
    table(spark, "keep", "old")
    table(spark, "keep_new", "new")
    with pytest.raises(ValueError, match="tail"):
        publish.publish_verified(spark, "keep_new", "keep", verdict(spark, "tail"))
    assert content(spark, "keep") == "old"

    def breaks(sp, old, new):
        if old == "keep_new":
            raise RuntimeError("no")
        publish.rename(sp, old, new)
    with pytest.raises(RuntimeError, match="^no$"):
        publish.promote(spark, "keep_new", "keep", "keep_old", breaks)
    assert content(spark, "keep") == "old" and content(spark, "keep_old") is None
    table(spark, "keep_old", "x")
    with pytest.raises(ValueError, match="already exists"):
        publish.promote(spark, "keep_new", "keep", "keep_old")
