"""The job from log and images: whole, taken up again, and refused."""

import pytest
from pyspark.sql import functions as F

from blockhist.plans.convert import Conversion, Log, convert
from blockhist.sources import images as IMG
from tests.model import Model, cells_of, frames, states


@pytest.fixture(scope="module")
def models():
    a = Model("a", 6000).W(0, 4000, 1).S("s0").F(512, 1024).S("s1").W(5000, 1000, 2).S("s2").W(100, 50, 3).S("s3")
    b = Model("b", 2000).W(0, 2000, 3).S("s0").Z(700).S("s1").Z(3000).W(2900, 100, 4).S("s2").F(0, 512).Z(1500).S("s3")
    return [a, b]


@pytest.fixture(scope="module")
def log(spark, models):
    versions, images, changes = frames(spark, models)
    settings = spark.createDataFrame([(n, "on", "t", "t_old", False, False) for n in "ab"],
                                     "dataset string, readonly string, target string, backup string, protected boolean, parent_protected boolean")
    estimates = versions.select("dataset", "ord", F.lit(1 << 20).cast("long").alias("estimate"))
    return Log(versions, IMG.to_cells(images, ["dataset", "ord"], "bytes", 64), changes, settings,
               spark.createDataFrame([("a", 0), ("b", 0)], "dataset string, written bigint"), spark.createDataFrame([], "name string"), estimates)


def check(spark, table, models):
    got = states(spark.table(table).collect(), [v for m in models for v in m.versions])
    for m in models:
        for n, o, image in m.images:
            assert got[(n, o)] == cells_of(image, 512), (n, o)


def upto(log, n):
    return Log(**{**vars(log), **{k: getattr(log, k).filter(F.col("ord") <= n) for k in ("versions", "images", "changes", "estimates")}})


def test_converted_in_one_run(spark, models, log):
    r = convert(spark, "c_whole", log, Conversion(64, 512))
    check(spark, "c_whole", models)
    assert r.steps.count() == 8 and r.cells == spark.table("c_whole").count() and r.bytes % 512 == 0
    assert {x["dataset"]: x["written"] for x in r.totals.collect()} == {"a": 5050, "b": 2100}
    assert r.drift.count() == 8 and r.drift.filter("drift").count() == 8 and r.notes == []


def test_taken_up_again(spark, models, log):
    convert(spark, "c_parts", upto(log, 2), Conversion(64, 512))
    taken = Log(**{**vars(log), "names": spark.createDataFrame([("t",)], "name string")})
    wanted = spark.createDataFrame([("a", "x/a@s2"), ("b", "@s2")], "dataset string, resume_from string")
    r = convert(spark, "c_parts", taken, Conversion(64, 512, resume_from=wanted))
    check(spark, "c_parts", models)
    assert r.steps.count() == 8 and r.drift.count() == 4
    assert {x["dataset"]: (x["snap"], x["target_bytes"] > 0) for x in r.base.collect()} == {"a": ("s1", True), "b": ("s1", True)}
    convert(spark, "c_again", log, Conversion(64, 512))
    assert sorted(map(str, spark.table("c_parts").collect())) == sorted(map(str, spark.table("c_again").collect()))


@pytest.mark.parametrize("wanted,extra,message", [
    ([("a", "s2")], {"names": []}, "target_exists"), ([("a", "nope")], {}, "no version to resume from"),
    ([("a", "s3")], {}, "s2 comes before the resume point"), ([("a", "s2")], {"target_written": [("a", 7)]}, "7 bytes written to the target"),
    ([("a", "s2")], {"reference": [("a", "s0", 1), ("a", "s1", 15838)]}, "id differs"),
    ([("a", "s2")], {"reference": [("a", "s0", 7919)]}, "base not in reference"),
    (None, {"protected": True}, "would not be"), (None, {"written": [("a", 3)]}, "head_is_newest")])
def test_refusals_change_nothing(spark, log, wanted, extra, message):
    if not spark.catalog.tableExists("c_stays"):
        convert(spark, "c_stays", upto(log, 2), Conversion(64, 512))
    before = sorted(map(str, spark.table("c_stays").collect()))
    names = extra.get("names", ["t"] if wanted else [])
    changed = {"names": spark.createDataFrame([(n,) for n in names], "name string")}
    if "protected" in extra:
        changed["settings"] = log.settings.withColumn("protected", F.lit(True))
    if "written" in extra:
        changed["written"] = spark.createDataFrame(extra["written"], "dataset string, written bigint")
    o = Conversion(64, 512)
    if wanted:
        o.resume_from = spark.createDataFrame(wanted, "dataset string, resume_from string")
    if "target_written" in extra:
        o.target_written = spark.createDataFrame(extra["target_written"], "dataset string, written bigint")
    if "reference" in extra:
        o.reference = spark.createDataFrame(extra["reference"], "dataset string, snap string, version_id bigint")
    with pytest.raises(ValueError, match=message):
        convert(spark, "c_stays", Log(**{**vars(log), **changed}), o)
    assert sorted(map(str, spark.table("c_stays").collect())) == before and not spark.catalog.tableExists("c_stays_new")


def test_a_wrong_image_is_found(spark, log):
    """The log leaves out a write: the rebuilt version differs from its image."""
    bad = Log(**{**vars(log), "changes": log.changes.filter("not (dataset = 'a' and ord = 3)")})
    with pytest.raises(ValueError, match="a@s2: rebuilt content differs"):
        convert(spark, "c_bad", bad, Conversion(64, 512))
    assert not spark.catalog.tableExists("c_bad")


def test_protection_notes(spark, models, log):
    under = Log(**{**vars(log), "settings": log.settings.withColumns({"protected": F.lit(True), "parent_protected": F.lit(True)})})
    assert len(convert(spark, "c_prot", under, Conversion(64, 512, verify=False)).notes) == 2
    plain = Log(**{**vars(log), "settings": log.settings.withColumn("protected", F.lit(True))})
    assert convert(spark, "c_plain", plain, Conversion(64, 512, allow_plain=True, verify=False)).notes == []
