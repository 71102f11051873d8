"""The whole job on small stored histories."""

import pytest
from pyspark.sql import functions as F

from blockhist.operators.fingerprint import fingerprint_history
from blockhist.operators.identity import derive_ids
from blockhist.plans.rebuild import Options, Source, rebuild
from blockhist.session import scratch_path
from tests.model import Model, cells_of, frames, states
from tests.test_compare import histories_from_images


@pytest.fixture(scope="module")
def models():
    a = Model("a", 6000).W(0, 4000, 1).S("s0").F(512, 1024).S("s1").W(5000, 1000, 2).S("s2").S("head", head=True)
    b = Model("b", 2000).W(0, 2000, 3).S("s0").Z(700).S("s1").Z(3000).W(2900, 100, 4).S("s2").S("head", head=True)
    return [a, b]


@pytest.fixture(scope="module")
def source(spark, models):
    versions, _, changes = frames(spark, models)
    settings = spark.createDataFrame([(n, "on", n + "-new", n + "-old") for n in "ab"],
                                     "dataset string, readonly string, target string, backup string")
    props = spark.createDataFrame([("a", "compression", "lz4", "local"), ("a", "volsize", "1", "local"),
                                   ("b", "refreservation", "9", "local")], "dataset string, property string, value string, source string")
    holds = spark.createDataFrame([("a", "s0", "keep"), ("a", "x", "keep")], "dataset string, snap string, tag string")
    return Source(versions, settings, spark.createDataFrame([("a", 0), ("b", 0)], "dataset string, written bigint"),
                  spark.createDataFrame([], "name string"), changes, props, holds)


@pytest.fixture()
def table(spark, models, request):
    name = "t_" + request.node.name.replace("[", "_").replace("]", "")
    histories_from_images(spark, models, 16).write.option("path", scratch_path(spark, name)).saveAsTable(name)
    return name


def check(spark, table, models, grain):
    got = states(spark.table(table).collect(), [v for m in models for v in m.versions])
    for m in models:
        for n, o, image in m.images:
            # a bigger cell that became zero may be stored as zeros or as a tombstone
            assert {c: p for c, p in got[(n, o)].items() if any(p)} == cells_of(image, grain)


def test_published(spark, models, source, table):
    r = rebuild(spark, table, source, Options(16, 512, derive=True))
    assert r.outcome == "published"
    check(spark, table, models, 512)
    check(spark, table + "_old", models, 16)
    assert {x["status"] for x in r.report.collect()} == {"same"} and r.report.count() == 8
    assert r.versions.count() == 6 and r.versions.filter("new_id = version_id").count() == 0
    assert {tuple(x) for x in r.properties.collect()} == {("a", "compression", "lz4"), ("b", "refreservation", "auto")}
    assert [x["snap"] for x in r.holds.collect()] == ["s0"]


def test_dry_run_and_refusal_change_nothing(spark, models, source, table):
    r = rebuild(spark, table, source, Options(16, 512, dry_run=True))
    assert r.outcome == "planned" and r.steps.count() == 8
    moved = Source(**{**vars(source), "written": spark.createDataFrame([("a", 9)], "dataset string, written bigint")})
    with pytest.raises(ValueError, match="head_is_newest"):
        rebuild(spark, table, moved, Options(16, 512))
    with pytest.raises(ValueError, match="grain"):
        rebuild(spark, table, source, Options(16, 48))
    assert not spark.catalog.tableExists(table + "_new")
    assert rebuild(spark, table, moved, Options(16, 512, force=True, no_swap=True)).outcome == "left"
    check(spark, table, models, 16)
    check(spark, table + "_new", models, 512)


def reference(spark, models, source):
    named = source.versions.filter("not is_head")
    fps = fingerprint_history(histories_from_images(spark, models, 64), named)
    return derive_ids(fps).withColumn("version_id", F.col("new_id")).drop("new_id")


def test_ids_from_a_reference_at_its_own_cell_size(spark, models, source, table):
    ref = reference(spark, models, source)
    with pytest.raises(ValueError, match="1 versions not in the reference"):
        rebuild(spark, table, source, Options(16, 512, reference=ref.filter("not (dataset = 'a' and snap = 's1')"), reference_cell=64))
    r = rebuild(spark, table, source, Options(16, 512, reference=ref, reference_cell=64, verify="head"))
    assert r.outcome == "published"
    assert {x["id_origin"] for x in r.versions.collect()} == {"reference"}


def test_other_content_is_not_aligned(spark, models, source, table):
    ref = reference(spark, models, source)
    bad = ref.withColumn("acc", F.when(F.col("snap") == "s2", F.lit(bytes(32))).otherwise(F.col("acc")))
    with pytest.raises(ValueError, match="content differs"):
        rebuild(spark, table, source, Options(16, 512, reference=bad, reference_cell=64))
    check(spark, table, models, 16)
