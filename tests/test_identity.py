"""Ids: derivation, adoption behind a content check, replicas."""

import hashlib
from decimal import Decimal

import pytest

from blockhist.functions.ids import derived_id
from blockhist.operators import identity as I

# Id -> derived id.
DERIVED = {1: 8980073438861410214, 0: 12634128529936681850, 123456789: 281469491161022132,
           2**64 - 1: 1343108722416799325}
SCHEMA = "dataset string, snap string, ord int, size bigint, acc binary, version_id decimal(20,0)"


def by_hand(n):
    return int.from_bytes(hashlib.sha256(n.to_bytes(8, "little")).digest()[:8], "big") or 1


def test_derived_ids(spark):
    ids = list(DERIVED) + [2**63, 2**63 - 1, 255, 2**40]
    df = spark.createDataFrame([(Decimal(i),) for i in ids], "v decimal(20,0)")
    got = {int(r["v"]): int(r["d"]) for r in df.select("v", derived_id("v").alias("d")).collect()}
    assert got == {i: by_hand(i) for i in ids}
    assert {k: got[k] for k in DERIVED} == DERIVED


def rows(spark, data):
    return spark.createDataFrame([(d, s, o, z, a, Decimal(i)) for d, s, o, z, a, i in data], SCHEMA)


@pytest.fixture(scope="module")
def ours(spark):
    return rows(spark, [("d", "s0", 1, 10, b"a", 1), ("d", "s1", 2, 10, b"b", 2), ("d", "s2", 3, 10, b"b", 3),
                        ("d", "s3", 4, 20, b"c", 4)])


@pytest.fixture(scope="module")
def reference(spark):
    return rows(spark, [("d", "s1", 1, 10, b"b", 100), ("d", "s2", 2, 10, b"x", 101), ("d", "s3", 3, 21, b"c", 102)])


def test_adoption_needs_equal_content(ours, reference):
    got = {r["snap"]: (r["id_origin"], r["new_id"]) for r in I.align_ids(ours, reference).collect()}
    assert got == {"s0": ("missing", None), "s1": ("reference", 100), "s2": ("differs", None), "s3": ("differs", None)}
    got = {r["snap"]: r["new_id"] for r in I.align_ids(ours, reference, allow_missing=True).collect()}
    assert got["s0"] == by_hand(1) and got["s2"] is None
    with pytest.raises(Exception, match="cannot align"):
        I.align_ids(ours, reference, strict=True).collect()


def test_strict_passes_when_all_agree(ours, reference):
    fine = ours.filter("snap in ('s0', 's1')")
    got = {r["snap"]: int(r["new_id"]) for r in I.align_ids(fine, reference, allow_missing=True, strict=True).collect()}
    assert got == {"s0": by_hand(1), "s1": 100}


def test_coverage_list_is_short_and_ordered(spark):
    v = spark.createDataFrame([("d", f"s{i}", i) for i in range(1, 13)] + [("e", "x", 200000)], "dataset string, snap string, ord int")
    r = spark.createDataFrame([("d", "s2")], "dataset string, snap string")
    got = {x["dataset"]: (x["missing"], x["names"]) for x in I.coverage_gaps(v, r).collect()}
    assert got == {"d": (11, "@s1, @s3, @s4, @s5, @s6, @s7, @s8, @s9, ... (+3 more)"), "e": (1, "@x")}


def test_resume_conflicts(spark, reference):
    mig = rows(spark, [("d", "s0", 1, 0, b"", 9), ("d", "s1", 2, 0, b"", 100), ("d", "s2", 3, 0, b"", 5)])
    base = spark.createDataFrame([("d", "s9"), ("d", "s1")], "dataset string, snap string")
    got = sorted((r["snap"], r["reason"]) for r in I.resume_conflicts(mig, reference, base).collect())
    assert got == [("s2", "id differs"), ("s9", "base not in reference")]


def test_replicas_with_lost_versions(spark):
    v = rows(spark, [("d", f"s{i}", i + 1, 0, b"", 50 + i) for i in range(4)])
    a, b = v.filter("snap <> 's2'"), v.filter("snap <> 's1'")
    assert sorted(r["snap_a"] for r in I.match_replicas(a, b).collect()) == ["s0", "s3"]
    top = I.newest_common(a, b).first()
    assert (top["common"], top["base_snap"]) == (2, "s3")
    ids = [dict((r["snap"], r["new_id"]) for r in I.derive_ids(x).collect()) for x in (a, b)]
    assert all(ids[0][s] == ids[1][s] for s in ("s0", "s3"))


def test_conflicts(spark):
    v = spark.createDataFrame([("d", 1, 5), ("d", 2, 5), ("d", 3, 1), ("e", 4, 5)], "dataset string, version_id bigint, new_id bigint")
    got = sorted((r["dataset"], r["id"], r["reason"]) for r in I.id_conflicts(v, v).collect())
    assert got == [("d", 1, "equals an original"), ("d", 5, "duplicate")]
