"""Scenario and random histories: every version byte-equal at every grain, and hashed alike."""

import pytest
from pyspark.sql import functions as F

from blockhist.operators import compare as CMP, fingerprint as FP, history as H, regrain as G
from blockhist.plans import replay as RP
from blockhist.session import materialise
from blockhist.sources import images as IMG
from tests.model import cells_of, frames, lanes_sql, random_model, scenarios, states


@pytest.fixture(scope="module")
def models():
    return scenarios() + [random_model(f"r{i}", i) for i in range(12)]


@pytest.fixture(scope="module")
def data(spark, models):
    return frames(spark, models)


def rebuilt(data, old, new):
    versions, images, changes = data
    cells = IMG.to_cells(images, ["dataset", "ord"], "bytes", old)
    return materialise(RP.replay(cells, changes, versions, old, new), "test")


@pytest.mark.parametrize("old,new", [(64, 256), (64, 16), (64, 64)])
def test_every_version_is_rebuilt(data, models, old, new):
    rows = rebuilt(data, old, new).collect()
    got = states(rows, [v for m in models for v in m.versions])
    for m in models:
        for name, ord_, image in m.images:
            assert got[(name, ord_)] == cells_of(image, new), (name, ord_)
    # sparse: no stored zeros, no row that changes nothing
    assert all(r["payload"] is None or any(r["payload"]) for r in rows)
    last = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        key = (r["dataset"], r["cell"])
        assert last.get(key) != r["payload"]
        last[key] = r["payload"]


@pytest.fixture(scope="module")
def history(data):
    return rebuilt(data, 64, 64)


def test_incremental_equals_from_scratch(data, models, history):
    versions = data[0]
    sql = {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in FP.fingerprint_history(history, versions).collect()}
    wide = {(r["dataset"], r["ord"]): bytes(r["acc"])
            for r in FP.fingerprint_history(history, versions, lanes=32).collect()}
    for m in models:
        for name, ord_, image in m.images:
            assert sql[(name, ord_)] == lanes_sql(cells_of(image, 64)), (name, ord_)
            assert wide[(name, ord_)] == lanes_sql(cells_of(image, 64), 32)
    assert sql[("same", 1)] == sql[("same", 2)] != sql[("same", 3)]


def test_wide_lanes_incremental_equals_image(spark, data, models, history):
    versions = data[0]
    every = spark.createDataFrame([(f"{n}@{o}", c, p) for m in models for n, o, b in m.images
                                   for c, p in cells_of(b, 64).items()], "dataset string, cell bigint, payload binary")
    want = {r["dataset"]: bytes(r["acc"]) for r in FP.wy_lthash(every, ["dataset"]).collect()}
    got = FP.fingerprint_history(history, versions, algo=FP.WY).collect()
    assert len(got) == sum(len(m.versions) for m in models)
    for r in got:
        assert bytes(r["acc"]) == want.get(f"{r['dataset']}@{r['ord']}", bytes(2048))


def test_full_read_equals_incremental(data, history):
    versions = data[0]
    at = versions.groupBy("dataset").agg(F.min("ord").alias("at"))
    full = {r["dataset"]: bytes(r["acc"]) for r in FP.fingerprint_image(history, at).collect()}
    inc = {r["dataset"]: bytes(r["acc"]) for r in FP.fingerprint_history(history, versions).filter("ord = 1").collect()}
    assert all(inc[k] == v for k, v in full.items())


@pytest.mark.parametrize("kept", [0, 1, 2, 99])
def test_extended_equals_from_scratch(data, models, history, kept):
    versions = data[0]
    whole = materialise(FP.fingerprint_history(history, versions), "fps")
    stored = whole.filter(F.col("ord") <= kept)
    got = {(r["dataset"], r["ord"]): bytes(r["acc"])
           for r in FP.extend_fingerprints(stored, history, versions).collect()}
    assert got == {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in whole.collect()}


@pytest.mark.parametrize("kept", [0, 2, 99])
def test_extended_wide_lanes_equal_from_scratch(data, history, kept):
    versions = data[0]
    whole = materialise(FP.fingerprint_history(history, versions, algo=FP.WY), "fps")
    stored = whole.filter(F.col("ord") <= kept)
    got = {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in FP.extend_wy_fingerprints(stored, history, versions).collect()}
    assert got == {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in whole.collect()}
    if kept == 2:
        first, second = (whole.filter(F.col("ord") == o).select("dataset", "acc") for o in (1, 2))
        step = FP.wy_subtract(second, first, ["dataset"])
        back = FP._added(step.withColumn("ord", F.lit(2)).join(first.withColumnRenamed("acc", "_a"), "dataset"), "acc", "_a")
        assert {r["dataset"]: bytes(r["acc"]) for r in back.join(second.select("dataset"), "dataset", "left_semi").collect()} == {
            r["dataset"]: bytes(r["acc"]) for r in second.collect()}


def test_extension_reads_only_changed_cells(data, history):
    base = data[0].select("dataset", F.lit(1).alias("base")).distinct()
    rows = FP.old_content(history, base).filter("dataset = 'same'").collect()
    assert rows == []          # its later versions touch other cells


def test_cell_size_mismatch_fails(spark):
    fps = spark.createDataFrame([("d", 512)], "dataset string, cell_size bigint")
    assert FP.checked_cell_size(fps, 512).count() == 1
    with pytest.raises(Exception, match="cell size 512"):
        FP.checked_cell_size(fps, 4096).collect()


@pytest.mark.parametrize("new", [16, 512])
def test_history_regrain(data, models, history, new):
    versions = data[0]
    rows = G.regrain_history(history, versions, 64, new).collect()
    rows = [r if r["payload"] is None or any(r["payload"]) else {**r.asDict(), "payload": None} for r in rows]
    got = states(rows, [v for m in models for v in m.versions])
    for m in models:
        for name, ord_, image in m.images:
            assert got[(name, ord_)] == cells_of(image, new), (name, ord_)


def test_delta_spans_a_gap(data, models, history):
    got = {(r["dataset"], r["cell"]): r["op"] for r in H.delta_between(history, 1, 3).collect()}
    for m in models:
        if len(m.images) < 3:
            continue
        a, b = cells_of(m.images[0][2], 64), cells_of(m.images[2][2], 64)
        want = {(m.name, c): "WRITE" if c in b else "FREE" for c in set(a) | set(b) if a.get(c) != b.get(c)}
        assert {k: v for k, v in got.items() if k[0] == m.name} == want


def test_chunked_forms_agree(data, history, monkeypatch):
    """With tiny limits all ordered steps go through chunks; results stay the same."""
    from blockhist.functions import ordered
    versions = data[0]
    plain = sorted(map(str, FP.fingerprint_history(history, versions).collect()))
    delta = sorted(map(str, H.version_delta(history, versions).collect()))
    cut = sorted(map(str, H.apply_resize(history, versions, 64).collect()))
    monkeypatch.setattr(ordered, "SAFE_GROUP", 2)
    monkeypatch.setattr(ordered, "SPINE_CHUNK", 3)
    monkeypatch.setattr(ordered.int_chunk, "__defaults__", (2,))
    assert sorted(map(str, FP.fingerprint_history(history, versions).collect())) == plain
    assert sorted(map(str, H.version_delta(history, versions).collect())) == delta
    assert sorted(map(str, H.apply_resize(history, versions, 64).collect())) == cut
    report = CMP.compare_history(history, versions, history, versions, 64)
    assert {r["status"] for r in report.collect()} == {"same"}
