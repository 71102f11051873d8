"""Fingerprints persisted round by round: killed, taken up, redone where versions changed; verified at another cell size."""

import os

import pytest
from pyspark.sql import functions as F

from blockhist.operators import fingerprint as FP, regrain as G
from blockhist.plans import fingerprints as J
from blockhist.session import scratch_path

CELL = "dataset string, ord int, cell bigint, payload binary"


@pytest.fixture(scope="module")
def history(spark):
    rows = [(d, o, c, f"{d}{o}{c}".encode() if (o + c) % 4 else None) for d in "de" for o in range(1, 10) for c in range(o % 3, 12, 3)]
    return spark.createDataFrame(rows, CELL).cache()


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame([(d, f"s{o}", o, 12 * 16, o * 5) for d in "de" for o in range(1, 10) if (d, o) < ("e", 8)],
                                 "dataset string, snap string, ord int, size bigint, version_id bigint")


def accs(rows):
    return {(r["dataset"], r["ord"]): bytes(r["acc"]) for r in rows.collect()}


@pytest.mark.parametrize("algo", [FP.SQL, FP.WY])
def test_killed_and_taken_up(spark, history, versions, algo, monkeypatch):
    path = scratch_path(spark, "job")
    write, killed = J._write_round, []

    def fails(rows, path, number):
        if number == 6 and not killed:
            killed.append(number)
            rows.write.parquet(f"{path}/rows/batch={number}")      # written, but not marked
            raise RuntimeError("killed")
        write(rows, path, number)
    monkeypatch.setattr(J, "_write_round", fails)
    with pytest.raises(RuntimeError):
        J.fingerprint_job(spark, history, versions, path, 16, algo=algo, at_once=3)
    assert {r["ord"] for r in J.finished_rows(spark, path).collect()} == {1, 2, 3}
    before = {f: os.stat(f"{path}/rows/batch=3/{f}").st_mtime_ns for f in os.listdir(f"{path}/rows/batch=3")}
    got = accs(J.fingerprint_job(spark, history, versions, path, 16, algo=algo, at_once=3))
    assert got == accs(FP.fingerprint_history(history, versions, algo=algo, cell_size=16))
    assert before == {f: os.stat(f"{path}/rows/batch=3/{f}").st_mtime_ns for f in os.listdir(f"{path}/rows/batch=3")}


def test_redone_from_a_changed_version_on(spark, history, versions):
    path = scratch_path(spark, "job")
    J.fingerprint_job(spark, history, versions, path, 16, at_once=3)
    other = versions.withColumn("version_id", F.when(F.expr("dataset = 'd' and ord = 5"), 99).otherwise(F.col("version_id")))
    rows = J.fingerprint_job(spark, history, other, path, 16, at_once=3)
    assert accs(rows) == accs(FP.fingerprint_history(history, versions, cell_size=16))
    assert {int(r["version_id"]) for r in rows.filter("dataset = 'd' and ord = 5").collect()} == {99}


def test_verified_at_the_cell_size_of_the_file(spark, history, versions):
    versions = versions.withColumn("version_id", F.col("version_id").cast("decimal(20,0)"))
    made = J.fingerprint_job(spark, history, versions, scratch_path(spark, "job"), 16, 64)
    at_big = G.regrain_history(history, versions, 16, 64)
    assert accs(made) == accs(FP.fingerprint_history(at_big, versions, cell_size=64))
    assert {r["status"] for r in J.verify_stored(made, history, versions, 16).collect()} == {"OK"}
    changed = history.withColumn("payload", F.when(F.expr("dataset = 'd' and ord = 4 and cell = 1"), F.lit(b"z")).otherwise(F.col("payload")))
    bad = {(r["dataset"], r["snap"]) for r in J.verify_stored(made, changed, versions, 16).filter("status <> 'OK'").collect()}
    assert ("d", "s4") in bad and not any(d == "e" or s in ("s1", "s2", "s3") for d, s in bad)
    with pytest.raises(ValueError, match="no stored fingerprints"):
        J.verify_stored(made.limit(0), history, versions, 16)
