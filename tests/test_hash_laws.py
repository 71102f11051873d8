"""Laws of the lane hash, in both forms."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from blockhist.functions import lanes as L, wyhash
from blockhist.operators import fingerprint as FP
from tests.model import lanes_sql

A, B, C = b"a" * 4096, b"b" * 4096, b"c" * 2048

# Fixed values: (index, content, seed) known for this hash.
SEEDS = [(7, A, 0xC900A0B91023F904), (0, A, 0xD808D0705BD3B882), (1, B, 0x9C33E467F0708F70),
         (2, C, 0xAAAB06146DD7FDEF), (4, b"x" * 17, 0x3A6506D42D3CF81F), (9, b"0123456789", 0x3AA1D4F20DD90E3F),
         (5, b"abc", 0xC20FB322FB8F7F17), (3, bytes(4096), 0)]
DIGEST_OF_THREE = "5432145f529d5f9a475829552481be07fa900f8bdff316556f8cd2dc7b001b5f"
DIGEST_OF_NOTHING = "e5a00aa9991ac8a5ee3109844d84a55583bd20572ad3ffcd42792f3c36b183ad"


def wy(cells):
    seeds = wyhash.cell_seeds(np.array([c for c, _ in cells]), pa.array([p for _, p in cells], pa.binary()))
    return wyhash.stretch(seeds[seeds != 0]).sum(axis=0, dtype=np.uint16)


def test_known_seeds():
    got = wyhash.cell_seeds(np.array([s[0] for s in SEEDS]), pa.array([s[1] for s in SEEDS]))
    assert [int(x) for x in got] == [s[2] for s in SEEDS]


def test_seeds_of_odd_batches():
    sliced = pa.array([b"zz", None, b"", b"abc", bytes(3), b"q"]).slice(1, 4)
    got = wyhash.cell_seeds(np.array([5, 5, 5, 5]), sliced)
    assert [int(x) for x in got] == [0, 0, SEEDS[6][2], 0]
    assert len(wyhash.cell_seeds(np.array([], dtype=np.int64), pa.array([], pa.binary()))) == 0


def test_known_digests():
    assert hashlib.sha256(wy([(0, A), (1, B), (2, C)]).tobytes()).hexdigest() == DIGEST_OF_THREE
    assert hashlib.sha256(bytes(2048)).hexdigest() == DIGEST_OF_NOTHING


def test_order_position_and_content_wy():
    assert (wy([(0, A), (1, B)]) == wy([(1, B), (0, A)])).all()
    assert (wy([(0, A), (1, B)]) != wy([(1, A), (0, B)])).any()
    assert (wy([(0, A)]) != wy([(0, B)])).any()
    assert (wy([(0, A), (9, bytes(4096))]) == wy([(0, A)])).all()


def test_multiply_matches_big_integers():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    low, high = wyhash._product(a, b)
    for x, y, lo, hi in zip(a.tolist(), b.tolist(), low.tolist(), high.tolist()):
        assert x * y == (hi << 64) | lo


CELLS = [("d", 0, A), ("d", 1, B), ("d", 2, C), ("e", 1, B), ("e", 0, A), ("e", 2, C), ("e", 7, bytes(64)),
         ("e", 8, None), ("moved", 1, A), ("moved", 0, B), ("moved", 2, C), ("z", 4, bytes(16)), ("two", 2, C)]


@pytest.fixture(scope="module")
def accs(spark):
    df = spark.createDataFrame(CELLS, "dataset string, cell bigint, payload binary").repartition(5, "cell")
    return {n: {r["dataset"]: bytes(r["acc"]) for r in FP.lthash(df, ["dataset"], n).collect()} for n in (16, 64)}


@pytest.mark.parametrize("lanes", [16, 64])
def test_laws_sql(accs, lanes):
    a = accs[lanes]
    assert a["d"] == lanes_sql({0: A, 1: B, 2: C}, lanes)
    assert a["e"] == a["d"]                      # order-free; holes add nothing
    assert a["moved"] != a["d"]                  # position counts
    assert a["z"] == bytes(2 * lanes)            # an image of zeros is empty


def test_add_and_subtract_are_inverse(spark, accs):
    a = accs[16]
    row = spark.createDataFrame([(a["d"], a["two"])], "x binary, y binary").select(
        L.acc_sub("x", "y").alias("less"), L.acc_add(L.acc_sub("x", "y"), "y").alias("back"),
        L.acc_sub("x", "x").alias("zero")).first()
    assert bytes(row["less"]) == lanes_sql({0: A, 1: B})
    assert bytes(row["back"]) == a["d"] and bytes(row["zero"]) == bytes(32)


def test_text_round_trip(spark, accs):
    acc = accs[16]["d"]
    text = acc.hex()
    rows = spark.createDataFrame([(text,), (text.upper(),), (text[2:],), ("g" + text[1:],), ("",)], "t string")
    got = [r[0] for r in rows.select(L.acc_from_text("t", 16)).collect()]
    assert [None if g is None else bytes(g) for g in got] == [acc, acc, None, None, None]
    assert rows.select(L.acc_to_text(L.acc_from_text("t", 16)).alias("x")).first()["x"] == text


def test_wy_on_spark_equals_numpy(spark):
    df = spark.createDataFrame(CELLS, "dataset string, cell bigint, payload binary").repartition(3)
    got = {r["dataset"]: bytes(r["acc"]) for r in FP.wy_lthash(df, ["dataset"]).collect()}
    for name in ("d", "e", "moved"):
        want = wy([(c, p) for d, c, p in CELLS if d == name and p is not None]).tobytes()
        assert got[name] == want
    assert "z" not in got


def test_table_fingerprint_keeps_values_apart(spark):
    rows = [("a", 1, "x", "y"), ("b", 1, "x\",\"y", ""), ("c", 1, "x", None), ("d", 1, "x", ""), ("e", 1, None, "x")]
    df = spark.createDataFrame(rows, "g string, k int, p string, q string")
    got = {r["g"]: bytes(r["acc"]) for r in FP.table_fingerprint(df, ["k"], ["p", "q"], ["g"]).collect()}
    assert len(set(got.values())) == 5
    twice = df.filter("g = 'a'")
    one = FP.table_fingerprint(twice, ["k"], ["p"]).first()["acc"]
    two = FP.table_fingerprint(twice.union(twice), ["k"], ["p"]).first()["acc"]
    assert one != two
