"""Comparison against a byte-by-byte brute force."""

import random

import pytest
from pyspark.sql import functions as F

from blockhist.operators import compare as CMP
from tests.model import Model, frames, random_model


def brute(a, b):
    """(status, first difference) of two images."""
    common = min(len(a), len(b))
    for i in range(max(len(a), len(b))):
        x = a[i] if i < len(a) else 0
        y = b[i] if i < len(b) else 0
        if x != y:
            return ("differs" if i < common else "tail"), i
    return "same", None


def changed_copy(m, seed):
    """A model with the same versions of which some bytes were altered, or cut, or extended."""
    rnd = random.Random(seed)
    c = Model(m.name, 0)
    c.changes = list(m.changes)
    for (name, snap, ord_, size, vid, head), (_, _, image) in zip(m.versions, m.images):
        data = bytearray(image)
        what = rnd.random()
        if what < 0.3 and data:
            data[rnd.randrange(len(data))] ^= 1 + rnd.randrange(255)
        elif what < 0.4:
            data += bytes(rnd.choice([64, 3]))
        elif what < 0.5:
            data += b"\0\0\1"
        c.versions.append((name, snap, ord_, len(data), vid, head))
        c.images.append((name, ord_, bytes(data)))
    return c


def histories_from_images(spark, models, grain):
    """Histories straight from the images: every version stores all its cells."""
    from tests.model import cells_of
    rows = []
    for m in models:
        before = {}
        for name, ord_, image in m.images:
            now = cells_of(image, grain)
            for c in set(now) | set(before):
                if now.get(c) != before.get(c):
                    rows.append((name, ord_, c, now.get(c)))
            before = now
    return spark.createDataFrame(rows, "dataset string, ord int, cell bigint, payload binary")


def test_random_pairs(spark):
    models = [random_model(f"r{i}", 100 + i) for i in range(25)]
    copies = [changed_copy(m, i) for i, m in enumerate(models)]
    va, vb = frames(spark, copies)[0], frames(spark, models)[0]
    a, b = histories_from_images(spark, copies, 64), histories_from_images(spark, models, 16)
    got = {(r["dataset"], r["snap"]): r for r in CMP.compare_history(a, va, b, vb, 64, 16).collect()}
    seen = set()
    for m, c in zip(models, copies):
        for (name, snap, *_), (_, _, y), (_, _, x) in zip(m.versions, m.images, c.images):
            r = got[(name, snap)]
            status, at = brute(x, y)
            seen.add(status)
            assert (r["status"], r["first_diff"]) == (status, at), (name, snap)
            assert r["identical"] == (min(len(x), len(y)) if at is None else min(at, len(x), len(y)))
            pad = max(len(x), len(y)) // 16 * 16 + 16
            x, y = x.ljust(pad, b"\0"), y.ljust(pad, b"\0")
            assert r["cells_differ"] == sum(x[i:i + 16] != y[i:i + 16] for i in range(0, pad, 16))
    assert seen == {"same", "differs", "tail"}


@pytest.fixture(scope="module")
def pair(spark):
    """Equal at s0 and at the head, different inside s1; the copy has no s2."""
    def model(seed):
        m = Model("v", 4096).W(0, 4096, 1).S("s0").W(1024, 2048, 2).S("s1")
        if seed:
            image = bytearray(m.images[1][2])
            image[2777] ^= 255
            m.images[1] = ("v", 2, bytes(image))
            m.data[:] = m.images[0][2]
        m.data[:] = m.images[0][2]
        if not seed:
            m.S("s2")
        return m.S("head", head=True)
    a, b = model(1), model(0)
    return ((histories_from_images(spark, [a], 64), frames(spark, [a])[0]),
            (histories_from_images(spark, [b], 64), frames(spark, [b])[0]))


def report(pair, **kw):
    (a, va), (b, vb) = pair
    return {r["snap"]: (r["status"], r["first_diff"]) for r in CMP.compare_history(a, va, b, vb, 64, **kw).collect()}


def test_modes(pair):
    assert report(pair) == {"s0": ("same", None), "s1": ("differs", 2777), "s2": ("missing", None), "head": ("same", None)}
    assert report(pair, mode="head") == {"head": ("same", None)}
    assert report(pair, mode="one", snap="s1") == {"s1": ("differs", 2777)}
    assert report(pair, mode="none") == {}


def test_one_must_exist_on_both_sides(pair):
    with pytest.raises(Exception, match="missing on the target"):
        report(pair, mode="one", snap="s2")
    with pytest.raises(Exception, match="not a version of the original"):
        report((pair[1], pair[0]), mode="one", snap="s2")


def test_rounded_up_target_is_the_same_and_a_dirty_tail_is_not(spark):
    m = Model("odd", 24584).W(0, 8192, 1).S("s0")
    wide = Model("odd", 24608)
    wide.data[:24584] = m.data
    wide.S("s0")
    dirty = Model("odd", 24608)
    dirty.data[:24584] = m.data
    dirty.data[24600] = 7
    dirty.S("s0")
    b, vb = histories_from_images(spark, [m], 8), frames(spark, [m])[0]
    for model, want in ((wide, ("same", None)), (dirty, ("tail", 24600))):
        got = CMP.compare_history(histories_from_images(spark, [model], 32), frames(spark, [model])[0],
                                  b, vb, 32, 8).first()
        assert (got["status"], got["first_diff"]) == want


def test_verify_only_needs_a_target(pair):
    (a, va), (b, vb) = pair
    with pytest.raises(ValueError, match="no versions"):
        CMP.verify_only(a, va.filter("false"), b, vb, 64)


def test_versions_in_another_order_are_refused(spark):
    m = Model("v", 64).W(0, 64, 1).S("s0").W(0, 64, 2).S("s1")
    v = frames(spark, [m])[0]
    h = histories_from_images(spark, [m], 64)
    turned = v.withColumn("ord", 3 - F.col("ord"))
    with pytest.raises(Exception, match="order"):
        CMP.compare_history(h, turned, h, v, 64).collect()


def test_version_lists(spark):
    m = Model("v", 64).S("s0").S("s1").S("s2")
    v = frames(spark, [m])[0]
    assert CMP.version_list_diff(v, v).count() == 0
    other = v.withColumn("snap", F.when(F.col("ord") == 2, "x").otherwise(F.col("snap")))
    assert {r["snap"] for r in CMP.version_list_diff(v, other).collect()} == {"s1", "x"}


def test_equal_blocks_stay_closed(spark):
    """Of many blocks only the one with a difference is opened, also where both sides skip versions or repeat rows."""
    schema = "dataset string, ord int, cell long, payload binary"
    rows = [("d", o, c, f"{o}/{c}".encode()) for o in (1, 2) for c in range(0, 40 * CMP.BLOCK, 16)]
    v = spark.createDataFrame([("d", f"s{o}", o, 1 << 40, False) for o in (1, 2)], "dataset string, snap string, ord int, size long, is_head boolean")
    a = spark.createDataFrame(rows, schema)
    changed = [(n, o, c, b"other" if (o, c) == (2, 16 * 100) else p) for n, o, c, p in rows]
    b = spark.createDataFrame(changed, schema)
    pairs = CMP._numbered(CMP.paired_versions(v, v))
    left, right = (CMP._in_common_numbers(x, pairs, s, 16) for x, s in ((a, "a"), (b, "b")))
    assert CMP.block_digests(left).count() == 40 and CMP.open_blocks(left, left, pairs).count() == 0
    assert [tuple(r) for r in CMP.open_blocks(left, right, pairs).collect()] == [("d", 1600 // CMP.BLOCK)]
    assert {r.snap: (r.status, r.first_diff) for r in CMP.compare_history(a, v, b, v, 16).collect()} == {"s1": ("same", None), "s2": ("differs", 1600 * 16)}
    # rows in another order inside one compared version are no equal block
    one = v.filter("ord = 2")
    x = spark.createDataFrame([("d", 1, 0, b"x"), ("d", 2, 0, b"y")], schema)
    y = spark.createDataFrame([("d", 1, 0, b"y"), ("d", 2, 0, b"x")], schema)
    assert CMP.compare_history(x, one, y, one, 16).first().status == "differs"
    # a row twice is not no row
    twice = spark.createDataFrame([("d", 1, 0, b"x"), ("d", 1, 0, b"x")], schema)
    assert CMP.compare_history(twice, one, twice.limit(0), one, 16).first().status == "differs"
