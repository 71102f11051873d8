"""A byte-array model of a dataset with versions, and plain-Python results to compare with."""

import hashlib
import random


class Model:
    """Writes, frees and resizes between versions; keeps images and a change log."""

    def __init__(self, name, size):
        self.name, self.data = name, bytearray(size)
        self.images, self.changes, self.versions, self.pending = [], [], [], []

    def W(self, off, length, seed):
        self.data[off:off + length] = random.Random(f"{seed}:{off}").randbytes(length)
        self.pending.append(("WRITE", off, length))
        return self

    def F(self, off, length):
        end = len(self.data) if length < 0 else off + length
        self.data[off:end] = bytes(end - off)
        self.pending.append(("FREE", off, length))
        return self

    def Z(self, size):
        if size < len(self.data):
            del self.data[size:]
            self.pending.append(("FREE", size, -1))
        else:
            self.data.extend(bytes(size - len(self.data)))
        return self

    def S(self, snap, head=False):
        ord_ = len(self.versions) + 1
        self.versions.append((self.name, snap, ord_, len(self.data), ord_ * 7919, head))
        self.images.append((self.name, ord_, bytes(self.data)))
        self.changes += [(self.name, ord_, i + 1, op, off, n) for i, (op, off, n) in enumerate(self.pending)]
        self.pending = []
        return self


def frames(spark, models):
    """(versions, images, changes) of several models."""
    versions = spark.createDataFrame([v for m in models for v in m.versions],
                                     "dataset string, snap string, ord int, size bigint, version_id bigint, is_head boolean")
    images = spark.createDataFrame([i for m in models for i in m.images], "dataset string, ord int, bytes binary")
    changes = spark.createDataFrame([c for m in models for c in m.changes],
                                    "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    return versions, images, changes


def cells_of(data, grain):
    """Live cells of an image: {cell: zero-padded payload}."""
    out = {}
    for c in range(-(-len(data) // grain)):
        p = data[c * grain:(c + 1) * grain].ljust(grain, b"\0")
        if any(p):
            out[c] = p
    return out


def states(rows, versions):
    """Collected history rows -> {(dataset, ord): {cell: payload}} for every version."""
    out = {}
    for name, _, ord_, *_ in versions:
        live = {}
        for r in sorted((r for r in rows if r["dataset"] == name and r["ord"] <= ord_), key=lambda r: r["ord"]):
            live[r["cell"]] = r["payload"]
        out[(name, ord_)] = {c: bytes(p) for c, p in live.items() if p is not None}
    return out


def lanes_sql(cells, lanes=16):
    """The lt-sql accumulator of {cell: payload}, from hashlib."""
    total = [0] * lanes
    for c, p in cells.items():
        h = hashlib.sha256(f"{c}:".encode() + p).hexdigest()
        groups = [h] + [hashlib.sha256(f"{h}:{g}".encode()).hexdigest() for g in range(1, lanes // 16)]
        text = "".join(groups)
        for i in range(lanes):
            total[i] = (total[i] + int(text[4 * i:4 * i + 4], 16)) % 65536
    return b"".join(v.to_bytes(2, "little") for v in total)


KIB = 1024


def scenarios():
    """The histories of the scenario list, scaled down: cells of 8..64 bytes are the grains."""
    K = KIB
    return [
        Model("three", 64 * K).W(0, 4 * K, 1).W(20 * K, 4 * K, 2).S("s0").W(2 * K, 3 * K, 3).W(40 * K, 5 * K, 4).S("s1")
        .W(0, K, 5).W(60 * K, 2 * K, 6).S("s2"),
        Model("single", 32 * K).W(0, 8 * K, 10).W(16 * K, 4 * K, 11).S("only"),
        Model("holes", 64 * K).W(0, 64 * K, 1).S("full").F(16 * K, 16 * K).S("holed"),
        Model("grow", 32 * K).W(0, 16 * K, 1).S("small").Z(64 * K).W(40 * K, 16 * K, 2).S("grown"),
        Model("shrink", 64 * K).W(0, 48 * K, 3).S("big").Z(32 * K).W(8 * K, 4 * K, 4).S("shrunk"),
        Model("regrow", 64 * K).W(0, 48 * K, 1).S("big").Z(16 * K).S("small").Z(64 * K).W(20 * K, 4 * K, 2).S("regrown"),
        Model("odd", 24584).W(0, 8 * K, 1).S("s0"),
        Model("steps", 32 * K).W(0, 32 * K, 1).S("s0").F(8 * K, 8 * K).S("s1").W(8 * K, 8 * K, 2).S("s2").Z(16 * K).S("s3")
        .Z(32 * K).W(16 * K, 16 * K, 3).S("s4"),
        Model("half", 32 * K).W(0, 32 * K, 1).S("s0").F(8, 8).S("s1"),
        Model("same", 16 * K).W(0, 8 * K, 1).S("s0").S("s1").W(8 * K, 4 * K, 2).S("s2"),
    ]


def random_model(name, seed, versions=8, size=4096, unit=8):
    """A seeded history with overlapping writes, frees, zero writes and resizes."""
    rnd = random.Random(seed)
    m = Model(name, size)
    for v in range(versions):
        for _ in range(rnd.randint(0, 5)):
            n = len(m.data) // unit
            if n == 0:
                break
            off = rnd.randrange(n) * unit
            length = min(rnd.randint(1, 40) * unit, len(m.data) - off)
            what = rnd.random()
            if what < 0.55:
                m.W(off, length, rnd.random())
            elif what < 0.75:
                m.F(off, length)
            elif what < 0.85:
                m.F(off, -1)
            else:
                m.Z(rnd.randint(1, size // 4) * 4)
        m.S(f"s{v}")
    return m
