"""Line dedup, vector codes and the Merkle manifest against brute force, with tiny blocks and awkward rows."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus as C  # noqa: E402

from blockhist.llm import common_lines, manifest, vector_codes  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return C.documents(spark).cache()


# lines

def brute_lines(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")

        def goes(line):
            held = holders.get(line.strip(BLANK).translate(LOWER), ())
            return len(held) >= min_docs and (doc is None or doc < max(d for d in held if d is not None))
        kept = [x for x in lines if not goes(x)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shared_lines():
    rnd = random.Random(5)
    lines = [f"line {i} " + "é" * rnd.randint(28, 40) + " End" for i in range(30)]
    made = []
    for i in range(60):
        mine = [rnd.choice(lines) for _ in range(rnd.randint(0, 9))]
        mine = [rnd.choice(["", " ", "\t", "\r", "\x0b"]) + (x.upper().replace("É", "é") if rnd.random() < .3 else x) + rnd.choice(["", " ", "\r"]) for x in mine]
        made.append((i, "\n".join(mine)))
    made += [(3, made[3][1]), (3, made[4][1]), (None, made[5][1]), (None, made[5][1]), (None, "\n".join(lines)), (None, None), (70, ""), (71, None), (72, "\n"),
             (73, "\n".join(lines * 400)), (74, "\n\n" + lines[0] + "\n\n"), (75, "x" * 200000 + "\n" + lines[1]), (76, " ".join(lines[:3]) + " "), (-5, lines[2])]
    return made


@pytest.mark.parametrize("heavy", [1, 20, common_lines.HEAVY])
def test_lines_of_many_documents(spark, heavy):
    made = shared_lines()
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    left = common_lines.drop_common_lines(df, heavy=heavy)
    got = [(r.doc_id, r.lines.n_lines, len(r.lines.gone), sha(r.text or "")) for r in left.collect()]
    want = brute_lines(made)
    assert C.in_order(got) == C.in_order(want)
    assert sum(w[2] for w in want) > 100


def test_heavy_lines_are_few_and_the_rest_spread(spark):
    """One line in every document and many others: no join key of the shuffled part holds more than its share."""
    made = [(i, "\n".join(["a line that stands in each and every one of them"] + [f"line number {i % 50} shared by a small group of texts"])) for i in range(500)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    lines = common_lines.occurrences(df, 40)
    common = common_lines.common_lines(lines, 5)
    total = common.agg(F.sum("n")).first()[0]
    rest = common.where(F.col("n") * 10 < total).agg(F.max("n")).first()[0]
    assert total == 1000 and common.where(F.col("n") * 10 >= total).count() == 1 and rest == 10


def test_lines_awkward_rows(spark, docs):
    assert C.in_order(common_lines.digest(docs).collect()) == C.in_order(brute_lines([(r[0], r[1]) for r in C.rows()]))
    clash = C.documents(spark, clash=True)
    for c in ("lines", "known", "gone_doc", "gone_key", "gone_at", "n_lines", "digest", "pos"):
        clash = clash.withColumn(c, F.lit("kept"))
    out = common_lines.drop_common_lines(clash)
    assert out.columns == [*clash.columns, "lines_"] and out.where("lines <> 'kept' or pos <> 'kept' or known <> 'kept'").count() == 0
    assert out.where("text is null").count() == clash.where("text is null").count()
    assert common_lines.digest(spark.createDataFrame([], C.SCHEMA)).collect() == []


# codes

def brute_codes(rows, entries=16, parts=8, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    ints = [(r[0], [math.floor(4096 * float(np.float32(v))) for v in r[1]], r[2]) for r in kept]
    if not ints:
        return [], []
    width = len(ints[0][1]) // parts
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def nearest(part, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), j) for j, e in enumerate(books[part]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in ints:
                piece = v[p * width:(p + 1) * width]
                groups[nearest(p, piece)[1]].append(piece)
            new.append([[sum(c) // len(groups[j]) for c in zip(*groups[j])] if groups[j] else e for j, e in enumerate(books[p])])
        books = new
    out = []
    for doc, v, label in ints:
        found = [nearest(p, v[p * width:(p + 1) * width]) for p in range(parts)]
        out.append((doc, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    by_label = defaultdict(int)
    for r in out:
        by_label[r[3]] += r[2]
    flat = ",".join(str(c) for book in books for e in book for c in e)
    return [(a, b, c, by_label[d], sha(flat)) for a, b, c, d in out], books


def vectors(n, width, seed=3):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(8 * width)] for _ in range(5)]
    rows = [(i * 3 % 101, [rnd.choice(middles)[k] + rnd.gauss(0, .05 if i % 2 else 1e-4) for k in range(8 * width)], rnd.choice([None, 1, 2, 3])) for i in range(n)]
    rows += rows[:5]                                                       # repeated rows and ids
    rows += [(i, rows[0][1], 1) for i in (-1, -1, -2)] + [(None, rows[3][1], 1), (0, [0.0] * 8 * width, None)]
    rows += [(7, None, 1), (-9, [None] + [0.0] * (8 * width - 1), 1), (-8, [float("nan")] * 8 * width, 1), (-7, [float("inf")] + [1.0] * (8 * width - 1), 2)]
    rows += [(200 + i, [-5.5 - i % 2] * 8 * width, 4) for i in range(70)]     # whole blocks with one entry left
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n,width,block,chunk", [(150, 2, 32, 1 << 19), (90, 3, 4, 640), (120, 1, 1, 96), (6, 2, 32, 1 << 19)])
def test_vector_codes(spark, monkeypatch, n, width, block, chunk):
    rows = vectors(n, width)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    monkeypatch.setattr(vector_codes, "CHUNK_VALUES", chunk)
    got = C.in_order(vector_codes.digest(df).collect())
    assert got == C.in_order(brute_codes(rows)[0])


def test_shortlists_lose_no_nearest_entry():
    """Kernels over blocks against all distances, for several block sizes; some blocks are assigned whole."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (300, 3)), rng.integers(4000, 4003, (200, 3)), np.zeros((65, 3), dtype=np.int64)])
    entries = np.concatenate([rng.integers(-60, 60, (9, 3)), [[4001, 4001, 4001], [4001, 4001, 4001]], [[0, 0, 0]]])
    dist = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    blocks = vector_codes.Blocks.of(points)
    index, error = blocks.codes(entries)
    assert (index == dist.argmin(axis=1)).all() and (error == dist.min(axis=1)).all()
    sums, counts = blocks.moved(entries)
    assert (counts == np.bincount(dist.argmin(axis=1), minlength=len(entries))).all()
    assert all((sums[j] == points[dist.argmin(axis=1) == j].sum(axis=0)).all() for j in range(len(entries)))
    listed = blocks.shortlists(entries)
    assert (listed.sum(axis=1) == 1).any() and listed.mean() < .6


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_order_is_a_curve(d, bits):
    """On a full grid, neighbours on the curve are neighbours in space."""
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    grid = np.random.default_rng(2).permutation(grid)
    walked = grid[vector_codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).mean() > .95 if d == 2 else True
    assert np.abs(np.diff(walked, axis=0)).sum() < np.abs(np.diff(grid, axis=0)).sum() / 2


def test_vector_codes_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.digest(empty).collect() == []
    bad = spark.createDataFrame([(1, None, None), (2, [float("nan")] * 8, 1)], VECTORS)
    assert vector_codes.digest(bad).collect() == []
    rows = vectors(20, 1)
    clash = spark.createDataFrame(rows, VECTORS)
    for c in ("code", "n", "dim", "points", "first", "rows", "id", "vector", "row"):
        clash = clash.withColumn(c, F.lit("kept"))
    out, books = vector_codes.compress_vectors(clash)
    assert out.columns == [c for c in clash.columns if c != "embedding"] + ["code_"] and books.shape == (8, 16, 1)
    want, brute = brute_codes(rows)
    assert sorted((str(r.vec_id), r.code_.code, r.code_.error) for r in out.collect()) == sorted((str(a), b, c) for a, b, c, *_ in want)
    assert books.tolist() == brute and out.where("rows <> 'kept'").count() == 0
    for wrong in ([1.0] * 7, [1e30] * 8):
        with pytest.raises(Exception, match="one length|too large"):
            vector_codes.compress_vectors(spark.createDataFrame([(1, wrong, 1)], VECTORS))[0].collect()


# manifest

def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))

    def grow(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def sides(levels, at):
        out = []
        for level in levels[:-1]:
            lo = at // 16 * 16
            out.append(("".join(level[lo:at]), "".join(level[at + 1:lo + 16])))
            at //= 16
        return out
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), ) for s in names}
    levels = {s: grow([x[2] for x in trees[s][0]]) for s in names}
    top = grow([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(trees[s][0]):
            path = sides(levels[s], at) + sides(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf(r, r[1].translate(LOWER) if r[1] is not None else None) if tampered else own
            for left, right in path:
                acc = sha(left + acc + right)
            root = top[-1][0]
            out.append((r[0], own, levels[s][-1][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return out


def many_rows():
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "", "Text Ä", "low"]) if i % 7 else f"T{i}", rnd.choice(["en", None]), "hot" if i % 3 else f"s{i % 40}", rnd.choice([None, i])) for i in range(700)]
    return rows + [(5, "Again", None, "hot", 1), (5, "Other", None, "hot", 1)] + [(None, "Null id", None, None, None)] * 20 + [(None, None, None, "hot", 2), (-3, "X", "a", "", 0), (900, "Q", "a", "é", 1), (901, "Q", "a", "z\U0001F600", 1)]


def test_manifest_against_brute_force(spark):
    rows = many_rows()
    df = spark.createDataFrame(rows, C.SCHEMA).repartition(4)
    got = C.in_order(manifest.digest(df).collect())
    assert got == C.in_order(brute_manifest(rows))
    assert C.in_order(manifest.digest(df.repartition(2)).collect()) == got


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"Doc {i}", "en", "one", i) for i in range(n)]
    assert C.in_order(manifest.digest(spark.createDataFrame(rows, C.SCHEMA)).collect()) == C.in_order(brute_manifest(rows))


def test_manifest_nodes_are_nested(spark):
    built = manifest.build(spark.createDataFrame(many_rows(), C.SCHEMA), carry={"doc_id": F.col("doc_id")})
    nodes = built.nodes().collect()
    for tree in {n.tree for n in nodes}:
        mine = [n for n in nodes if n.tree == tree]
        for level in range(max(n.level for n in mine)):
            below = [n for n in mine if n.level == level]
            for n in below:
                over = [p for p in mine if p.level == level + 1 and p.lo <= n.lo and n.hi <= p.hi]
                assert len(over) == 1
        assert sorted(n.lo for n in mine if n.level == 0) == list(range(len([n for n in mine if n.level == 0])))
    rows = built.proofs()
    assert rows.columns == ["leaf", "doc_id", "subroot", "path"]
    assert rows.where(manifest.folded(F.col("leaf"), F.col("path")) != F.lit(built.root)).count() == 0


def test_manifest_awkward_tables(spark, docs):
    assert C.in_order(manifest.digest(docs).collect()) == C.in_order(brute_manifest(C.rows()))
    assert C.in_order(manifest.digest(C.documents(spark, clash=True).withColumn("tree", F.lit(1)).withColumn("hash", F.lit(1))).collect()) == C.in_order(brute_manifest(C.rows()))
    empty = manifest.build(spark.createDataFrame([], C.SCHEMA))
    assert empty.root is None and manifest.digest(spark.createDataFrame([], C.SCHEMA)).collect() == []
