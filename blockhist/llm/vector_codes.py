"""Compression of vectors to codes: per part of the vector the index of the nearest of a few codebook entries.

Vectors become integers once and are stored as flat blocks: a chunk of rows is cut into parts, the
pieces of each part are sorted along a Hilbert curve and every BLOCK neighbours share a box (lowest and
highest value of each component), a sum and a count. In every round the distances of a box to the codebook's entries, the
nearest possible and the farthest possible, leave a shortlist per block: an entry whose nearest possible distance is
above the smallest farthest possible one is never the nearest. A block with one entry left is assigned as a whole by its sum;
the others are evaluated by an exact integer kernel per entry over the blocks that list it.

Scale: everything is sums of integers, so the result does not depend on the order or the cutting of the rows, and no row is
shuffled: chunks are made, stored and read where the rows are, each bounded in rows and bytes. (Sorting the whole corpus
along eight curves would give tighter boxes for a shuffle of the whole corpus; a round costs about 1,000 multiplications a row.) A round
returns per task one sum, count and entry index per codebook component, which are added up by Spark; the driver holds the
codebooks (parts x entries rows) alone. Equal labels are summed with map-side combining, and the few
or many sums, written, are joined back to the rows.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .names import free_name

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points that share a box.
BLOCK = 32
#: A chunk ends at so many components or bytes of rows.
CHUNK_VALUES, CHUNK_BYTES = 1 << 19, 1 << 23
#: Components of the Hilbert index: the widest ones of a part.
CURVE_DIMS = 16


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Order of integer points (n, d) along a Hilbert curve through their bounding box.

    Gray code by exchange and inversion of bits from the highest down (the published transpose form of the
    index), then the bits of all components interleaved. Of more than CURVE_DIMS components the widest count.
    """
    n, d = points.shape
    if n < 2 or d == 0:
        return np.arange(n)
    low = points.min(axis=0)
    width = points.max(axis=0) - low
    if d > CURVE_DIMS:
        dims = np.sort(np.argsort(-width, kind="stable")[:CURVE_DIMS])
        points, low, width, d = points[:, dims], low[dims], width[dims], CURVE_DIMS
    bits = min(63 // d, 16)
    x = [((points[:, i] - low[i]) / max(int(width[i]), 1) * ((1 << bits) - 1)).astype(np.uint32) for i in range(d)]
    for level in range(bits - 1, 0, -1):
        top, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            swap = np.where(x[i] & top, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(x[i] & top, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flips = np.zeros(n, dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[d - 1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    index = np.zeros(n, dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            bit = ((x[i] ^ flips) >> np.uint32(level)) & np.uint32(1)
            index = (index << np.uint64(1)) | bit.astype(np.uint64)
    return np.argsort(index, kind="stable")


#: Arrays of a stored block: type and shape of one part of a chunk (count = blocks of BLOCK points, n = rows).
LAYOUT = {"points": np.int32, "orders": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


class Blocks:
    """The pieces of one part in Hilbert order, padded with the last one to whole blocks; ``orders`` names their rows."""

    def __init__(self, n: int, points, orders, low, high, sums):
        self.n, self.points, self.orders, self.low, self.high, self.sums = n, points, orders, low, high, sums
        self.counts = np.full(len(low), BLOCK)
        self.counts[-1] -= len(low) * BLOCK - n

    @classmethod
    def of(cls, pieces: np.ndarray) -> Blocks:
        n, d = pieces.shape
        orders = hilbert_order(pieces)
        count = -(-n // BLOCK)
        pad = count * BLOCK - n
        points = pieces[np.concatenate([orders, np.repeat(orders[-1:], pad)])].reshape(count, BLOCK, d)
        sums = points.sum(axis=1)
        sums[-1] -= points[-1, -1] * pad
        return cls(n, points, orders, points.min(axis=1), points.max(axis=1), sums)

    @classmethod
    def stored(cls, n: int, d: int, part: int, parts: int, buffers: dict) -> Blocks:
        count = -(-n // BLOCK)
        shapes = {"points": (parts, count, BLOCK, d), "orders": (parts, n)}
        return cls(n, **{name: np.frombuffer(buffers[name], dtype=kind).reshape(shapes.get(name, (parts, count, d)))[part].astype(np.int64)
                         for name, kind in LAYOUT.items()})

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(blocks, entries): which entries can be the nearest to a point of the block."""
        e = entries[None, :, :]
        below, above = self.low[:, None, :] - e, e - self.high[:, None, :]
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1, keepdims=True)

    def nearest(self, entries: np.ndarray, need_error: bool):
        """Index of the nearest entry (the lowest of equals) per point and its squared distance, both in curve order.
        Without ``need_error`` blocks with one entry left are not evaluated: (index per block or -1, ...)."""
        listed = self.shortlists(entries)
        single = listed.sum(axis=1) == 1
        whole = np.where(single, listed.argmax(axis=1), -1)
        open_ = np.ones(len(single), dtype=bool) if need_error else ~single
        points = self.points[open_]
        best = np.full(points.shape[:2], np.iinfo(np.int64).max)
        index = np.zeros(points.shape[:2], dtype=np.int64)
        for j in range(len(entries)):
            at = np.flatnonzero(listed[open_, j])
            if len(at):
                diff = points[at] - entries[j]
                dist = np.einsum("bpd,bpd->bp", diff, diff)
                closer = dist < best[at]
                best[at] = np.where(closer, dist, best[at])
                index[at] = np.where(closer, j, index[at])
        return whole, open_, index, best

    def moved(self, entries: np.ndarray):
        """Sums (entries, d) and counts of the points nearest to each entry."""
        whole, open_, index, _ = self.nearest(entries, False)
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
        valid = np.arange(BLOCK)[None, :] < self.counts[open_][:, None]
        points = self.points[open_]
        for j in range(len(entries)):
            block, point = whole == j, (index == j) & valid
            sums[j] = self.sums[block].sum(axis=0) + points[point].sum(axis=0)
            counts[j] = self.counts[block].sum() + point.sum()
        return sums, counts

    def codes(self, entries: np.ndarray):
        """Index and squared distance per row, in the rows' order."""
        _, _, index, best = self.nearest(entries, True)
        out = np.empty(self.n, dtype=np.int64), np.empty(self.n, dtype=np.int64)
        for made, values in zip(out, (index, best)):
            made[self.orders] = values.reshape(-1)[:self.n]
        return out


def floored(column: pa.Array, scale: int, parts: int, dim: int | None):
    """(rows kept, integers (n, dim)): rows without a vector, or with a null or non-finite component, go."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)   # nulls become NaN
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (sizes >= 0) & (bad[starts[1:]] == bad[starts[:-1]])
    kept = np.flatnonzero(good)
    found = set(sizes[kept].tolist()) | ({dim} if dim is not None else set())
    if len(found) > 1 or any(s % parts for s in found):
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {sorted(found)}")
    if not len(kept):
        return kept, np.zeros((0, 0), dtype=np.int64)
    dim = found.pop()
    scaled = np.floor(flat[np.repeat(good, np.maximum(sizes, 0))] * scale).reshape(len(kept), dim)
    if scaled.size and np.abs(scaled).max() > 2 ** (30 - max(dim - 1, 0).bit_length() / 2):
        raise ValueError("a component is too large for exact 64-bit squared distances")
    return kept, scaled.astype(np.int64)


def _chunk(held: list[pa.Array], ids: list, ints: np.ndarray, parts: int, entries: int, row_type, id_type):
    n, dim = ints.shape
    width = dim // parts
    blocks = [Blocks.of(ints[:, p * width:(p + 1) * width]) for p in range(parts)]
    keys = [(v is None, 0 if v is None else v) for v in ids]
    last = heapq.nsmallest(entries, keys)[-1]
    first = sorted((k, ints[i].tolist(), i) for i, k in enumerate(keys) if k <= last)[:entries]
    first_type = pa.list_(pa.struct([("id", id_type), ("vector", pa.list_(pa.int64()))]))
    return pa.record_batch([
        pa.array([n], pa.int32()), pa.array([dim], pa.int32()),
        *[pa.array([b"".join(np.ascontiguousarray(getattr(b, name), dtype=kind).tobytes() for b in blocks)], pa.binary())
          for name, kind in LAYOUT.items()],
        pa.array([[{"id": ids[i], "vector": v} for _, v, i in first]], first_type),
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(held).cast(row_type))],
        names=["n", "dim", *LAYOUT, "first", "rows"])


def chunks(rows: DataFrame, vector: str, order: str, parts: int, entries: int, scale: int) -> DataFrame:
    """One row per chunk: the pieces of all parts in curve order, their rows, the ``entries`` rows of smallest
    ``order`` and all other columns of the rows."""
    carry = [c for c in rows.columns if c != vector]
    packed = rows.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(order).alias("id"), F.col(vector).alias("vector"))

    def run(batches):
        held, ids, ints, size, weight, dim, kinds = [], [], [], 0, 0, None, None
        for batch in batches:
            kinds = batch.column(0).type, batch.column(1).type
            step = max(1, CHUNK_BYTES * batch.num_rows // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                kept, made = floored(part.column(2), scale, parts, dim)
                if not len(kept):
                    continue
                dim = made.shape[1]
                taken = pa.array(kept)
                held.append(part.column(0).take(taken))
                ids += part.column(1).take(taken).to_pylist()
                ints.append(made)
                size, weight = size + made.size, weight + held[-1].nbytes
                if size >= CHUNK_VALUES or weight >= CHUNK_BYTES:
                    yield _chunk(held, ids, np.concatenate(ints), parts, entries, *kinds)
                    held, ids, ints, size, weight = [], [], [], 0, 0
        if held:
            yield _chunk(held, ids, np.concatenate(ints), parts, entries, *kinds)
    schema = T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("dim", T.IntegerType()),
        *[T.StructField(name, T.BinaryType()) for name in LAYOUT],
        T.StructField("first", T.ArrayType(T.StructType([T.StructField("id", packed.schema["id"].dataType),
                                                         T.StructField("vector", T.ArrayType(T.LongType()))]))),
        T.StructField("rows", T.ArrayType(packed.schema["row"].dataType))])
    return materialise(packed.mapInArrow(run, schema), "vector-blocks")


def _blocks(batch, parts: int):
    """Per chunk of a batch its blocks, one per part."""
    column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("n", "dim", *LAYOUT)}
    for i in range(batch.num_rows):
        n, dim = column["n"][i].as_py(), column["dim"][i].as_py()
        buffers = {name: column[name][i].as_buffer() for name in LAYOUT}
        yield [Blocks.stored(n, dim // parts, p, parts, buffers) for p in range(parts)]


def one_round(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, width) after one round of assignment and floored means."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for blocks in _blocks(batch, parts):
                for p, b in enumerate(blocks):
                    s, c = b.moved(books[p])
                    sums[p] += s
                    counts[p] += c
        values = np.concatenate([counts[:, :, None], sums], axis=2)
        used = np.flatnonzero(np.repeat(counts.reshape(-1) > 0, width + 1))
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(values.reshape(-1)[used])], names=["slot", "value"])
    partial = stored.select("n", "dim", *LAYOUT).mapInArrow(run, "slot bigint, value bigint")
    total = np.zeros(parts * entries * (width + 1), dtype=object)
    for r in partial.groupBy("slot").agg(F.sum("value").alias("value")).collect():   # one row per number of the codebooks
        total[r["slot"]] = r["value"]
    total = total.reshape(parts, entries, width + 1)
    new = books.copy()
    for p, e in np.argwhere(total[:, :, 0] > 0):
        new[p, e] = [v // total[p, e, 0] for v in total[p, e, 1:]]
    return new


def compress_vectors(rows: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows with a code, codebooks (parts, entries, width)).

    The rows keep all columns but ``vector`` and get the struct column ``code`` (or ``code_`` ...): code, two hex digits
    per part, and error, the sum of the squared distances. ``scale`` times a component, floored, is an integer; a part's codebook
    starts as that part of the ``entries`` rows smallest by (order, vector), fewer if there are fewer rows, and goes through ``rounds`` rounds.
    Equally near entries: the first one. Entries without points stay.

    Rows whose vector is null or holds a null or non-finite component are dropped. A null order value ranks last;
    rows that share one rank by their vectors; repeated rows count each. An empty table gives no rows and
    codebooks without entries. Vectors of different lengths, of a length that is no multiple of
    ``parts``, or too large for exact 64-bit distances fail the job. Names of other columns cannot clash.
    """
    spark = rows.sparkSession
    out = free_name(rows, "code")
    stored = chunks(rows, vector, order, parts, entries, scale)
    least = (stored.select(F.explode("first").alias("f")).select("f.*")
             .orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect())
    width = len(least[0]["vector"]) // parts if least else 0
    books = np.array([r["vector"] for r in least], dtype=np.int64).reshape(len(least), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds if least else 0):
        books = one_round(stored, books)

    def coded(batches):
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("rows"))
            for i, blocks in enumerate(_blocks(batch, parts)):
                index, error = zip(*[b.codes(books[p]) for p, b in enumerate(blocks)])
                hexed = np.char.mod("%02x", np.stack(index, axis=1))
                codes = ["".join(c) for c in hexed]
                made = pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.sum(error, axis=0))], ["code", "error"])
                own = listed.slice(i, 1).flatten()
                yield pa.record_batch([*own.flatten(), made], names=[*[f.name for f in own.type], out])
    row = stored.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField(out, T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))])
    return stored.select("n", "dim", *LAYOUT, "rows").mapInArrow(coded, schema), books


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def digest(rows: DataFrame) -> DataFrame:
    """Per kept row of embeddings: vec_id, code, error, label_error (errors of all rows of the same label, nulls together),
    codebooks_sha256."""
    coded, books = compress_vectors(rows.select("vec_id", "embedding", "label"))
    coded = materialise(coded.select("vec_id", "label", "code.code", "code.error"), "vector-codes")
    labels = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")))
