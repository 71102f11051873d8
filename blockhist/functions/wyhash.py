"""The ``lt-wy`` lane hash: 64-bit wyhash seeds stretched into 1,024 lanes, in NumPy.

Everything here works on whole Arrow batches: seeds for all cells of one length at once,
lanes for a block of seeds at once, and one modular sum per (dataset, version) and batch.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Tasks receive the code of this module with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the wyhash/wyrand algorithm (public domain); stored hashes depend on them.
SECRET = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

WY_LANES = 1024
BLOCK = 128          # seeds stretched together: the temporaries stay in the CPU cache
HELD_KEYS = 4096     # accumulators held per task before they are emitted as partial sums


def _product(a, b):
    """Low and high half of the 128-bit product, from 32-bit limb products."""
    low32 = np.uint64(0xFFFFFFFF)
    half = np.uint64(32)
    a0, a1 = a & low32, a >> half
    b0, b1 = b & low32, b >> half
    cross1, cross2 = a0 * b1, a1 * b0
    carry = ((a0 * b0) >> half) + (cross1 & low32) + (cross2 & low32)
    return a * b, a1 * b1 + (cross1 >> half) + (cross2 >> half) + (carry >> half)


def _mix(a, b):
    low, high = _product(a, b)
    return low ^ high


def _words(rows, start, count=1):
    """``count`` little-endian 64-bit words of every row, from byte ``start``."""
    part = np.ascontiguousarray(rows[:, start:start + 8 * count])
    return part.view("<u8")


def _short_word(rows, start):
    return np.ascontiguousarray(rows[:, start:start + 4]).view("<u4")[:, 0].astype(np.uint64)


def _hash_equal_length(rows, index):
    """wyhash of each row of a (cells x bytes) matrix, keyed by ``index``."""
    n, size = rows.shape
    k = [np.uint64(v) for v in SECRET]
    state = index ^ k[0]
    if size > 16:
        at = 0
        if size > 48:
            # three independent streams, advanced together as columns of one matrix
            streams = np.repeat(state[:, None], 3, axis=1)
            key = np.array(SECRET[1:4], dtype=np.uint64)
            rounds = (size - 1) // 48
            body = _words(rows, 0, 6 * rounds).reshape(n, rounds, 3, 2)
            for r in range(rounds):
                streams = _mix(body[:, r, :, 0] ^ key, body[:, r, :, 1] ^ streams)
            state = streams[:, 0] ^ streams[:, 1] ^ streams[:, 2]
            at = 48 * rounds
        while size - at > 16:
            pair = _words(rows, at, 2)
            state = _mix(pair[:, 0] ^ k[1], pair[:, 1] ^ state)
            at += 16
        tail = _words(rows, size - 16, 2)
        first, second = tail[:, 0], tail[:, 1]
    elif size >= 4:
        step = 4 * (size // 8)
        up = np.uint64(32)
        first = (_short_word(rows, 0) << up) | _short_word(rows, step)
        second = (_short_word(rows, size - 4) << up) | _short_word(rows, size - 4 - step)
    else:
        wide = rows.astype(np.uint64)
        first = (wide[:, 0] << np.uint64(16)) | (wide[:, size // 2] << np.uint64(8)) | wide[:, size - 1]
        second = np.zeros(n, dtype=np.uint64)
    low, high = _product(first ^ k[1], second ^ state)
    return _mix(low ^ k[0] ^ np.uint64(size), high ^ k[1])


def cell_seeds(index, payload: pa.Array):
    """Seed of every cell: 0 for holes, and never 0 or all ones for content."""
    payload = payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload
    payload = payload.cast(pa.large_binary())
    n = len(payload)
    seeds = np.zeros(n, dtype=np.uint64)
    if n == 0:
        return seeds
    offsets = np.frombuffer(payload.buffers()[1], dtype=np.int64)[payload.offset:payload.offset + n + 1]
    data = payload.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    sizes = np.where(np.asarray(payload.is_null()), 0, sizes)
    index = np.asarray(index).astype(np.int64).view(np.uint64)
    for size in np.unique(sizes[sizes > 0]):
        picked = np.flatnonzero(sizes == size)
        step = max(1, (1 << 21) // int(size))
        for lo in range(0, len(picked), step):
            part = picked[lo:lo + step]
            first, last = offsets[part[0]], offsets[part[-1] + 1]
            if last - first == size * len(part):
                rows = raw[first:last].reshape(len(part), size)
            else:
                rows = raw[offsets[part][:, None] + np.arange(size)]
            live = rows.any(axis=1)
            if not live.any():
                continue
            h = _hash_equal_length(rows[live], index[part[live]])
            h[(h == 0) | (h == np.uint64(0xFFFFFFFFFFFFFFFF))] = 1
            seeds[part[live]] = h
    return seeds


def stretch(seeds, lanes: int = WY_LANES):
    """Lanes of each seed as a (seeds x lanes) matrix of 16-bit integers."""
    step = np.uint64(SECRET[0]) * np.arange(1, lanes // 4 + 1, dtype=np.uint64)
    s = seeds[:, None] + step[None, :]
    return _mix(s, s ^ np.uint64(SECRET[1])).astype("<u8").view("<u2")


def _group_sums(lanes_of_rows, group, n_groups):
    """Sum of the rows of each group modulo 2^16."""
    order = np.argsort(group, kind="stable")
    sorted_groups = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    sums = np.add.reduceat(lanes_of_rows[order], starts, axis=0, dtype=np.uint16)
    return sorted_groups[starts], sums


def partial_sums(batches, keys: list[str], roles: list[tuple[str, int]], lanes: int = WY_LANES):
    """Per-task partial accumulators.

    Each batch holds ``keys``, ``seed`` and one version column per role; a role is
    (column, sign): the seed's lanes are added with that sign to the accumulator of that
    version. A seed is stretched once, whatever the number of roles. The number of held
    accumulators is bounded; what is full is emitted as a partial sum.
    """
    held = {}

    def emit():
        names = list(held)
        arrays = [pa.array([n[i] for n in names], type=types[i]) for i in range(len(keys) + 1)]
        arrays.append(pa.array([held[n].tobytes() for n in names], type=pa.binary()))
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, names=keys + ["_v", "acc"])

    types = None
    for batch in batches:
        if types is None:
            types = [batch.schema.field(k).type for k in keys] + [pa.int32()]
        seeds = batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        frame = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
        for column, sign in roles:
            frame[column] = batch.column(column).to_pandas()
        live = np.flatnonzero(seeds)
        for lo in range(0, len(live), BLOCK):
            part = live[lo:lo + BLOCK]
            matrix = stretch(seeds[part], lanes)
            rows = frame.iloc[part]
            for column, sign in roles:
                used = rows[column].notna().to_numpy()
                if not used.any():
                    continue
                named = rows.loc[used, keys + [column]]
                group, uniques = pd.MultiIndex.from_frame(named).factorize()
                which, sums = _group_sums(matrix[used], group, len(uniques))
                for g, total in zip(which, sums):
                    name = uniques[g][:-1] + (int(uniques[g][-1]),)
                    total = total if sign > 0 else (0 - total).astype(np.uint16)
                    if name in held:
                        held[name] += total
                    else:
                        held[name] = total.copy()
            if len(held) > HELD_KEYS:
                yield emit()
    if held:
        yield emit()


def streamed_totals(batches, keys: list[str]):
    """Sum of ``acc`` per run of equal ``keys``; input sorted by them; one accumulator held."""
    current, total, types = None, None, None
    done_keys, done = [], []

    def flush():
        arrays = [pa.array([n[i] for n in done_keys], type=types[i]) for i in range(len(keys))]
        arrays.append(pa.array(done, type=pa.binary()))
        done_keys.clear()
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, names=keys + ["acc"])

    for batch in batches:
        if types is None:
            types = [batch.schema.field(k).type for k in keys]
        names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        for name, acc in zip(names, batch.column("acc").to_pylist()):
            lanes = np.frombuffer(acc, dtype="<u2")
            if name == current:
                total += lanes
            else:
                if current is not None:
                    done_keys.append(current)
                    done.append(total.tobytes())
                current, total = name, lanes.copy()
        if len(done) >= 1024:
            yield flush()
    if current is not None:
        done_keys.append(current)
        done.append(total.tobytes())
    if done:
        yield flush()


def streamed_running(batches, keys: list[str], out: str, inclusive: bool):
    """Running sum of ``acc`` per run of equal ``keys``, in input order."""
    current, total = None, None
    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        res = []
        for name, acc in zip(names, batch.column("acc").to_pylist()):
            if name != current:
                current, total = name, None
            if total is None:
                total = np.zeros(len(acc) // 2, dtype="<u2")
            before = total.tobytes()
            total = total + np.frombuffer(acc, dtype="<u2")
            res.append(total.tobytes() if inclusive else before)
        yield batch.append_column(out, pa.array(res, type=pa.binary()))


def add_accs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise sum of two accumulator columns; NULL counts as zero."""
    res = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if x is None or y is None:
            res.append(x if y is None else y)
        else:
            res.append((np.frombuffer(x, "<u2") + np.frombuffer(y, "<u2")).astype("<u2").tobytes())
    return pa.array(res, type=pa.binary())


def negated_accs(a: pa.Array) -> pa.Array:
    """Lane-wise negatives modulo 2^16; NULL stays NULL."""
    return pa.array([None if x is None else (0 - np.frombuffer(x, "<u2")).astype("<u2").tobytes() for x in a.to_pylist()], type=pa.binary())
