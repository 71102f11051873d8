"""The ``lt-sql`` lane hash in built-in SQL functions.

A cell's seed is sha-256 over ``'<cell>:' || payload`` and each group of 16 lanes takes its
256 bits (further groups hash the digest with a counter). A digest is kept as signed 64-bit
words, four lanes of 16 bits per word, most significant first; words of holes are NULL. An
accumulator is the lane-wise sum modulo 65,536, stored as binary, low byte first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cells import col, is_hole

LANES = 16
MOD = 65536


def word_names(lanes: int = LANES, prefix: str = "_w") -> list[str]:
    if lanes < 16 or lanes % 16:
        raise ValueError("lanes must be a positive multiple of 16")
    return [f"{prefix}{i}" for i in range(lanes // 4)]


def seed_digest(cell, payload, cell_size: int | None = None) -> Column:
    """sha-256 hex of a cell's position and content; NULL for a hole."""
    keyed = F.concat(F.concat(col(cell).cast("string"), F.lit(":")).cast("binary"), col(payload))
    return F.when(~is_hole(payload, cell_size), F.sha2(keyed, 256))


def digest_words(digest: str, lanes: int = LANES, prefix: str = "_w") -> dict[str, Column]:
    """Words of the digest column, as named columns (to be used with ``withColumns``)."""
    out = {}
    for i, name in enumerate(word_names(lanes, prefix)):
        group, at = divmod(i, 4)
        h = digest if group == 0 else f"sha2(concat({digest}, ':{group}'), 256)"
        # a negative target base makes conv return the signed value, which fits BIGINT
        out[name] = F.expr(f"cast(conv(substring({h}, {16 * at + 1}, 16), 16, -10) as bigint)")
    return out


def _word_lane(word: str, j: int) -> str:
    return f"(shiftright({word}, {48 - 16 * j}) & 65535L)"


def word_lane(word: str, j: int) -> Column:
    """Lane ``j`` (0..3, most significant first) of a word; NULL words give NULL."""
    return F.expr(_word_lane(word, j))


def lane_names(lanes: int = LANES, prefix: str = "_l") -> list[str]:
    return [f"{prefix}{i}" for i in range(lanes)]


def lane_totals(lanes: int = LANES, plus: str = "_w", minus: str | None = None,
                out: str = "_l") -> list[Column]:
    """Aggregates: sum of the lanes of the ``plus`` words less those of the ``minus`` words.

    Sums are BIGINT: a lane contributes less than 2^16 per cell, so 10^14 cells fit. They
    combine on the map side like any SQL sum.
    """
    res = []
    for i in range(lanes):
        w, j = divmod(i, 4)
        total = f"coalesce({_word_lane(f'{plus}{w}', j)}, 0L)"
        if minus:
            total += f" - coalesce({_word_lane(f'{minus}{w}', j)}, 0L)"
        res.append(F.expr(f"sum({total}) as {out}{i}"))
    return res


def pack_lanes(lanes: int = LANES, prefix: str = "_l") -> Column:
    """Lane columns (any BIGINT) -> accumulator binary: four hex digits each, low byte first."""
    values = f"transform(array({', '.join(lane_names(lanes, prefix))}), v -> pmod(coalesce(v, 0L), {MOD}L))"
    digits = f"transform({values}, v -> lpad(hex(((v & 255L) << 8) | shiftright(v, 8)), 4, '0'))"
    return F.expr(f"unhex(array_join({digits}, ''))")


def zero_acc(lanes: int = LANES) -> Column:
    return F.lit(bytes(2 * lanes))


def _combine(a, b, sign: int) -> Column:
    a, b = col(a), col(b)

    def at(x, i):
        h = F.hex(F.substring(x, i * 2 + 1, F.lit(2)))
        return F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")

    def lane(i):
        v = F.pmod(at(a, i) + at(b, i) * sign, F.lit(MOD))
        swapped = F.shiftleft(v.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(v, 8))
        return F.lpad(F.hex(swapped), 4, "0")

    index = F.sequence(F.lit(0), F.call_function("div", F.octet_length(a), F.lit(2)).cast("int") - 1)
    return F.unhex(F.array_join(F.transform(index, lane), ""))


def acc_add(a, b) -> Column:
    """Lane-wise sum of two accumulators of equal width."""
    return _combine(a, b, 1)


def acc_sub(a, b) -> Column:
    """Lane-wise difference: the exact inverse of ``acc_add``."""
    return _combine(a, b, -1)


def acc_digest(acc) -> Column:
    """Short form for display: sha-256 of the accumulator bytes, lowercase hex."""
    return F.sha2(col(acc), 256)


def acc_to_text(acc) -> Column:
    return F.lower(F.hex(col(acc)))


def acc_from_text(text, lanes: int) -> Column:
    """Accumulator binary, or NULL when the text has the wrong length or is not hex."""
    t = col(text)
    ok = t.rlike(f"^[0-9a-fA-F]{{{4 * lanes}}}$")
    return F.when(ok, F.unhex(t))
