"""Column helpers for cells, sizes and holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Integer division (no rounding through doubles)."""
    return F.call_function("div", col(a), b if isinstance(b, Column) else F.lit(b))


def zeros(n: int) -> Column:
    """A literal of ``n`` zero bytes."""
    return F.lit(bytes(n))


def is_hole(payload, cell_size: int | None = None) -> Column:
    """True for NULL, empty and all-zero payloads: the three spellings of a hole.

    With ``cell_size`` the payload is compared with one literal (a short one with a slice of it), otherwise a
    zero string of the payload's own length is built.
    """
    p = col(payload)
    if cell_size is None:
        same = p == F.rpad(F.lit(b""), F.octet_length(p), F.lit(b"\0"))
    else:
        same = F.when(F.octet_length(p) == cell_size, p == zeros(cell_size)).otherwise(
            p == F.substring(zeros(cell_size), F.lit(1), F.octet_length(p)))
    return p.isNull() | same


def hole_to_null(payload, cell_size: int | None = None) -> Column:
    return F.when(~is_hole(payload, cell_size), col(payload))


def pad_cell(payload, cell_size: int) -> Column:
    """Zero-pad a payload to the full cell; a full one is not copied."""
    p = col(payload)
    return F.when(F.octet_length(p) == cell_size, p).otherwise(F.rpad(p, F.lit(cell_size), F.lit(b"\0")))


def full_cell(payload, cell_size: int) -> Column:
    """The payload as a full cell: what is missing reads as zero; a longer payload fails the job."""
    p = col(payload)
    text = F.concat(F.lit(f"payload longer than the cell of {cell_size} bytes: "), F.octet_length(p).cast("string"))
    return (F.when(F.octet_length(p) == cell_size, p)
            .when(F.octet_length(p) > cell_size, F.raise_error(text).cast("binary"))
            .otherwise(F.rpad(p, F.lit(cell_size), F.lit(b"\0"))))


def align_size(size, grain: int) -> Column:
    """Round a size up to a multiple of ``grain``."""
    return idiv(col(size) + F.lit(grain - 1), grain) * F.lit(grain)


def cell_count(size, cell_size: int) -> Column:
    return idiv(col(size) + F.lit(cell_size - 1), cell_size)


def short_name(name) -> Column:
    """``ds@snap``, ``@snap`` and ``snap`` all name ``snap``."""
    c = col(name)
    at = F.instr(c, "@")
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)


def generated(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generated row.

    A plain projection would be merged into the filters and projections above it, which
    evaluates its expressions once per use; and separate steps keep the generated code small
    enough for the JVM to compile.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
