"""Array expressions that stay linear in the length of the array (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block in ``running``.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, ``value`` being computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def running(array: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Prefix values of an associative ``step``, first element included; ``array`` must not be empty.

    Appending to an array copies it, so prefixes are built per block of BLOCK elements, then
    carried over from block to block.
    """
    def append(acc, x):
        return F.concat(acc, F.array(step(F.coalesce(last(acc), zero), x)))

    def blocks(a):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")),
                           lambda b: F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), empty(kind), append))

    def carried(local):
        carry = F.aggregate(local, F.array(zero), lambda acc, l: F.concat(acc, F.array(step(last(acc), last(l)))))
        return let(carry, lambda c: F.flatten(F.transform(local, lambda l, b: F.transform(l, lambda x: step(F.get(c, b), x)))))
    return let(array, lambda a: let(blocks(a), carried))
