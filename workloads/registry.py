"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None, text: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name``.

    Columns in ``text`` are integers that may be NULL; both sides give them as text, so that
    no tool turns them into floating point.
    """
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if text:
            QUERIES[name] = lambda spark, sf: fn(spark, sf).withColumns({c: F.col(c).cast("string") for c in text})
        if sql is not None:
            SQL[name] = sql
            if text:
                casts = ", ".join(f"cast({c} as varchar) as {c}" for c in text)
                SQL[name] = f"select * replace ({casts}) from ({sql})"
        return fn
    return add
