"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards by a seeded hash. In every shard equal blocks of ``block`` words are
apportioned to the sources by highest quotients v / (2 j + 1), v being the words the source should
give in that shard; the quotas are integers and never ask for more than ``most`` passes. Within a
(source, shard) the documents lie one after the other in seeded order; the quota takes whole passes
over that stream and a run of blocks that starts at a seeded block. What a document gives is the
overlap of its own interval with that run, a closed form: no block is ever listed.

Sources are a written table, however many there are: their weights follow from their ranks in one range
shuffle, and their targets from a level found by a few sums over that table. A hot source is spread over all
shards, whose number follows the number of rows.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import materialise
from .names import free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def count_words(text):
    """Number of words; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """(source, source_size, place, target) of (source, source_size): shares by weight of ``share`` times all sizes; a
    target that would pass ``most`` times its size stops there and the excess is shared again among the others by weight.

    Sources weigh ``weights`` in turn, in order of name. A source stops below the common level (words per weight)
    at which all is given out; the level only rises, and each step is one sum over the sources.
    """
    cut = ordered.range_chunks(sizes, [], ["source"])
    placed = ordered.row_numbers(cut, [], ["source"], "place", "_chunk").drop("_chunk")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = materialise(placed.withColumn("weight", turn), "mix-sources")
    whole = placed.agg(F.sum("source_size")).first()[0] or 0
    free, level = None, Fraction(0)
    while True:
        full = F.col("source_size") * most < F.col("weight") * F.lit(float(level))
        row = placed.agg(F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                         F.count(F.when(~full, 1)).alias("free")).first()
        if row["free"] == free or not row["free"]:
            break
        free = row["free"]
        level = (share * whole - most * (row["size"] or 0)) / row["weight"]
    of_weight = F.coalesce(*[F.when(F.col("weight") == w, F.lit(float(level * w))) for w in dict.fromkeys(weights)])
    return placed.select("source", "source_size", "place", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(of_weight).alias("target"))


def apportion(votes: list[float], caps: list[int], seats: int, block: float) -> list[int]:
    """Sainte-Lague seats: the ``seats`` highest quotients v / (2 j - 1), at most caps[i] for i.

    All quotients of at least block / 2 are taken at once; the few that are then too many or
    missing are removed from the lowest or added from the highest. Ties go to the earlier index.
    """
    taken = [min(c, int(v / block + 0.5)) for v, c in zip(votes, caps)]
    seats = min(seats, sum(caps))
    if sum(taken) > seats:
        heap = [(v / (2 * n - 1), -i) for i, (v, n) in enumerate(zip(votes, taken)) if n]
        heapq.heapify(heap)
        for _ in range(sum(taken) - seats):
            i = -heapq.heappop(heap)[1]
            taken[i] -= 1
            if taken[i]:
                heapq.heappush(heap, (votes[i] / (2 * taken[i] - 1), -i))
    elif sum(taken) < seats:
        heap = [(-v / (2 * n + 1), i) for i, (v, n, c) in enumerate(zip(votes, taken, caps)) if n < c]
        heapq.heapify(heap)
        for _ in range(seats - sum(taken)):
            i = heapq.heappop(heap)[1]
            taken[i] += 1
            if taken[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * taken[i] + 1), i))
    return taken


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2),
                most: int = 2, block: int = 8, rows_per_shard: int = 2000, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with one more column, the struct ``mix`` (or
    ``mix_`` if that name is taken): size, source_size, target, taken.

    Sources in order of code point, null last, weigh ``weights`` in turn. ``taken`` is at most
    ``most`` times ``size``. A null or empty text has size 0 and gives nothing; an empty table gives
    no rows; repeated rows are separate documents of equal standing; rows of one id and size are told apart by
    their texts. All reruns agree.
    """
    rows = docs.count()
    shards = max(1, -(-rows // rows_per_shard))
    inner = [free_name(docs, f"mix_{c}") for c in ("source", "shard", "size", "order", "start", "text")]
    source, shard, size, order, start, text = inner
    based = docs.withColumns({
        source: F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), "source")),
        size: count_words("text"), order: F.xxhash64(F.lit(seed), "doc_id"), text: F.xxhash64("text")})
    based = based.withColumn(shard, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", size, text), F.lit(shards)).cast("int"))
    cells = materialise(based.groupBy(F.col(source).alias("source"), F.col(shard).alias("shard"))
                        .agg(F.sum(size).alias("words")), "mix-cells")
    known = materialise(source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")

    def quotas(of_shard: pd.DataFrame) -> pd.DataFrame:
        of_shard = of_shard.sort_values("place")
        words = of_shard["words"].astype(int).tolist()
        ideal = [float(t * w / n) if n else 0.0 for t, w, n in zip(of_shard["target"], words, of_shard["source_size"])]
        taken = apportion(ideal, [-(-most * w // block) for w in words], round(sum(ideal) / block), block)
        return of_shard.assign(quota=[min(n * block, most * w) for n, w in zip(taken, words)])[
            ["source", "shard", "words", "quota", "source_size", "target"]]

    quota = cells.join(known, "source").groupBy("shard").applyInPandas(
        quotas, "source string, shard int, words long, quota long, source_size long, target double")
    names_q = {c: f"{free_name(docs, 'quota')}_{c}" for c in quota.columns}
    quota = quota.withColumnsRenamed(names_q)
    w = Window.partitionBy(source, shard).orderBy(order, "doc_id", size, text).rowsBetween(Window.unboundedPreceding, -1)
    laid = based.withColumn(start, F.coalesce(F.sum(size).over(w), F.lit(0)))
    q = {c: F.col(n) for c, n in names_q.items()}
    joined = laid.join(quota, (F.col(source) == q["source"]) & (F.col(shard) == q["shard"]))
    u, v = F.col(start), F.col(start) + F.col(size)
    rest = F.pmod(q["quota"], F.greatest(q["words"], F.lit(1)))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), q["source"], q["shard"]), F.greatest(F.ceil(q["words"] / block), F.lit(1))) * block
    zero = F.lit(0).cast("long")
    run = (F.greatest(F.least(v, first + rest) - F.greatest(u, first), zero)
           + F.greatest(F.least(v, first + rest - q["words"]) - u, zero))
    passes = F.floor(q["quota"] / F.greatest(q["words"], F.lit(1)))
    taken = F.when(F.col(size) > 0, passes * F.col(size) + run).otherwise(zero).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], F.struct(
        F.col(size).alias("size"), q["source_size"].alias("source_size"), q["target"].alias("target"),
        taken.alias("taken")).alias(free_name(docs, "mix")))
