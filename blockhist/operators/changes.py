"""Change records: classification, rejection, clamping, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cells import generated, idiv
from .ranges import cells_in_ranges

# Fixed values of the change-log format.
IGNORED_KEYWORDS = ["BEGIN", "END", "OBJECT"]
DATA_OBJECT = 1
PROPERTY_OBJECT = 2
FREED_OBJECTS = (3, 32)                                  # first, end (exclusive)
LENGTH_FIELDS = ["logical_size", "lsize", "length"]      # the first one present counts
DRIFT_FLOOR = 128 * 1024                                 # bytes
DRIFT_SHARE = 10                                         # a tenth of the estimate

_UNSIGNED = r"^[0-9]+$"
_SIGNED = r"^-?[0-9]+$"


def _number(name: str, pattern: str = _UNSIGNED) -> Column:
    """Strictly numeric text as BIGINT, else NULL (also when it does not fit)."""
    return F.expr(f"case when {name} rlike '{pattern}' then try_cast({name} as bigint) end")


def judged(records: DataFrame) -> DataFrame:
    """Add ``op``, ``off``, ``len`` and ``reason`` to parsed records.

    ``reason`` is set on records that must not be skipped silently; records with neither
    ``op`` nor ``reason`` carry no data.
    """
    def field(name):
        return F.try_element_at("fields", F.lit(name))
    is_free, is_write = F.col("keyword") == "FREE", F.col("keyword").startswith("WRITE")
    texts = generated(records, _object=field("object"), _offset=field("offset"),
                     _length=F.when(is_free, field("length")).otherwise(F.coalesce(*[field(n) for n in LENGTH_FIELDS])),
                     _first=field("firstobj"), _count=field("numobjs"))
    numbers = generated(texts, _o=_number("_object"), off=_number("_offset"), len=_number("_length", _SIGNED),
                       _f=_number("_first"), _n=_number("_count"))

    freed_reason = (F.when(F.expr("_f is null or _n is null"), "not a number")
                     .when(~((F.col("_f") == FREED_OBJECTS[0]) & (F.col("_n") == FREED_OBJECTS[1] - FREED_OBJECTS[0])),
                           "unexpected object range"))
    range_reason = (
        F.when(F.expr("_object is null"), "field missing")
         .when(F.expr("_o is null"), "not a number")
         .when(F.col("_o") == PROPERTY_OBJECT, F.lit(None))
         .when(F.col("_o") != DATA_OBJECT, "unexpected object")
         .when(F.expr("_offset is null"), "field missing")
         .when(F.expr("off is null"), "not a number")
         .when(F.expr("_length is null"), F.when(is_free, "field missing").otherwise("no length"))
         .when(F.expr("len is null"), "not a number"))
    reason = (F.when(F.col("keyword").isin(IGNORED_KEYWORDS), F.lit(None))
               .when(F.col("keyword") == "REDACT", "redacted")
               .when(F.col("keyword") == "FREEOBJECTS", freed_reason)
               .when(is_free | is_write, range_reason)
               .otherwise("unknown keyword"))
    op = F.when(F.col("_o") == DATA_OBJECT, F.when(is_free, "FREE").when(is_write, "WRITE"))
    verdict = generated(numbers, reason=reason, _op=op)
    return verdict.withColumn("op", F.when(F.col("reason").isNull(), F.col("_op"))).select(
        *records.columns, "reason", "op", "off", "len")


def classify_changes(records: DataFrame) -> DataFrame:
    """The data changes ``(dataset, ord, seq, op, off, len)``; ``len`` -1 = to the end."""
    return judged(records).filter(F.col("op").isNotNull()).select("dataset", "ord", "seq", "op", "off", "len")


def quarantine_changes(records: DataFrame) -> DataFrame:
    """Records that are not understood, with the raw line and a reason."""
    return (judged(records).filter(F.col("reason").isNotNull())
            .select("dataset", "ord", "seq", F.col("line").alias("raw"), "reason"))


def strict_changes(records: DataFrame) -> DataFrame:
    """Like ``classify_changes``, but the job fails on the first record not understood."""
    j = judged(records)
    message = F.concat_ws(" ", F.col("reason"), F.lit("in:"), F.col("line"))
    op = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("op"))
    return j.withColumn("op", op).filter(F.col("op").isNotNull()).select("dataset", "ord", "seq", "op", "off", "len")


def past_end(size: Column) -> Column:
    """Why a version of this size cannot hold a record; NULL for frees and for writes that fit."""
    reason = (F.when(size.isNull(), "no such version").when(F.col("off") >= size, "starts past the end")
               .when(F.col("len") > size - F.col("off"), "runs past the end"))
    return F.when(F.expr("op = 'WRITE' and len <> 0"), reason)


def cut_at(changes: DataFrame, size: Column) -> DataFrame:
    """Ranges cut at ``size``; what starts there or later, or is empty, goes."""
    room = size - F.col("off")
    # compare with the room left instead of off + len, which may overflow
    cut = F.when((F.col("len") < 0) | (F.col("len") > room), room).otherwise(F.col("len"))
    return changes.filter((F.col("off") < size) & (F.col("len") != 0)).withColumn("len", cut)


def writes_past_end(changes: DataFrame, versions: DataFrame, size: str = "size") -> DataFrame:
    """Writes that the version cannot hold: ``(dataset, ord, seq, off, len, reason)``.

    The log and the image then disagree about the dataset, and cutting such a write would lose data
    without a word. A free may reach past the end, and a write up to the end (-1) fits any size.
    """
    sizes = versions.select("dataset", "ord", F.col(size).alias("_size"))
    return (changes.join(sizes, ["dataset", "ord"], "left")
            .withColumn("reason", past_end(F.col("_size"))).filter("reason is not null")
            .select("dataset", "ord", "seq", "off", "len", "reason"))


#: Bytes of a page on which writes past the end meet the frees that may remove them.
PAGE = 1 << 20


def _end(top: Column) -> Column:
    """End of a range, at most ``top``; an open range ends there. No sum that could overflow."""
    room = F.greatest(top - F.col("off"), F.lit(0).cast("long"))
    return F.col("off") + F.when((F.col("len") < 0) | (F.col("len") > room), room).otherwise(F.col("len"))


def lost_writes(changes: DataFrame, versions: DataFrame, size: str = "size") -> DataFrame:
    """Writes of which bytes past the end of their version are left after all its later frees:
    ``(dataset, ord, seq, off, len, reason)``.

    A version that was bigger for a while logs writes that it takes back before it ends; its log is
    right all the same. Most are taken back by one free that covers everything past the end, found by
    an aggregate. The others meet later frees page by page: what the frees leave is judged by the ends
    of the frees before each one in the order of their starts.
    """
    key = ["dataset", "ord"]
    bad = writes_past_end(changes, versions, size).filter("off >= 0")
    tops = changes.filter("op = 'WRITE' and len > 0").groupBy(*key).agg(
        F.max(F.col("off") + F.least(F.col("len"), F.lit((1 << 62) - 1) - F.col("off"))).alias("_top"))
    sizes = versions.select(*key, F.col(size).alias("_size"))
    frees = (changes.filter("op = 'FREE' and len <> 0").join(tops, key).join(sizes, key)
             .withColumn("_to", _end(F.col("_top"))).filter("_to > _size and _to > off"))
    cover = frees.groupBy(*key).agg(F.max(F.when(F.expr("off <= _size and _to >= _top"), F.col("seq"))).alias("_tail"),
                                    F.sum(F.expr("_to - greatest(off, _size)")).alias("_freed"))
    left = (bad.join(cover, key, "left").join(sizes, key, "left")
            .filter("_tail is null or seq > _tail")
            .withColumn("_from", F.greatest("off", F.coalesce("_size", F.lit(0))))
            .withColumn("_long", F.expr("coalesce(_freed, 0) < len - (_from - off)")))
    # more bytes than all frees together hold, or no frees at all: nothing to look up
    surely = left.filter("_long or _size is null").select(*bad.columns)
    open_ = left.filter("not _long and _size is not null")
    pieces = open_.select(*bad.columns, "_from", (F.col("off") + F.col("len")).alias("_to"), F.explode(
        F.sequence(idiv("_from", PAGE), idiv(F.col("off") + F.col("len") - 1, PAGE))).alias("_page"))
    pieces = pieces.withColumns({"_from": F.greatest(F.col("_from"), F.col("_page") * PAGE),
                                 "_to": F.least(F.col("_to"), F.col("_page") * PAGE + PAGE)})
    wanted = pieces.select("dataset", "_page").distinct()
    spans = frees.select(*key, "seq", F.greatest("off", "_size").alias("off"), "_to").withColumn("len", F.expr("_to - off"))
    met = (cells_in_ranges(spans, wanted.withColumnRenamed("_page", "cell"), PAGE)
           .groupBy(*key, F.col("cell").alias("_page"), F.greatest("off", F.col("cell") * PAGE).alias("_a"),
                    F.least("_to", F.col("cell") * PAGE + PAGE).alias("_b")).agg(F.max("seq").alias("_seq")))
    pairs = (pieces.join(met, key + ["_page"], "left")
             .withColumns({c: F.when(F.expr("_seq > seq and _a < _to and _b > _from"), F.col(c)) for c in ("_a", "_b")}))
    line = Window.partitionBy(*key, "seq", "_page").orderBy(F.col("_a").asc_nulls_last())
    reached = F.coalesce(F.max("_b").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("_from"))
    gaps = (pairs.withColumn("_gap", F.col("_a").isNotNull() & (F.col("_a") > F.greatest(reached, "_from")))
            .groupBy(*bad.columns, "_page", "_from", "_to").agg(F.max("_gap").alias("_gap"), F.max("_b").alias("_b"))
            .filter("_gap or _b is null or _b < _to"))
    return surely.unionByName(gaps.select(*bad.columns).distinct())


def clamp_ranges(changes: DataFrame, versions: DataFrame, size: str = "size") -> DataFrame:
    """Cut ranges at the version's size; an open or overlong range ends there.

    Ranges that start at or past the end, or are empty, go; ``lost_writes`` lists the writes
    that lose bytes by this. ``size`` names the column to cut
    by: the version's own size, or the one rounded up to the new grain.
    """
    sizes = versions.select("dataset", "ord", F.col(size).alias("_size"))
    return cut_at(changes.join(sizes, ["dataset", "ord"]), F.col("_size")).drop("_size")


def change_stats(changes: DataFrame) -> DataFrame:
    """Bytes and records written and freed per version."""
    def total(op, what):
        return F.coalesce(F.sum(F.when(F.col("op") == op, what)), F.lit(0)).cast("long")
    return changes.groupBy("dataset", "ord").agg(
        total("WRITE", F.col("len")).alias("written"), total("FREE", F.col("len")).alias("freed"),
        total("WRITE", F.lit(1)).alias("writes"), total("FREE", F.lit(1)).alias("frees"))


def total_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("dataset").agg(*[F.sum(c).cast("long").alias(c)
                                          for c in ("written", "freed", "writes", "frees")])


def drift_report(estimates: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare estimated and written bytes per version.

    A warning needs a difference above both the floor and a tenth of the estimate; an
    estimate of 0 means unknown. Never an error.
    """
    diff = F.abs(F.col("written") - F.col("estimate"))
    joined = estimates.join(actual.select("dataset", "ord", "written"), ["dataset", "ord"], "left")
    return (joined.withColumn("written", F.coalesce("written", F.lit(0).cast("long")))
            .withColumn("diff", diff)
            .withColumn("drift", (F.col("estimate") > 0) & (F.col("diff") > DRIFT_FLOOR)
                        & (F.col("diff") > F.expr(f"estimate div {DRIFT_SHARE}")))
            .select("dataset", "ord", "estimate", "written", "diff", "drift"))
