"""Substring dedup by line or paragraph: every unit of text is kept where it ranks first.

A unit is normalised (A-Z lower-cased, white space collapsed) and hashed to 128 bits; the digests of
the whole corpus are grouped; the occurrence with the smallest (doc_id, offset) stays, the others are
removed, their offsets in the original are kept. Removed neighbours form passages.

Scale: texts are read once, in Arrow batches; what is written and shuffled are digests and offsets. Grouping
combines before the shuffle, and only digests seen twice meet the occurrences again, the most
frequent ones by broadcast, so that no join key holds more than a small share of the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .names import free_name, with_struct
from .shares import join_by_share

#: Units of fewer words are left alone. Every unit with a word counts; a higher floor is an option of
#: the caller.
MIN_WORDS = 1
#: A run of neighbouring removed units of more words is a passage.
PASSAGE_WORDS = 50

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
UNITS = pa.struct([("units", pa.list_(pa.struct([
    ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("nth", pa.int32()), ("digest", pa.binary())])))])


def unit_arrays(texts: pa.Array, separator: str, min_words: int) -> list[pa.Array]:
    """For each text its units of at least ``min_words`` words: number of the part, offsets in code points
    (``end`` exclusive), words, number among these units, digest."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), separator)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    steps = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + len(separator)
    ends = np.concatenate([[0], np.cumsum(steps)])
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    places, words, digests = [], [], []
    for i, line in enumerate(flat.cast(pa.binary()).to_pylist()):
        found = line.translate(LOWER).split()          # bytes.split() cuts at \x20 and \x09-\x0D
        if len(found) >= min_words:
            places.append(i)
            words.append(len(found))
            digests.append(hashlib.md5(b" ".join(found), usedforsecurity=False).digest())
    at = np.array(places, dtype=np.int64)
    base = ends[firsts[:-1]][of_text[at]]
    start = ends[at] - base
    units = pa.StructArray.from_arrays(
        [pa.array(at - firsts[of_text[at]], pa.int32()), pa.array(start, pa.int32()), pa.array(ends[at + 1] - len(separator) - base, pa.int32()),
         pa.array(words, pa.int32()), pa.array(np.arange(len(at)) - np.searchsorted(at, firsts)[of_text[at]], pa.int32()), pa.array(digests, pa.binary())], fields=list(UNITS[0].type.value_type))
    return [pa.ListArray.from_arrays(pa.array(np.searchsorted(at, firsts), pa.int32()), units)]


def text_key() -> Column:
    """Tells apart texts under one id."""
    return F.unhex(F.md5("text"))


def units(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, units) of every row, a null text having none; written, because it is read several times."""
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    made = with_struct(keyed, "units", "text", UNITS, lambda: lambda texts: unit_arrays(texts, separator, max(min_words, 1)), ["doc_id", "key"])
    return materialise(made.select("doc_id", "key", "units.units"), "units")


def repeated_units(every: DataFrame) -> DataFrame:
    """Units that another one outranks: (doc_id, key, gone), ``gone`` (unit, start, end, words, nth) in order. Null ids rank
    last; rows that share an id and a text rank alike and lose the same units."""
    each = every.select("doc_id", "key", F.explode("units").alias("u"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("u.start").alias("start"))
    firsts = (each.groupBy(F.col("u.digest").alias("digest")).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = join_by_share(each.select("doc_id", "key", "u.*"), materialise(firsts, "repeated"), "digest", "n")
    own = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("start").alias("start"))
    return (met.where(~own.eqNullSafe(F.col("first"))).groupBy("doc_id", "key")
            .agg(F.array_sort(F.collect_set(F.struct("unit", "start", "end", "words", "nth"))).alias("gone")))


def passages(gone: Column, least: int = PASSAGE_WORDS) -> Column:
    """Runs of removed units with no other unit between them and more than ``least`` words together: (start, end, words)."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,words:int>>)")
    opened = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("words"), F.lit(-2).alias("nth"), none.alias("runs"))

    def closed(acc):
        run = F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["words"].alias("words"))
        return F.when(acc["words"] > least, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"])

    def step(acc, u):
        goes_on = u["nth"] == acc["nth"] + 1
        return F.struct(F.when(goes_on, acc["start"]).otherwise(u["start"]).alias("start"), u["end"].alias("end"),
                        F.when(goes_on, acc["words"] + u["words"]).otherwise(u["words"]).alias("words"), u["nth"].alias("nth"),
                        F.when(goes_on, acc["runs"]).otherwise(closed(acc)).alias("runs"))
    return F.aggregate(gone, opened, step, closed)


def remove_repeats(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the units that another outranks: the struct column
    ``repeats`` (or ``repeats_`` ...) holds the removed units with their offsets in the original, ``text`` what is left.

    A null text stays null, an empty one empty; an empty table gives no rows. Rows that share id and text lose the same
    units. Texts and units of any length are read whole.
    """
    docs_only = docs.select("doc_id", "text")
    gone = repeated_units(units(docs_only, separator, min_words))
    out, of_doc, of_key = (free_name(docs, c) for c in ("repeats", "gone_doc", "gone_key"))
    gone = gone.select(F.col("doc_id").alias(of_doc), F.col("key").alias(of_key), F.transform(
        "gone", lambda g: F.struct(g["unit"].alias("unit"), g["start"].alias("start"), g["end"].alias("end"))).alias(out))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of_doc)) & text_key().eqNullSafe(F.col(of_key)), "left")
    none = F.expr("cast(array() as array<struct<unit:int,start:int,end:int>>)")
    parts = F.split("text", separator.replace("\n", "\\n"), -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform(out, lambda g: g["unit"]))
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), separator)
    text = F.when(F.col(out).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], F.coalesce(out, none).alias(out))


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of documents: doc_id, n_lines (lines of at least ``min_words`` words), n_removed, chars_removed,
    spans (start:end of removed lines, comma-joined), n_passages and passages (the same of passages)."""
    every = units(docs.select("doc_id", "text"), min_words=min_words)
    gone = repeated_units(every).withColumnsRenamed({"doc_id": "gone_doc", "key": "gone_key"})
    joined = every.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & F.col("key").eqNullSafe(F.col("gone_key")), "left")
    none = F.expr("cast(array() as array<struct<unit:int,start:int,end:int,words:int,nth:int>>)")
    listed = joined.select("doc_id", "units", F.coalesce("gone", none).alias("gone"))
    runs = listed.select("*", passages(F.col("gone")).alias("runs"))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return runs.select(
        "doc_id", F.size("units").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.aggregate("gone", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("chars_removed"),
        shown("gone").alias("spans"), F.size("runs").cast("long").alias("n_passages"), shown("runs").alias("passages"))
