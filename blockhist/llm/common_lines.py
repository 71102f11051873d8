"""Line dedup: lines that many documents share stay in one of them only.

The lines of every text are exploded to (document, position, digest of the normalised line). Documents are
counted per digest; a line in enough documents is dropped from all but the one with the largest id, and the
texts are put together again from the positions that are left.

Scale: the exploded rows are narrow (no text) and written once. Counting combines before the shuffle. The
occurrences meet the digests that are to go in two ways that add up to all of them: a digest with at least
1 / HEAVY of those occurrences, of which there are HEAVY at most, is broadcast; the others are joined by digest, so
that no join key holds more than 1 / HEAVY of the rows. Of the texts only those with a line to drop are shuffled;
a key filter, sized by their number up to 16 MiB, lets the others pass by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import let
from .filters import key_filter
from .names import free_name, with_struct

#: Shorter lines (code points, after stripping) are never dropped.
MIN_CHARS = 40
#: Documents that must hold a line.
MIN_DOCS = 5
#: At most so many digests are broadcast (16 bytes and an id each).
HEAVY = 1 << 12
#: Largest key filter, in bits.
MOST_BITS = 1 << 27

BLANKS = " \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
MARKS = pa.struct([("marks", pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary())])))])


def line_marks(texts: pa.Array, min_chars: int) -> list[pa.Array]:
    """For each text the positions and digests of its lines of at least ``min_chars`` code points."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    keys = pc.ascii_trim(parts.flatten(), characters=BLANKS)
    chosen = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    pos = chosen - (ends - sizes)[np.searchsorted(ends, chosen, "right")]
    digests = [hashlib.md5(k.translate(LOWER), usedforsecurity=False).digest()
               for k in keys.take(pa.array(chosen)).cast(pa.binary()).to_pylist()]
    offsets = np.concatenate([[0], np.searchsorted(chosen, ends)])
    marks = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(digests, pa.binary())], ["pos", "digest"])
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), marks)]


def text_key(text: str = "text") -> Column:
    """Tells apart texts under one id."""
    return F.unhex(F.md5(text))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key, pos, digest) of every line long enough; ``key`` is the md5 of the text."""
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", text_key().alias("key"), "text")
    marked = with_struct(keyed, "lines", "text", MARKS, lambda: lambda texts: line_marks(texts, min_chars), carry=["doc_id", "key"])
    return marked.select("doc_id", "key", F.explode("lines.marks").alias("mark")).select("doc_id", "key", "mark.*")


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(digest, keeper, n_docs, n) of the digests in at least ``min_docs`` documents: the largest id and the numbers
    of documents and occurrences. Rows of one id are one document; rows without an id are together one more."""
    counted = lines.groupBy("digest").agg(
        (F.count_distinct("doc_id") + F.max(F.when(F.col("doc_id").isNull(), 1).otherwise(0))).alias("n_docs"),
        F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n_docs") >= min_docs)


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, key, gone): the sorted positions of the lines to drop, of documents that lose any."""
    lines = materialise(occurrences(docs, min_chars), "lines")
    common = materialise(common_lines(lines, min_docs), "common-lines")
    total = common.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * heavy >= total
    hot = F.broadcast(common.where(often).select("digest", "keeper"))
    rest = lines.join(hot, "digest", "left_anti").join(common.where(~often).select("digest", "keeper"), "digest")
    met = lines.join(hot, "digest").unionByName(rest)
    lost = met.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    return lost.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, heavy: int = HEAVY) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the lines that at least ``min_docs`` documents hold, but for
    the document of the largest id, which keeps all of them; the struct column ``lines`` (or ``lines_`` ...)
    has n_lines (before), and gone (0-based positions of the dropped lines).

    Lines are cut at \\n, compared without the white space around them and A-Z lower-cased. A null text is one
    empty line and stays null, an empty text likewise stays empty; an empty table gives no rows. Rows that share
    an id are one document, rows with a null id together one of the lowest rank; rows that share id and text lose the
    same lines. A line of any length and a text of any number of lines are handled; work is linear in both.
    """
    gone = materialise(lost_lines(docs, min_chars, min_docs, heavy), "lost-lines")
    few = min(MOST_BITS, 1 << max(16, (16 * gone.count()).bit_length()))
    may_lose = key_filter(gone.select(F.xxhash64("doc_id", "key")), few)
    out, key, known, count = (free_name(docs, c) for c in ("lines", "key", "known", "n_lines"))
    of_doc, of_key, at = (free_name(docs, c) for c in ("gone_doc", "gone_key", "gone_at"))
    gone = gone.select(F.col("doc_id").alias(of_doc), F.col("key").alias(of_key), F.col("gone").alias(at))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    keyed = docs.withColumns({key: text_key(), count: (F.coalesce(newlines, F.lit(0)) + 1).cast("long")})
    keyed = keyed.withColumn(known, may_lose(F.xxhash64("doc_id", key)))
    none = F.expr("cast(array() as array<int>)")

    def result(rows, text, positions):
        lines = F.struct(F.col(count).alias("n_lines"), positions.alias("gone")).alias(out)
        return rows.select(*[text.alias(c) if c == "text" else rows[c] for c in docs.columns], lines)

    def reassembled(parts):
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    joined = keyed.where(F.col(known)).join(
        gone, keyed["doc_id"].eqNullSafe(F.col(of_doc)) & F.col(key).eqNullSafe(F.col(of_key)), "left")
    cut = F.when(F.col(at).isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), reassembled))
    return result(keyed.where(~F.col(known)), F.col("text"), none).unionByName(
        result(joined, cut, F.coalesce(at, none)))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left)."""
    left = drop_common_lines(docs.select("doc_id", "text"))
    return left.select("doc_id", "lines.n_lines", F.size("lines.gone").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
