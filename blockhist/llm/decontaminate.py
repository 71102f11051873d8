"""Benchmark decontamination by a prefix-filtered set join.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words is one window of
that length). Words are ranked by rarity over the whole corpus. For containment of the whole
window its prefix is its rarest word alone: a text that holds the window holds that word, and the
window can start only ``offset`` words before it. So the scan of the corpus emits

* only where a word is the prefix of some window (prefix filter),
* only starts that leave room for the window inside the text (length bound),
* only at the offset at which that word stands in some window (positional bound),

and the 128-bit hash of the window found there is joined with the windows of the benchmark
(exact verification). The filters in the scan are bitmaps of a fixed size, whatever the size of the
benchmark: they may let a start through that the join then refuses, never the other way round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrowtext import ALPHANUMERIC, Rolling, as_long, list_array, mix, slices, windows

#: Bits of a filter. 2^22 bits are 512 KiB, sent to each executor once.
BITS = 1 << 22


def _token_hashes(texts):
    buf, starts, ends, first = texts.words(ALPHANUMERIC)
    return Rolling(buf, 0).of(starts, ends), Rolling(buf, 1).of(starts, ends), first


def _bit(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(BITS - 1)).astype(np.int64)


def _spot(token: np.ndarray, offset, length) -> np.ndarray:
    """A word at a place in a window of a length, as one integer."""
    return mix(token + np.asarray(offset).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + np.asarray(length).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _bitmap(keys: DataFrame) -> bytes:
    """A filter over the one LONG column of ``keys``: at most BITS / 64 rows come to the driver."""
    key = F.col(keys.columns[0]).bitwiseAND(BITS - 1)
    words = (keys.select(F.floor(key / 64).alias("word"), (key % 64).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").tobytes()


def benchmark_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """(item_id STRING, start, len, h1, h2, tokens ARRAY<BIGINT>) of every window of every item."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for texts in slices(batch.column(1)):
                a, b, first = _token_hashes(texts)
                rows = []
                for i in range(len(texts)):
                    x, y = a[first[i]:first[i + 1]], b[first[i]:first[i + 1]]
                    size = min(n, len(x))
                    if not size:
                        continue
                    h1, h2 = windows(x, size, 0).view(np.int64), windows(y, size, 1).view(np.int64)
                    signed = x.view(np.int64)
                    rows += [(ids[texts.first + i].as_py(), j, size, int(h1[j]), int(h2[j]), signed[j:j + size].tolist())
                             for j in range(len(h1))]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                        pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                        names=["item_id", "start", "len", "h1", "h2", "tokens"])
    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item_id string, start int, len int, h1 long, h2 long, tokens array<long>")


def token_counts(docs: DataFrame, known: bytes) -> DataFrame:
    """(token, n): how often each word that passes the filter occurs in the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        seen = np.frombuffer(shared.value, dtype=bool)
        for batch in batches:
            for texts in slices(batch.column(0)):
                a, _, _ = _token_hashes(texts)
                tokens, n = np.unique(a[seen[_bit(a)]], return_counts=True)
                yield pa.record_batch([as_long(tokens), pa.array(n)], names=["token", "n"])
    return (docs.select("text").mapInArrow(run, "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


def prefixes(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Every distinct window with the place of its rarest word: (h1, h2, len, token, offset, items)."""
    distinct = found.groupBy("h1", "h2", "len").agg(F.first("tokens").alias("tokens"), F.collect_set("item_id").alias("items"))
    placed = distinct.select("h1", "h2", "len", F.posexplode("tokens").alias("offset", "token"))
    rarest = (placed.join(counts, "token", "left").groupBy("h1", "h2", "len")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p")))
    return distinct.join(rarest, ["h1", "h2", "len"]).select("h1", "h2", "len", "p.token", "p.offset", "items")


def candidates(docs: DataFrame, tokens: bytes, spots: bytes, lengths: list[int]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_words, found), found being the starts
    that pass the prefix filter and both bounds, with the hash of the window there."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, spots))
    kind = pa.struct([("start", pa.int32()), ("len", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        known, placed = (np.frombuffer(x, dtype=bool) for x in shared.value)
        for batch in batches:
            for texts in slices(batch.column(1)):
                a, b, first = _token_hashes(texts)
                at = np.flatnonzero(known[_bit(a)])
                doc = np.searchsorted(first, at, "right") - 1
                parts = []
                for size in lengths:
                    if not len(at):
                        break
                    wa, wb = windows(a, size, 0), windows(b, size, 1)
                    for offset in range(size):
                        ok = placed[_bit(_spot(a[at], offset, size))]
                        start, owner = at[ok] - offset, doc[ok]
                        fits = (start >= first[owner]) & (start + size <= first[owner + 1])
                        start, owner = start[fits], owner[fits]
                        parts.append((owner, start - first[owner], np.full(len(start), size), wa[start], wb[start]))
                owner, start, size, h1, h2 = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
                found = pa.StructArray.from_arrays(
                    [pa.array(start[order].astype(np.int32)), pa.array(size[order].astype(np.int32)),
                     as_long(h1[order]), as_long(h2[order])], fields=list(kind))
                yield pa.record_batch([batch.column(0).slice(texts.first, len(texts)),
                                       pa.array(np.diff(first).astype(np.int64)), list_array(ends, found)],
                                      names=["doc_id", "n_words", "found"])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, n_words long, found array<struct<start:int,len:int,h1:long,h2:long>>")


def contaminated_words(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): (doc_id, n_words, spans, items).

    ``spans`` are the (start, len) of every benchmark window that occurs, in words, sorted;
    ``items`` the ids as strings of the items they come from, sorted. A null or empty text has no
    words; a null or wordless item has no windows; a window of an item without an id is a span but
    names no item. Repeated rows of either table each give their own result and do not change that
    of others. Nothing in the result depends on how often a window occurs. Without documents there are no
    rows, without items no spans. Other columns are not read; texts of any length are read whole.
    """
    found = materialise(benchmark_windows(items, n), "benchmark-windows")
    lengths = sorted(r[0] for r in found.select("len").distinct().collect())  # at most n values
    vocabulary = found.select(F.explode("tokens").alias("token"))
    counts = token_counts(docs, _bitmap(vocabulary))
    index = materialise(prefixes(found, counts), "benchmark-prefixes")
    scanned = candidates(docs, _bitmap(index.select("token")), _bitmap(_spots(index)), lengths)
    scanned = materialise(scanned.withColumn("rid", F.monotonically_increasing_id()), "benchmark-candidates")
    hits = (scanned.select("rid", F.explode("found").alias("w")).select("rid", "w.*")
            .join(index.select("h1", "h2", "len", "items"), ["h1", "h2", "len"])
            .groupBy("rid").agg(F.collect_set(F.struct("start", "len")).alias("spans"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    none = "cast(array() as array<struct<start:int,len:int>>)"
    return scanned.select("rid", "doc_id", "n_words").join(hits, "rid", "left").select(
        "doc_id", "n_words", F.coalesce(F.array_sort("spans"), F.expr(none)).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _spots(index: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            token, offset, size = (np.asarray(batch.column(i)) for i in range(3))
            yield pa.record_batch([as_long(_spot(token.astype(np.int64).view(np.uint64), offset, size))], names=["spot"])
    return index.select("token", "offset", "len").mapInArrow(run, "spot long")


def words_hit(spans) -> Column:
    """Number of words inside any of the spans."""
    words = F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
    return F.size(F.array_distinct(F.flatten(words))).cast("long")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window."""
    keyed = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
    dirty = contaminated_words(keyed, items, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("dirty")).distinct()
    return docs.join(dirty, F.sha2(docs["text"], 256) == dirty["dirty"], "left_anti")
