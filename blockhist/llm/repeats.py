"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

A suffix array of the whole corpus would be one sequential job. Here equal strings are first brought
together, then ordered by suffix arrays of bounded size:

1. Anchors. The anchor of a string is its GRAM bytes of smallest hash, the leftmost of equals. It depends
   on the string's bytes alone, so equal strings have the same anchor at the same place. Neighbouring
   strings mostly share an anchor: they are one fragment, about half as many bytes apart as the string
   is long. The scan emits one narrow row per fragment (hash of the anchor, 128-bit hash of the fragment,
   place); no string leaves it.
2. Fragments that occur twice are covered as a whole. Only where fragments of one anchor differ are bytes
   needed, of one representative of each.
3. Cores. The strings of a contested fragment are taken in steps of STEP by their distance from the anchor.
   All strings of a step have the bytes of its core in common, so a step is its core as a single symbol,
   with up to STEP - 1 bytes on either side; every string is exactly STEP symbols of it. Steps with one
   core meet; equal ones are counted.
4. Suffix arrays. Steps of one core that differ are put into buckets of about BUCKET steps. In each bucket
   one suffix array (linear grouping construction, ``suffixes.py``) orders all suffixes of all steps; a
   string that also starts anywhere else has a neighbour that agrees with it in STEP symbols.
   A core with more than BUCKET different steps (a popular passage a little shorter than the string, in
   ever new surroundings) is cut down once more until a core is the whole string; such strings are
   symbols on their own, their suffix array is their grouping.

The spans found are gathered per document, whose size bounds them. A text is held by one task at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrowtext import Rolling, as_long, slices
from .filters import key_filter
from .suffixes import suffix_array

LENGTH, GRAM, STEP, BUCKET = 400, 32, 32, 2000
PLACES = 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by prefix and suffix minima of blocks of that width."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1:width - 1 + count])


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` gram hashes the place of the smallest, the leftmost of equals."""
    out = []
    step = (1 << PLACES) - width
    for at in range(0, len(grams) - width + 1, step):
        part = grams[at:at + step + width - 1]
        key = (part >> np.uint64(PLACES) << np.uint64(PLACES)) | np.arange(len(part), dtype=np.uint64)
        out.append((_least(key, width) & np.uint64((1 << PLACES) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def fragments(texts, length: int):
    """First and last string start, anchor (all as places in the slice), text number, hash of the anchor and
    two hashes of the bytes of every fragment of the slice."""
    size, width = len(texts.buf), length - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if size < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    rolling = Rolling(texts.buf)
    places = np.arange(size - GRAM + 1)
    grams = rolling.of(places, places + GRAM)
    anchor = anchors(grams, width)
    starts = np.arange(len(anchor))
    text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))[:len(starts)]
    inside = starts + length <= texts.offsets[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b = starts[first], starts[last] if len(first) else none
    place, owner = anchor[first], text[first]
    other = Rolling(texts.buf, 1)
    return a, b, place, owner, grams[place], rolling.of(a, b + length), other.of(a, b + length)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tk, a, b, at, g, f1, f2) of every fragment: ``tk`` is a hash of the text; first and last string
    start and the place of the anchor count from the start of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(2)):
                a, b, at, owner, g, f1, f2 = fragments(texts, length)
                if not len(a):
                    continue
                shift = texts.offsets[owner]
                rows = pa.array(owner + texts.first)
                yield pa.record_batch([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array((a - shift).astype(np.int32)),
                    pa.array((b - shift).astype(np.int32)), pa.array((at - shift).astype(np.int32)), as_long(g), as_long(f1), as_long(f2)],
                    names=["doc_id", "tk", "a", "b", "at", "g", "f1", "f2"])
    long = docs.where(F.octet_length("text") >= length)
    return long.select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(
        run, f"doc_id {kind}, tk long, a int, b int, at int, g long, f1 long, f2 long")


def steps(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, tk, lo, size, core1, core2, left, right, n) of every step of the contested fragments in ``found``
    (doc_id, tk, text, wanted ARRAY<STRUCT<a, b, at, n>>): the step holds ``size`` strings from start ``lo`` on."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tk", "lo", "size", "core1", "core2", "left", "right", "n"]

    def of_text(text: bytes, wanted):
        buf = np.frombuffer(text, dtype=np.uint8)
        one, two = Rolling(buf), Rolling(buf, 1)
        rows = []
        for w in wanted:
            a, b, at = w["a"], w["b"], w["at"]
            for q in range((at - b) // STEP, (at - a) // STEP + 1):
                low, high = at - q * STEP - STEP + 1, at - q * STEP  # strings of the whole step
                lo, hi = max(a, low), min(b, high)
                rows.append((lo, hi - lo + 1, high, low + length, q, w["n"], hi + length))
        lo, size, core, core_end, q, n, end = (np.array(x, dtype=np.int64) for x in zip(*rows))
        turn = q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return lo, size, one.of(core, core_end) + turn, two.of(core, core_end) + turn, core, core_end, end, n

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode()
                lo, size, c1, c2, core, core_end, end, n = of_text(text, batch.column(3)[i].as_py())
                count = len(lo)
                yield pa.record_batch([
                    pa.array([batch.column(0)[i].as_py()] * count, batch.column(0).type), pa.array([batch.column(1)[i].as_py()] * count, pa.int64()),
                    pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32)), as_long(c1), as_long(c2),
                    pa.array([text[x:y] for x, y in zip(lo, core)], pa.binary()),
                    pa.array([text[x:y] for x, y in zip(core_end, end)], pa.binary()), pa.array(n)], names=names)
    return found.select("doc_id", "tk", "text", "wanted").mapInArrow(
        run, f"doc_id {kind}, tk long, lo int, size int, core1 long, core2 long, left binary, right binary, n long")


def twins(steps_of_bucket: pa.Table) -> list[np.ndarray]:
    """For every step of a bucket which of its strings also start in another step, by one suffix array."""
    left, right = steps_of_bucket["left"].to_pylist(), steps_of_bucket["right"].to_pylist()
    cores = list(zip(steps_of_bucket["core1"].to_pylist(), steps_of_bucket["core2"].to_pylist()))
    symbol = {c: 258 + i for i, c in enumerate(dict.fromkeys(cores))}
    text: list[int] = []
    begins = []
    for x, c, y in zip(left, cores, right):
        begins.append(len(text))
        text += [v + 2 for v in x]
        text.append(symbol[c])
        text += [v + 2 for v in y]
        text.append(1)
    sizes = steps_of_bucket["size"].to_pylist()
    is_start = np.zeros(len(text) + 1, dtype=bool)
    for b, size in zip(begins, sizes):
        is_start[b:b + size] = True
    order = np.array(suffix_array(text), dtype=np.int64)
    u, v = order[:-1], order[1:]
    both = is_start[u] & is_start[v]
    u, v = u[both], v[both]
    symbols = np.array([*text, *[0] * STEP], dtype=np.int64)
    for k in range(STEP):
        same = symbols[u + k] == symbols[v + k]
        u, v = u[same], v[same]
    found = np.zeros(len(text) + 1, dtype=bool)
    found[u] = found[v] = True
    return [found[b:b + size] for b, size in zip(begins, sizes)]


def _runs(flags: np.ndarray):
    """First and one past the last place of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _suffix_spans(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(bucket: pa.Table) -> pa.Table:
        out = []
        for i, flags in enumerate(twins(bucket)):
            if bucket["n"][i].as_py() == 1 and flags.any():
                lo = bucket["lo"][i].as_py()
                out += [(i, lo + int(x), lo + int(y) - 1 + length) for x, y in zip(*_runs(flags))]
        at = pa.array([x[0] for x in out], pa.int64())
        return pa.table({"doc_id": bucket["doc_id"].take(at), "tk": bucket["tk"].take(at),
                         "start": pa.array([x[1] for x in out], pa.int32()), "end": pa.array([x[2] for x in out], pa.int32())})
    # a few MB can be many seconds of sorting: the number of tasks follows the buckets, not the bytes
    tasks = min(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, f"doc_id {kind}, tk long, start int, end int")


def _whole_strings(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the steps of cores that are cut down to whole strings."""
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    cut = F.octet_length("left") - F.col("i")
    named = each.select("doc_id", "tk", "n", (F.col("lo") + F.col("i")).alias("p"), "core1", "core2",
                        F.expr("substring(left, i + 1)").alias("left"),
                        F.substring("right", F.lit(1), F.lit(STEP - 1) - cut).alias("right"))
    same = ["core1", "core2", "left", "right"]
    twice = named.groupBy(*same).agg(F.sum("n").alias("all")).where("all > 1").select(*same)
    return (named.where("n = 1").join(twice, same, "left_semi")
            .select("doc_id", "tk", F.col("p").cast("int").alias("start"), (F.col("p") + length).cast("int").alias("end")))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, tk) joined with ``wanted`` on (doc_id, tk); a filter of a fixed size keeps most
    other texts out of the shuffle."""
    may_hold = key_filter(wanted.select("tk"))
    right = wanted.withColumnsRenamed({"doc_id": "wanted_doc", "tk": "wanted_tk"})
    return docs.where(may_hold(F.col("tk"))).join(
        right, F.col("doc_id").eqNullSafe(F.col("wanted_doc")) & (F.col("tk") == F.col("wanted_tk"))).drop("wanted_doc", "wanted_tk")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tk, spans) of every text of ``docs`` (doc_id, text) with bytes to remove: ``tk`` is xxhash64 of
    the text, ``spans`` are (start, end) in bytes of covered runs, which may overlap, in order.

    Strings do not cross texts; the same text counts, at another place. A null or shorter text has none.
    Rows that repeat an id and a text cover each other and give one row. An empty table gives no rows; other
    columns are not read, so their names cannot clash.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    seen = materialise(occurrences(docs, length), "repeat-occurrences")
    twice = key_filter(seen.groupBy("g").count().where("count > 1").select("g"))
    likely = seen.where(twice(F.col("g")))
    kinds = materialise(likely.groupBy("g", "f1", "f2").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "tk", "a", "b", "at")]), "repeat-fragments")
    whole = likely.join(kinds.where("n > 1").select("g", "f1", "f2"), ["g", "f1", "f2"], "left_semi").select(
        "doc_id", "tk", F.col("a").alias("start"), (F.col("b") + length).cast("int").alias("end"))
    contested = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
    wanted = materialise(kinds.join(contested, "g", "left_semi").groupBy("doc_id", "tk").agg(
        F.collect_list(F.struct("a", "b", "at", "n")).alias("wanted")), "repeat-contested")
    cut = materialise(steps(with_texts(keyed, wanted), length), "repeat-steps")
    same = ["core1", "core2", "left", "right"]
    different = materialise(cut.groupBy(*same).agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "tk", "lo", "size")]), "repeat-different")
    equal = cut.where("n = 1").join(different.where("n > 1").select(*same), same, "left_semi").select(
        "doc_id", "tk", F.col("lo").alias("start"), (F.col("lo") + F.col("size") - 1 + length).cast("int").alias("end"))
    meeting = different.groupBy("core1", "core2").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rivals = materialise(different.join(meeting, ["core1", "core2"]), "repeat-rivals")
    buckets = max(1, -(-rivals.count() // BUCKET))
    ordered = _suffix_spans(rivals.where(F.col("k") <= BUCKET).withColumn(
        "bucket", F.pmod(F.xxhash64("core1", "core2"), F.lit(buckets))), length, buckets)
    hot = _whole_strings(rivals.where(F.col("k") > BUCKET), length)
    spans = whole.unionByName(equal).unionByName(ordered).unionByName(hot)
    return spans.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): (doc_id, n_bytes, removed ARRAY<STRUCT<start, end>>, kept_sha256), the
    removed runs being maximal and in order; the hash is of the bytes that are left."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    spans = materialise(repeated_spans(docs, length), "repeat-spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_bytes long, removed array<struct<start:int,end:int>>, kept_sha256 string"

    def run(batches):
        for batch in batches:
            sizes, removed, hashes = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                flags = np.zeros(len(data), dtype=np.int8)
                for s in found.as_py():
                    flags[s["start"]:s["end"]] = 1
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(*_runs(flags))]
                kept = np.frombuffer(data, dtype=np.uint8)[flags == 0].tobytes()
                sizes.append(len(data))
                removed.append(runs)
                hashes.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([
                batch.column(0), pa.array(sizes, pa.int64()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(hashes, pa.string())],
                names=["doc_id", "n_bytes", "removed", "kept_sha256"])
    may_hold = key_filter(spans.select("tk"))
    right = spans.withColumnsRenamed({"doc_id": "span_doc", "tk": "span_tk"})
    # a null text hashes like any value here, so no row is in neither part
    touched = keyed.where(may_hold(F.col("tk"))).join(
        right, F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("tk") == F.col("span_tk")), "left")
    cut = touched.where("spans is not null").select("doc_id", "text", "spans").mapInArrow(run, columns)
    return (cut.unionByName(_untouched(touched.where("spans is null")))
            .unionByName(_untouched(keyed.where(~may_hold(F.col("tk"))))))


def _untouched(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                       F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("removed"),
                       F.sha2(text, 256).alias("kept_sha256"))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
