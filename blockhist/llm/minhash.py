"""Near-duplicate documents by b-bit MinHash.

1. A document's set is its distinct 5-word shingles (64-bit hashes of the whole text). Documents of
   one set form a class; from here on a class is one representative with a number of copies, so a
   group of exact copies, however large, is one row.
2. HASHES minima give BANDS bands of ROWS minima, which propose candidates, and a signature of the low
   BITS bits of every minimum. At a similarity of 0.85 a pair shares no band with probability 2e-8.
3. In a bucket (the representatives that share a band) everyone is paired with one pivot, the class
   with the most copies. The packed signatures give the share of equal low bits by bit counts; less the
   share 2 ** -BITS of chance hits it estimates the similarity. Pairs whose estimate is six standard
   deviations below the threshold are refused, all others verified on their full sets.
4. Components of these links. A bucket whose other members are in one component is settled: no further
   link inside it can change anything. In an unsettled bucket the members of different components are
   compared block by block, in tasks that emit only links that join components. A pair is looked at in
   the first band it shares. So no link that matters is lost, and no bucket is listed as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrowtext import NON_BLANK, Rolling, _splitmix, as_long, list_array, mix, slices, windows
from .filters import key_filter
from .graph import components
from .names import free_name, small_batches

SHINGLE, BANDS, ROWS, BITS = 5, 24, 4, 4
HASHES = BANDS * ROWS
#: A pair is linked if 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: Representatives of one block of a bucket.
BLOCK = 1024
#: Shingles of one block of a bucket, if its documents are long.
BLOCK_SHINGLES = 1_000_000
XORS, FACTORS = _splitmix(HASHES, 21), _splitmix(HASHES, 22) | np.uint64(1)
LONGS = HASHES * BITS // 64
SINGLE = 0x1111111111111111


def least_matches(similarity: int) -> int:
    """Equal low bits (of HASHES) that a pair of that similarity has but for six standard deviations."""
    p = similarity / 100
    p += (1 - p) / 2 ** BITS
    return int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)


def estimate(matches, hashes: int = HASHES, bits: int = BITS):
    """Similarity from the number of equal low bits, corrected for chance hits."""
    chance = 2.0 ** -bits
    return (matches / hashes - chance) / (1 - chance)


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice; a text of fewer words is one shingle."""
    buf, starts, ends, first = texts.words(NON_BLANK)
    hashes = Rolling(buf).of(starts, ends)
    runs = windows(hashes, SHINGLE)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a:b - SHINGLE + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def sign(sets: list[np.ndarray]):
    """Bands (n x BANDS) and packed low bits (n x LONGS) of non-empty sets."""
    data, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    minima = np.empty((HASHES, len(sets)), dtype=np.uint64)
    for j in range(HASHES):
        minima[j] = np.minimum.reduceat((data ^ XORS[j]) * FACTORS[j], at)
    minima = mix(minima)
    bands = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        part = np.zeros(len(sets), dtype=np.uint64)
        for r in range(ROWS):
            part = mix(part + minima[b * ROWS + r] + np.uint64(r + 1))
        bands[:, b] = mix(part + np.uint64(b * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    low = minima & np.uint64((1 << BITS) - 1)
    packed = np.zeros((len(sets), LONGS), dtype=np.uint64)
    per = 64 // BITS
    for j in range(HASHES):
        packed[:, j // per] |= low[j] << np.uint64(BITS * (j % per))
    return bands, packed


def signatures(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, key, n, s1, s2, bands, low) of every row of ``docs`` (doc_id, text): ``key`` is the md5
    of the text, ``n`` the size of its set, (s1, s2) identify the set."""
    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(2)):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets])
                sums = [[int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (0, 0x5DEECE66D)]
                bands, low = sign(full) if full else (np.zeros((0, BANDS), np.uint64), np.zeros((0, LONGS), np.uint64))
                at = np.concatenate([[0], np.cumsum(n > 0)])
                size = len(texts)
                yield pa.record_batch([
                    batch.column(0).slice(texts.first, size), batch.column(1).slice(texts.first, size), pa.array(n.astype(np.int64)),
                    as_long(np.array(sums[0], dtype=np.uint64)), as_long(np.array(sums[1], dtype=np.uint64)),
                    list_array(at * BANDS, as_long(bands.ravel())), list_array(at * LONGS, as_long(low.ravel()))],
                    names=["doc_id", "key", "n", "s1", "s2", "bands", "low"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.md5("text").alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key string, n long, s1 long, s2 long, bands array<long>, low array<long>")
    return materialise(made.withColumn("rid", F.monotonically_increasing_id()), "minhash-signatures")


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _set_of(text: pa.Scalar) -> np.ndarray:
    return shingle_sets(next(slices(pa.array([text.as_py()], pa.large_string()))))[0]


def verified(pairs: DataFrame, similarity: int) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, text_a, text_b) that are linked on their full sets. Rows of one ``a`` mostly
    follow each other, so its set is kept until another comes."""
    def run(batches):
        pivot, of_pivot = None, None
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != pivot:
                    pivot, of_pivot = a, _set_of(batch.column(2)[i])
                linked.append(_linked(of_pivot, _set_of(batch.column(3)[i]), similarity))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, text) of the rows ``wanted`` (rid, doc_id, key). A filter of a fixed size keeps most other texts
    out of the shuffle. Rows that repeat an id and a text may come more than once, which changes nothing."""
    may_hold = key_filter(wanted.select(F.xxhash64("key")))
    source = docs.select(F.col("doc_id").alias("d"), "text").where(F.col("text").isNotNull())
    source = source.withColumn("k", F.md5("text")).where(may_hold(F.xxhash64("k")))
    found = source.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")))
    return materialise(found.select("rid", "text"), "minhash-texts")


def _same_bits(a: str, b: str):
    """Number of equal low bits of two packed signatures."""
    total = F.lit(HASHES)
    for j in range(LONGS):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(SINGLE)))
    return total


def _pivot_links(reps: DataFrame, members: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    pairs = members.where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct()
    low = reps.select("rid", "low")
    near = (pairs.join(low.withColumnsRenamed({"rid": "a", "low": "low_a"}), "a")
            .join(low.withColumnsRenamed({"rid": "b", "low": "low_b"}), "b")
            .where(_same_bits("low_a", "low_b") >= least_matches(similarity)).select("a", "b"))
    near = materialise(near, "minhash-candidates")
    full = (near.join(texts.withColumnsRenamed({"rid": "b", "text": "text_b"}), "b")
            .join(texts.withColumnsRenamed({"rid": "a", "text": "text_a"}), "a"))
    return verified(full, similarity)


def _block_links(group, similarity: int):
    """Links between members of different components among the rows of two blocks of a bucket: a list of
    (a, b) that join components, at most one fewer than there are rows."""
    ids, comp = np.asarray(group["rid"]), np.asarray(group["comp"])
    left = np.flatnonzero(np.asarray(group["side"]) <= 0)
    right = np.flatnonzero(np.asarray(group["side"]) >= 0)
    same = group["i"][0].as_py() == group["j"][0].as_py()
    if same:
        left = right = np.arange(len(ids))
    band = group["band"][0].as_py()
    low = np.asarray(group["low"].combine_chunks().flatten()).view(np.uint64).reshape(-1, LONGS)
    bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
    sets: dict[int, np.ndarray] = {}

    def set_of(i):
        if i not in sets:
            sets[i] = _set_of(group["text"][i])
        return sets[i]
    root = {int(c): int(c) for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    out, needed = [], least_matches(similarity)
    for x in left:
        others = right[right > x] if same else right
        others = others[comp[others] != comp[x]]
        if not len(others):
            continue
        diff = low[others] ^ low[x]
        diff |= diff >> np.uint64(1)
        diff |= diff >> np.uint64(2)
        others = others[HASHES - np.bitwise_count(diff & np.uint64(SINGLE)).sum(axis=1) >= needed]
        if band and len(others):
            others = others[~(bands[others, :band] == bands[x, :band]).any(axis=1)]
        for y in others:
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b and _linked(set_of(x), set_of(y), similarity):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
    return out


def _settle(reps: DataFrame, members: DataFrame, labels: DataFrame, texts: DataFrame, similarity: int) -> DataFrame | None:
    """Links that join components inside unsettled buckets; None if all are settled."""
    placed = (members.where("rid <> pivot").join(labels.withColumnRenamed("id", "rid"), "rid", "left")
              .select("bucket", "band", "rid", "n", F.coalesce("label", "rid").alias("comp")))
    unsettled = (placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
                 .where("lo < hi").select("bucket", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    unsettled = materialise(unsettled, "minhash-unsettled")
    if unsettled.isEmpty():
        return None
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    dealt = (placed.join(unsettled, "bucket").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "band", "rid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.signum(F.col("own") - F.col("other")).cast("int").alias("side")))
    full = dealt.join(reps.select("rid", "low", "bands"), "rid").join(texts, "rid")

    def run(group: pa.Table) -> pa.Table:
        links = _block_links(group, similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): (rid, doc_id, key, n_shingles, group, component_id).

    Documents are linked if 100 * |intersection| >= similarity * |union| of their sets of distinct 5-word
    shingles (A-Z lower-cased, words without white space; fewer than five words are one shingle).
    ``component_id`` is the smallest id that can be reached over links. A null, empty or blank text has an
    empty set and is linked with nothing. Rows that repeat a text are linked like any others; null ids are
    never the smallest, a component of null ids alone has a null id. An empty table gives no rows. Other columns
    are not read, so their names cannot clash. Texts of any length are read whole.
    """
    docs = docs.select("doc_id", "text")
    rows = signatures(docs)
    classes = (rows.where("n > 0").groupBy("s1", "s2", "n")
               .agg(F.min(F.struct("rid", "doc_id", "key", "bands", "low")).alias("rep"), F.count(F.lit(1)).alias("copies"),
                    F.min("doc_id").alias("least_id"))
               .select("s1", "s2", "n", "copies", "least_id", "rep.*"))
    reps = materialise(classes, "minhash-classes")
    spread = reps.select("rid", "n", "copies", F.posexplode("bands").alias("band", "bucket"))
    buckets = (spread.groupBy("bucket").agg(F.min(F.struct((-F.col("copies")).alias("few"), "rid")).alias("first"), F.count(F.lit(1)).alias("size"))
               .where("size > 1").select("bucket", F.col("first.rid").alias("pivot")))
    members = materialise(spread.join(buckets, "bucket").select("bucket", "band", "rid", "n", "pivot"), "minhash-members")
    texts = _texts(docs, reps.join(members.select("rid").distinct(), "rid").select("rid", "doc_id", "key"))
    with small_batches(docs.sparkSession):
        links = materialise(_pivot_links(reps, members, texts, similarity), "minhash-links")
    labels = components(links)
    more = _settle(reps, members, labels, texts, similarity)
    if more is not None:
        labels = components(links.union(materialise(more, "minhash-links")))
    joined = reps.select("s1", "s2", "rid", "copies", "least_id").join(labels.withColumnRenamed("id", "rid"), "rid", "left")
    joined = joined.where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "rid"))
    smallest = joined.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = joined.join(smallest, "label").select("s1", "s2", "component_id", F.col("label").alias("found"))
    return (rows.select("rid", "doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2")
            .join(of_class, ["s1", "s2"], "left")
            .select("rid", "doc_id", "key", "n_shingles", F.coalesce("found", "rid").alias("group"),
                    F.when(F.col("found").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component by id (null ids
    last): one for each component. Rows without words are in no component and all stay."""
    found = near_duplicates(docs, similarity)
    late = F.col("doc_id").isNull().alias("late")
    first = (found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(late, "doc_id", "rid", "key")).alias("one"))
             .select(F.col("one.doc_id").alias("kept_doc"), F.col("one.key").alias("kept_key")))
    match = docs["doc_id"].eqNullSafe(F.col("kept_doc")) & (F.md5(docs["text"]) == F.col("kept_key"))
    wordless = F.coalesce(F.trim(F.translate(docs["text"], "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
    place = free_name(docs, "place")
    own = docs.where(~wordless).join(first, match, "left_semi")
    one = own.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", F.md5("text")).orderBy(F.lit(1))))
    return one.where(F.col(place) == 1).drop(place).unionByName(docs.where(wordless))
