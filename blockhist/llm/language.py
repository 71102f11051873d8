"""Language identification by words first, then by shorter and shorter character n-grams.

A known word scores its log frequency in every language. An unseen word scores the mean log
frequency of its n-grams (marked at both ends) of the longest length of which any is known.
The tables are counted over all labelled rows and written whole. The most frequent ``max_words`` words
and ``max_grams`` n-grams are sent to every task as well; what a task does not hold meets the written
tables in joins, so the sizes held change the cost and not the verdict. Scores are whole millionths, so
that sums do not depend on their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .names import free_name

WORD = regex.compile(r"\p{L}+")
MAX_WORDS, MAX_GRAMS, LONGEST_GRAM = 250_000, 60_000, 4
#: Longer runs of letters are no entries of the word table: they are scored by n-grams, to which they count like all others.
LONGEST_WORD = 40
#: A task sends its word counts on when it holds so many.
HELD_COUNTS = 200_000
#: A score weighs a text as if it had at most this many words of its mean evidence.
EVIDENCE = 20
#: Log frequencies are kept as whole numbers of 1/SCALE.
SCALE = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of ``labelled`` (lang, text)."""
    def run(batches):
        seen: dict[tuple[str, str], int] = {}

        def sent():
            langs, words = zip(*seen)
            return pa.record_batch([pa.array(langs), pa.array(words), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in WORD.findall(text.as_py().lower()):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
                if len(seen) > HELD_COUNTS:
                    yield sent()
                    seen.clear()
        if seen:
            yield sent()
    return (labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _grams(word: Column, size: int) -> Column:
    """All n-grams of ``size`` characters; a shorter word is one itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1))),
                       lambda i: F.substring(word, i, F.lit(size)))


def _log(n: Column, total: Column) -> Column:
    return F.round(F.log((n + 0.5) / total) * SCALE).cast("long")


def _held(logs: DataFrame, key: str, most: int, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The ``most`` most frequent keys, ties by key, and their logs. Written first, so that the driver
    gets these rows alone and not as many from every task."""
    rows = materialise(logs.orderBy(F.desc("n"), key).limit(most), f"language-held-{key}s").toArrow()
    return rows[key].to_pylist(), np.stack([np.asarray(rows[c], dtype=np.int64) for c in names], axis=1)


def train(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """The model of ``docs`` (doc_id, text, lang): learnt from rows with a text, a lang and an id
    that is not held out. Without such rows the model knows no language.

    ``word_table`` and ``gram_table`` hold every word and n-gram, ``words`` and ``grams`` the most
    frequent ones, which each task holds.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                      & ~held_out(F.col("doc_id")))
    counts = materialise(word_counts(rows), "language-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return {"langs": []}
    names, numbers = [f"s{i}" for i in range(len(langs))], [f"n{i}" for i in range(len(langs))]
    # one row per word, with its number in every language: n-grams are made once per word
    words = materialise(counts.groupBy("word").agg(F.sum("n").alias("n"), *[
        F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(c) for x, c in zip(langs, numbers)]), "language-words")
    discard(counts)
    entries = words.where(F.length("word") <= LONGEST_WORD)
    known = entries.count()
    word_table = entries.select("word", "n", *[
        _log(F.col(c), F.lit(totals[x] + 0.5 * (known + 1))).alias(s) for x, c, s in zip(langs, numbers, names)])
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    pieces = materialise(
        words.select("n", *numbers, F.explode(F.flatten(F.array(*[_grams(marked, size) for size in range(1, LONGEST_GRAM + 1)]))).alias("gram"))
        .groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", *numbers)]), "language-grams").withColumn("size", F.length("gram"))
    of_size = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in numbers]).collect()

    def total_of(i):
        return F.coalesce(*[F.when(F.col("size") == r["size"], F.lit(r[f"n{i}"] + 0.5 * r["n"])) for r in of_size])
    gram_table = pieces.select("gram", "n", *[_log(F.col(f"n{i}"), total_of(i)).alias(names[i]) for i in range(len(langs))])
    total = np.array([totals[x] for x in langs], dtype=np.float64)
    held_words, word_logs = _held(word_table, "word", max_words, names)
    held_grams, gram_logs = _held(gram_table, "gram", max_grams, names)
    return {"langs": langs, "prior": np.log(total / total.sum()).tolist(), "word_table": word_table, "gram_table": gram_table,
            "words": held_words, "word_logs": word_logs, "grams": held_grams, "gram_logs": gram_logs}


def _texts(texts: DataFrame, model: dict) -> DataFrame:
    """(key, copies, words, s0, s1, ..., rest) of (key, text): the sums of the held words over all copies
    of a text in a batch, and how often each other word (word, n) occurs in them."""
    shared = texts.sparkSession.sparkContext.broadcast({k: model[k] for k in ("words", "word_logs")})
    k = len(model["langs"])
    rest = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches):
        at, logs = {w: i for i, w in enumerate(shared.value["words"])}, shared.value["word_logs"]
        for batch in batches:
            copies: dict[bytes, int] = {}
            made = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                copies[key] = copies.get(key, 0) + 1
                if copies[key] > 1:
                    continue
                words = WORD.findall(text.as_py().lower())
                places = list(map(at.get, words))
                others: dict[str, int] = {}
                if None in places:
                    for w, p in zip(words, places):
                        if p is None:
                            others[w] = others.get(w, 0) + 1
                    places = [p for p in places if p is not None]
                made.append((key, len(words), logs[places].sum(axis=0), others))
            if made:
                times = [copies[m[0]] for m in made]
                sums = np.stack([m[2] for m in made]) * np.array(times)[:, None]
                others = [[{"word": w, "n": n * t} for w, n in m[3].items()] for m, t in zip(made, times)]
                yield pa.record_batch(
                    [pa.array([m[0] for m in made], pa.binary()), pa.array(times), pa.array([m[1] * t for m, t in zip(made, times)]),
                     *[pa.array(sums[:, i]) for i in range(k)], pa.array(others, rest)],
                    names=["key", "copies", "words", *[f"s{i}" for i in range(k)], "rest"])
    sums = "".join(f"s{i} long, " for i in range(k))
    return texts.mapInArrow(run, f"key binary, copies long, words long, {sums}rest array<struct<word:string,n:long>>")


def _backed_off(unseen: DataFrame, model: dict) -> tuple[DataFrame, DataFrame]:
    """A written table, and from it (word, s0, s1, ...) of (word): the mean of the n-grams of the longest length of which
    any is known. Words without a known n-gram are left out."""
    shared = unseen.sparkSession.sparkContext.broadcast({k: model[k] for k in ("grams", "gram_logs")})
    names = [f"s{i}" for i in range(len(model["langs"]))]

    def run(batches):
        at, logs = {g: i for i, g in enumerate(shared.value["grams"])}, shared.value["gram_logs"]
        for batch in batches:
            made = []
            for word in batch.column(0).to_pylist():
                marked = f"^{word}$"
                for size in range(1, LONGEST_GRAM + 1):
                    pieces = [marked[i:i + size] for i in range(max(len(marked) - size + 1, 0))]
                    places = [p for g in pieces if (p := at.get(g)) is not None]
                    made.append((word, size, len(places), logs[places].sum(axis=0), [g for g in pieces if g not in at]))
            if made:
                sums = np.stack([m[3] for m in made])
                yield pa.record_batch(
                    [pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int64()),
                     *[pa.array(sums[:, i]) for i in range(len(names))], pa.array([m[4] for m in made], pa.list_(pa.string()))],
                    names=["word", "size", "found", *names, "rest"])
    sums = "".join(f"{c} long, " for c in names)
    parts = materialise(unseen.mapInArrow(run, f"word string, size int, found long, {sums}rest array<string>"), "language-backoff")
    others = (parts.select("word", "size", F.explode("rest").alias("gram")).join(model["gram_table"].drop("n"), "gram")
              .select("word", "size", F.lit(1).cast("long").alias("found"), *names))
    each = (parts.drop("rest").unionByName(others).groupBy("word", "size")
            .agg(F.sum("found").alias("found"), *[F.sum(c).alias(c) for c in names]).where("found > 0"))
    mean = F.struct("size", *[F.round(F.col(c) / F.col("found")).cast("long").alias(c) for c in names])
    return parts, each.select("word", mean.alias("m")).groupBy("word").agg(F.max("m").alias("m")).select("word", *[f"m.{c}" for c in names])


def _verdicts(texts: DataFrame, model: dict) -> DataFrame:
    """(key, lang, score) of (key, text); ``key`` is the md5 of the text, copies have one verdict."""
    langs, names = model["langs"], [f"s{i}" for i in range(len(model["langs"]))]
    parts = materialise(_texts(texts, model), "language-texts")
    rest = parts.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.n")
    looked = materialise(rest.select("word").distinct().join(model["word_table"].drop("n"), "word", "left"), "language-looked")
    parts_of_words, backed = _backed_off(looked.where(f"{names[0]} is null").select("word"), model)
    scored = materialise(looked.where(f"{names[0]} is not null").unionByName(backed), "language-scored")
    discard(looked, parts_of_words)
    others = rest.join(scored, "word").select(
        "key", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("words"), *[(F.col(c) * F.col("n")).alias(c) for c in names])
    total = parts.drop("rest").unionByName(others).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("copies", "words", *names)])
    # a caller's filter may be evaluated together with the one on words below: no division by zero
    words = F.when(F.col("words") > 0, F.col("words") / F.col("copies"))
    weight = F.least(words, F.lit(float(EVIDENCE))) / words / SCALE
    evidence = F.array(*[F.lit(p) + F.col(c) / F.col("copies") * weight for p, c in zip(model["prior"], names)])
    judged = total.where("words > 0").select("key", evidence.alias("e")).withColumn("top", F.array_max("e"))
    share = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return judged.select("key", F.element_at(F.array(*map(F.lit, langs)), F.array_position("e", F.col("top")).cast("int")).alias("lang"),
                         (F.lit(1.0) / share).alias("score"))


def identify(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text and any others) with one more column, the struct ``language`` (or ``language_``
    if that name is taken): lang, score. ``carry`` names the columns to return, all by default.

    ``und`` with score 0 for a null text, a text without letters, and every text if the model knows
    no language. Letters that no known word or n-gram holds leave the languages' shares to decide.
    Ties go to the first language by code point. Whole texts count, letter runs of any length among them; only ``text`` is
    looked at, so rows that share a text have one verdict and repeated rows count alike. An empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    out, key = free_name(docs, "language"), free_name(docs, "text_key")
    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if not model["langs"]:
        return docs.select(*carry, unknown.alias(out))
    digest = F.unhex(F.md5("text"))
    verdicts = _verdicts(docs.where(F.col("text").isNotNull()).select(digest.alias("key"), "text"), model)
    verdicts = verdicts.select(F.col("key").alias(key), F.struct("lang", "score").alias(out))
    return (docs.select(*carry, digest.alias(key)).join(verdicts, key, "left")
            .select(*carry, F.coalesce(out, unknown).alias(out)))
