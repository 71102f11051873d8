"""URL filters: rules by host and path, and a Bloom filter cascade for everything no rule decides.

The cascade answers exactly whether a key is listed, for every key of a known universe, and needs no
join to do so. Level 0 holds the listed keys; level 1 the other keys of the universe that level 0
lets through; level 2 the listed keys that level 1 lets through; and so on until nothing is let
through. A key is listed if the first level that does not hold it is odd, or if all levels hold it
and the last is even.

Keys are dealt to shards of at most ``keys_per_shard`` listed keys. A cascade of one shard, or of
several that together stay under ``broadcast_bytes``, is sent to every executor. Beyond that the
rows are grouped by (shard, salt) and meet the filter of their shard alone, while the cascade is built
as well as when it is asked. The number of salts follows the counted rows, so a group holds about
``rows_per_group`` of them however large the universe is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrowtext import mix
from .names import free_name

#: Wanted share of false positives in all levels but the first.
LATER = 1 / 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
#: Labels of hosts that the registered query lists.
LISTED_LABELS = r"(^|\.)(ads|adult|casino|cheap|free|spam)-"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _hashed(keys: DataFrame, shards: int) -> DataFrame:
    key = F.col(keys.columns[0])
    return keys.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")).distinct().withColumn(
        "shard", F.pmod("h2", F.lit(shards)).cast("int"))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, m: int, k: int):
    """Bit numbers of every key, one array for each of the k hash functions."""
    a = mix(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    b = mix(h2.view(np.uint64) ^ a) | np.uint64(1)
    for j in range(k):
        yield ((a + np.uint64(j) * b) % np.uint64(m)).astype(np.int64)


def _holds(h1, h2, level: int, m: int, k: int, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), dtype=bool)
    for at in _places(h1, h2, level, m, k):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def walk(h1: np.ndarray, h2: np.ndarray, levels: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Whether each key is listed, by the cascade ``levels`` of its shard."""
    open_, listed = np.arange(len(h1)), np.zeros(len(h1), dtype=bool)
    for i, (m, k, bits) in enumerate(levels):
        ok = _holds(h1[open_], h2[open_], i, m, k, np.frombuffer(bits, dtype=np.uint8))
        if i % 2:
            listed[open_[~ok]] = True
        open_ = open_[ok]
    if len(levels) % 2:
        listed[open_] = True
    return listed


def _level(keys: DataFrame, level: int, rate: float) -> DataFrame:
    """(shard, level, m, k, bits) of a filter over the keys of each shard."""
    counts = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    k = max(1, round(math.log2(1 / rate)))
    sized = counts.select("shard", F.greatest(F.lit(64), F.ceil(F.col("n") * (k / math.log(2)) / 8) * 8).alias("m"))
    spread = keys.join(sized, "shard")

    def parts(batches):
        for batch in batches:
            h1, h2, shard, m = (np.asarray(batch.column(i)) for i in range(4))
            out = []
            for s in np.unique(shard):
                mine = shard == s
                size = int(m[mine][0])
                at = np.unique(np.concatenate(list(_places(h1[mine], h2[mine], level, size, k))))
                word = np.unique(at >> 6)
                bits = np.zeros(len(word), dtype=np.uint64)
                np.bitwise_or.at(bits, np.searchsorted(word, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
                out.append((np.full(len(word), s), np.full(len(word), size), word, bits.view(np.int64)))
            if out:
                s, size, word, bits = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(s.astype(np.int32)), pa.array(size), pa.array(word), pa.array(bits)],
                                      names=["shard", "m", "word", "bits"])
    words = (spread.select("h1", "h2", "shard", "m").mapInArrow(parts, "shard int, m long, word long, bits long")
             .groupBy("shard", "m", "word").agg(F.bit_or("bits").alias("bits")))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        m = int(group["m"].iloc[0])
        out = np.zeros(-(-m // 64), dtype=np.int64)
        out[group["word"].to_numpy()] = group["bits"].to_numpy()
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "level": [level], "m": [m], "k": [k], "bits": [out.tobytes()]})
    return words.groupBy("shard").applyInPandas(whole, "shard int, level int, m long, k int, bits binary")


def salts_for(rows: int, shards: int, rows_per_group: int) -> int:
    """Into how many groups the rows of a shard are cut; twice as many as if shards were even."""
    return max(1, -(-rows // (rows_per_group * shards)) * 2)


class Cascade:
    """Exact membership over a universe of keys; see the module."""

    def __init__(self, levels: DataFrame, shards: int, broadcast_bytes: int):
        self.levels, self.shards = levels, shards
        self.bytes = levels.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        self.small = self.bytes <= broadcast_bytes

    def copies(self, salts: int) -> DataFrame:
        """The filters of each shard, once for every salt."""
        return self.levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def _local(self) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in sorted(self.levels.collect(), key=lambda r: (r.shard, r.level)):
            out.setdefault(r.shard, []).append((r.m, r.k, bytes(r.bits)))
        return out

    def test(self, df: DataFrame, key: str, wish: str = "listed", rows_per_group: int = 500_000) -> DataFrame:
        """``df`` with a BOOLEAN column: whether ``key`` is listed. Exact for keys of the universe; a null
        key is not listed. The column gets the name ``wish``, with underscores if it is taken."""
        out, h1, h2, shard, salt = (free_name(df, w) for w in (wish, "key_h1", "key_h2", "key_shard", "key_salt"))
        hashed = df.withColumns({h1: F.xxhash64(key), h2: F.xxhash64(F.lit(7), F.col(key))})
        if self.small:
            shared, shards = df.sparkSession.sparkContext.broadcast(self._local()), self.shards

            def listed(a: pd.Series, b: pd.Series) -> pd.Series:
                x, y = a.to_numpy(), b.to_numpy()
                result, of = np.zeros(len(x), dtype=bool), np.mod(y, shards)
                for s in np.unique(of):
                    mine = of == s
                    result[mine] = walk(x[mine], y[mine], shared.value.get(int(s), []))
                return pd.Series(result)
            found = F.pandas_udf(listed, "boolean")(h1, h2)
            return hashed.select(*df.columns, (F.col(key).isNotNull() & found).alias(out))
        salts = salts_for(df.count(), self.shards, rows_per_group)
        salted = hashed.withColumns({shard: F.pmod(F.col(h2), F.lit(self.shards)).cast("int"),
                                     salt: F.floor(F.rand(5) * salts).cast("int")})
        copies = self.copies(salts)
        columns = df.columns

        def both(rows: pa.Table, filters: pa.Table) -> pa.Table:
            levels = sorted((r["level"], r["m"], r["k"], r["bits"]) for r in filters.to_pylist())
            found = walk(np.asarray(rows[h1]), np.asarray(rows[h2]), [x[1:] for x in levels])
            found &= ~np.asarray(rows[key].is_null())
            return rows.select(columns).append_column(out, pa.array(found))
        return (salted.groupBy(shard, salt).cogroup(copies.groupBy("shard", "salt"))
                .applyInArrow(both, df.schema.simpleString()[7:-1] + f",{out}:boolean"))


def build_cascade(listed: DataFrame, universe: DataFrame, keys_per_shard: int = 4_000_000,
                  broadcast_bytes: int = 32 << 20, rows_per_group: int = 500_000) -> Cascade:
    """The cascade over the first column of ``listed`` and of ``universe``; nulls are left out, repeated
    keys count once, listed keys need not be part of the universe. Nothing listed: nothing is found."""
    listed, universe = (d.select(F.col(d.columns[0]).alias("key")).where("key is not null") for d in (listed, universe))
    size = listed.distinct().count()
    shards = max(1, -(-size // keys_per_shard))
    inside = materialise(_hashed(listed, shards), "cascade-listed")
    outside = materialise(_hashed(universe, shards).join(inside, ["h1", "h2"], "left_anti"), "cascade-others")
    others = outside.count()
    spark, levels, at = listed.sparkSession, None, 0
    if not size:
        empty = spark.createDataFrame([], "shard int, level int, m long, k int, bits binary")
        return Cascade(empty, 1, broadcast_bytes)
    source, target = inside, outside
    while True:
        rate = min(0.5, max(2.0 ** -20, size / max(others, 1) / 2)) if at == 0 else LATER
        made = materialise(_level(source, at, rate), "cascade-level")
        levels = made if levels is None else levels.unionByName(made)
        one = Cascade(made, shards, broadcast_bytes)
        passed = materialise(_passing(target, one, at, rows_per_group), "cascade-passed")
        if passed.isEmpty():
            return Cascade(levels, shards, broadcast_bytes)
        source, target, at = passed, source, at + 1


def _passing(keys: DataFrame, level: Cascade, at: int, rows_per_group: int) -> DataFrame:
    """The keys of a written table that one level holds; a shard without a filter holds nothing."""
    if level.small:
        shared = keys.sparkSession.sparkContext.broadcast(level._local())

        def run(batches):
            for batch in batches:
                h1, h2, shard = (np.asarray(batch.column(i)) for i in range(3))
                ok = np.zeros(len(h1), dtype=bool)
                for s in np.unique(shard):
                    for m, k, bits in shared.value.get(int(s), []):
                        mine = shard == s
                        ok[mine] = _holds(h1[mine], h2[mine], at, m, k, np.frombuffer(bits, dtype=np.uint8))
                yield batch.filter(pa.array(ok))
        return keys.select("h1", "h2", "shard").mapInArrow(run, "h1 long, h2 long, shard int")

    def both(rows: pa.Table, filters: pa.Table) -> pa.Table:
        ok = np.zeros(rows.num_rows, dtype=bool)
        for r in filters.to_pylist():
            ok = _holds(np.asarray(rows["h1"]), np.asarray(rows["h2"]), at, r["m"], r["k"], np.frombuffer(r["bits"], dtype=np.uint8))
        return rows.select(["h1", "h2", "shard"]).filter(pa.array(ok))
    salts = salts_for(keys.count(), level.shards, rows_per_group)
    salted = keys.select("h1", "h2", "shard", F.pmod(F.col("h1"), F.lit(salts)).cast("int").alias("salt"))
    return (salted.groupBy("shard", "salt").cogroup(level.copies(salts).groupBy("shard", "salt"))
            .applyInArrow(both, "h1 long, h2 long, shard int"))


def judge_urls(pages: DataFrame, cascade: Cascade, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict (underscores added to taken names): the
    verdict of the longest rule that fits, else block for a listed host and allow for any other.

    A null url or one without ``://`` has an empty host and path, fits no rule and is judged by the
    cascade like any other. Every row is judged for itself, repeated rows alike; an empty table gives no rows.
    """
    names = {w: free_name(pages, w) for w in ("host", "path", "rule", "verdict")}
    parts = pages.withColumns({names["host"]: F.coalesce(host_of(F.col(url)), F.lit("")),
                               names["path"]: F.coalesce(path_of(F.col(url)), F.lit(""))})
    tested = cascade.test(parts, names["host"])
    listed = F.col(tested.columns[-1])
    rule = rule_of(F.col(names["host"]), F.col(names["path"]), rules)
    verdict = F.coalesce(rule["verdict"], F.when(listed, "block").otherwise("allow"))
    return tested.select(*pages.columns, names["host"], names["path"], rule["rule"].alias(names["rule"]),
                         verdict.alias(names["verdict"]))
