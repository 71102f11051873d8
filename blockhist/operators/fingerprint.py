"""Content fingerprints of every version, computed for all versions in one pass.

The hash is a lane-wise modular sum over cells. Version k differs from version k-1 only in
the cells it touches, so H(k) = running sum over versions of (lanes of new content - lanes of
old content). Nothing is replayed in sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import lanes as L, ordered, wyhash
from ..session import materialise
from .identity import MADE_WITH

KEY = ["dataset", "cell"]
WY = "lt-wy"
SQL = "lt-sql"


def with_seeds(rows: DataFrame, lanes: int = L.LANES, cell_size: int | None = None,
               cell: str = "cell", payload: str = "payload") -> DataFrame:
    """Add the ``lt-sql`` words of each cell (NULL for holes)."""
    digest = rows.withColumn("_h", L.seed_digest(cell, payload, cell_size))
    return digest.withColumns(L.digest_words("_h", lanes)).drop("_h")


def lthash(rows: DataFrame, keys: list[str], lanes: int = L.LANES, cell_size: int | None = None) -> DataFrame:
    """Accumulator of the cells of each key. Order-free; holes add nothing."""
    seeded = with_seeds(rows, lanes, cell_size)
    sums = seeded.groupBy(*keys).agg(*L.lane_totals(lanes)) if keys else seeded.agg(*L.lane_totals(lanes))
    return sums.select(*keys, L.pack_lanes(lanes).alias("acc"))


def _changed(seeded: DataFrame, lanes: int, chunk) -> DataFrame:
    """Add the cell's words before each row (``_o``); rows that change nothing go."""
    words, olds = L.word_names(lanes), L.word_names(lanes, "_o")
    prev = ordered.previous(seeded, KEY, "ord", dict(zip(olds, words)), chunk)
    return prev.filter("not (" + " and ".join(f"{w} <=> {o}" for w, o in zip(words, olds)) + ")")


def version_deltas(history: DataFrame, versions: DataFrame, lanes: int = L.LANES,
                   cell_size: int | None = None) -> DataFrame:
    """Lane changes per (dataset, ord): new content minus old content of touched cells."""
    return _deltas(history, lanes, cell_size, ordered.history_chunk(versions))


def _deltas(history, lanes, cell_size, chunk) -> DataFrame:
    seeded = with_seeds(history, lanes, cell_size).select("dataset", "cell", "ord", *L.word_names(lanes))
    return (_changed(seeded, lanes, chunk).groupBy("dataset", "ord").agg(*L.lane_totals(lanes, "_w", "_o")))


def accumulate(deltas: DataFrame, spine: DataFrame, lanes: int, chunk) -> DataFrame:
    """Running lane sums over the version spine; versions without changes keep the sum."""
    names = L.lane_names(lanes)
    filled = spine.join(deltas, ["dataset", "ord"], "left").selectExpr(
        *spine.columns, *[f"pmod(coalesce({n}, 0L), {L.MOD}L) as {n}" for n in names])
    if chunk is not None:
        chunk = ordered.int_chunk("ord", ordered.SPINE_CHUNK)
    sums = ordered.running_sums(filled, ["dataset"], ["ord"], {f"_s{i}": n for i, n in enumerate(names)}, chunk)
    return sums.select(*spine.columns, L.pack_lanes(lanes, "_s").alias("acc"))


def fingerprint_history(history: DataFrame, versions: DataFrame, lanes: int = L.LANES,
                        cell_size: int | None = None, algo: str = SQL) -> DataFrame:
    """Fingerprint of every version in ``versions``, also of those without any change."""
    if algo == WY:
        return _wy_history(history, versions)
    chunk = ordered.history_chunk(versions)
    return accumulate(_deltas(history, lanes, cell_size, chunk), versions, lanes, chunk)


def fingerprint_image(history: DataFrame, at, lanes: int = L.LANES, cell_size: int | None = None) -> DataFrame:
    """Fingerprint of one version by reading its complete image: the cross-check.

    ``at`` = a version number, or (dataset, at) with one version per dataset.
    """
    from .history import as_of
    return lthash(as_of(history, at), ["dataset"], lanes, cell_size)


def covered_prefix(existing: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets with the last version up to which ``existing`` can be kept.

    A row is kept when name, id and size agree and all versions before it are kept too.
    ``base`` is NULL when nothing can be kept, ``last`` is the newest version.
    """
    e = existing.select("dataset", "snap", F.col("version_id").alias("_id"), F.col("size").alias("_size"),
                        F.lit(True).alias("_found"))
    m = versions.join(e, ["dataset", "snap"], "left").selectExpr(
        "dataset", "ord", "coalesce(_found and _id <=> version_id and _size <=> size, false) as _kept")
    line = ordered.previous(m, ["dataset"], "ord", {"_prev": "ord"}, ordered.history_chunk(versions))
    gap = F.expr("min_by(struct(_prev), ord) filter (where not _kept)")
    return line.groupBy("dataset").agg(gap.alias("_gap"), F.max("ord").alias("last")).selectExpr(
        "dataset", "case when _gap is null then last else _gap._prev end as base", "last")


def checked_cell_size(existing: DataFrame, cell_size: int) -> DataFrame:
    """Fail the job when stored fingerprints were made at another cell size."""
    ok = F.col("cell_size") == cell_size
    text = F.concat(F.lit("fingerprints made at cell size "), F.col("cell_size").cast("string"))
    return existing.withColumn("cell_size", F.when(ok, F.col("cell_size")).otherwise(
        F.raise_error(text).cast("long")))


def checked_accumulators(existing: DataFrame, lanes: int, cell_size: int | None, algo: str = SQL) -> DataFrame:
    """Fail the job when a stored accumulator cannot be continued: another number of lanes, another
    hash, or, where both are known, another cell size."""
    ok = F.octet_length("acc") == 2 * lanes
    if "lanes" in existing.columns:
        ok = ok & (F.col("lanes") == lanes)
    if "algo" in existing.columns:
        ok = ok & (F.col("algo") == algo)
    if cell_size is not None and "cell_size" in existing.columns:
        ok = ok & (F.col("cell_size") == cell_size)
    text = F.concat(F.lit("accumulator made in another way: "), "dataset", F.lit("@"), "snap")
    return existing.withColumn("acc", F.when(F.coalesce(ok, F.lit(False)), F.col("acc")).otherwise(
        F.raise_error(text).cast("binary")))


def old_content(history: DataFrame, base: DataFrame) -> DataFrame:
    """Content at the resume base of exactly those cells that change after it.

    ``base`` = (dataset, base). Cells that do not change are filtered out before anything of
    them is hashed.
    """
    from .history import latest_rows
    at = base.filter("base is not null").select("dataset", "base")
    split = history.join(at, "dataset")
    touched = split.filter("ord > base").select(*KEY).distinct()
    before = split.filter("ord <= base").join(touched, KEY, "left_semi")
    return latest_rows(before).select("dataset", F.col("base").alias("ord"), "cell", "payload")


def extend_fingerprints(existing: DataFrame, history: DataFrame, versions: DataFrame,
                        lanes: int = L.LANES, cell_size: int | None = None) -> DataFrame:
    """Complete stored fingerprints: kept rows, plus rows for the versions after them.

    Only changes after the base are hashed, and the old content of the cells they touch;
    the base's accumulator comes from the stored row.
    """
    existing = checked_accumulators(existing, lanes, cell_size)
    bases = materialise(covered_prefix(existing, versions).select("dataset", "base"), "bases")
    chunk = ordered.history_chunk(versions)
    spine = versions.join(bases, "dataset")
    kept = spine.filter("ord <= base").join(existing.select("dataset", "snap", "acc"), ["dataset", "snap"])
    start = kept.filter("ord = base").select("dataset", F.col("acc").alias("_start"))
    todo = spine.filter("base is null or ord > base").select(*versions.columns)

    fresh = history.join(bases, "dataset").filter("base is null or ord > base").select(*history.columns)
    rows = fresh.unionByName(old_content(history, bases).select(*history.columns))
    seeded = with_seeds(rows, lanes, cell_size).select("dataset", "cell", "ord", *L.word_names(lanes))
    # the old content stands at the base itself: it is subtracted, but is no change
    deltas = (_changed(seeded, lanes, chunk).join(bases, "dataset").filter("base is null or ord > base")
              .groupBy("dataset", "ord").agg(*L.lane_totals(lanes, "_w", "_o")))
    added = accumulate(deltas, todo, lanes, chunk)
    whole = added.join(start, "dataset", "left").withColumn(
        "acc", F.when(F.col("_start").isNull(), F.col("acc")).otherwise(L.acc_add("acc", "_start"))).drop("_start")
    return kept.select(*versions.columns, "acc").unionByName(whole.select(*versions.columns, "acc"))


def verify_fingerprints(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of each expected version: OK, DIFFER or MISSING; EXTRA rows only inform.

    Columns: dataset, snap, status, id_differs.
    """
    made_with = [c for c in MADE_WITH if c in expected.columns and c in actual.columns]
    e = expected.select("dataset", "snap", F.col("size").alias("_es"), F.col("acc").alias("_ea"),
                        F.col("version_id").alias("_ei"), F.lit(True).alias("_e"),
                        *[F.col(c).alias(f"_e_{c}") for c in made_with])
    a = actual.select("dataset", "snap", F.col("size").alias("_as"), F.col("acc").alias("_aa"),
                      F.col("version_id").alias("_ai"), F.lit(True).alias("_a"),
                      *[F.col(c).alias(f"_a_{c}") for c in made_with])
    # what is unknown on either side is not verified
    same = F.coalesce((F.col("_es") == F.col("_as")) & (F.col("_ea") == F.col("_aa")), F.lit(False))
    for c in made_with:
        same = same & F.coalesce(F.col(f"_e_{c}") == F.col(f"_a_{c}"), F.lit(False))
    status = (F.when(F.col("_a").isNull(), "MISSING").when(F.col("_e").isNull(), "EXTRA")
               .when(same, "OK").otherwise("DIFFER"))
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    return e.join(a, ["dataset", "snap"], "full_outer").select(
        "dataset", "snap", status.alias("status"),
        (both & ~F.col("_ei").eqNullSafe(F.col("_ai"))).alias("id_differs"))


def verify_totals(statuses: DataFrame) -> DataFrame:
    """Counts per status and whether the verification passed (EXTRA does not fail it)."""
    def n(s):
        return F.sum((F.col("status") == s).cast("long")).alias(s.lower())
    return (statuses.groupBy("dataset").agg(n("OK"), n("DIFFER"), n("MISSING"), n("EXTRA"))
            .withColumn("passed", (F.col("differ") == 0) & (F.col("missing") == 0)))


def table_fingerprint(df: DataFrame, key: list[str], cols: list[str], groups: list[str] | None = None,
                      lanes: int = L.LANES) -> DataFrame:
    """Fingerprint of a keyed table: a row is a cell, its key the position.

    Every value is written as its length, a colon and its text (NULL as ``-``), so that no two
    different rows read alike. The key need not be unique: equal rows count as often as they
    occur.
    """
    groups = groups or []

    def value(name):
        t = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t, F.lit(",")), F.lit("-,"))
    row = F.concat(*[value(k) for k in key], F.lit("="), *[value(c) for c in cols])
    rows = df.select(*groups, F.sha2(row, 256).alias("_h"))
    sums = rows.withColumns(L.digest_words("_h", lanes)).groupBy(*groups).agg(
        *L.lane_totals(lanes), F.count(F.lit(1)).alias("rows"))
    return sums.select(*groups, "rows", L.pack_lanes(lanes).alias("acc"))


# ---- lt-wy: 1,024 lanes over wyhash seeds, on Arrow batches ----------------------------------

def _arrow_seed():
    def seeds(batches):
        for b in batches:
            s = wyhash.cell_seeds(b.column("cell").to_numpy(zero_copy_only=False), b.column("payload"))
            import pyarrow as pa
            keep = [n for n in b.schema.names if n != "payload"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(s.view("int64"))],
                                             names=keep + ["seed"])
    return seeds


def wy_seeds(history: DataFrame) -> DataFrame:
    """Replace ``payload`` by the 64-bit ``seed`` (0 = hole) without a shuffle."""
    schema = T.StructType([f for f in history.schema.fields if f.name != "payload"]
                          + [T.StructField("seed", T.LongType())])
    return history.mapInArrow(_arrow_seed(), schema)


def _streamed(df: DataFrame, part: list[str], order: list[str], fn, schema) -> DataFrame:
    return df.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(fn, schema)


def _wy_sums(seeded: DataFrame, keys: list[str], roles: list[tuple[str, int]]) -> DataFrame:
    """Accumulators per (keys, version ``_v``): partial sums per task, then one streamed merge."""
    fields = [f for f in seeded.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    schema = T.StructType(fields + [T.StructField("_v", T.IntegerType()), T.StructField("acc", T.BinaryType())])
    part = seeded.mapInArrow(lambda it: wyhash.partial_sums(it, keys, roles), schema)
    group = keys + ["_v"]
    return _streamed(part, group, [], lambda it: wyhash.streamed_totals(it, group), schema)


def wy_lthash(cells: DataFrame, keys: list[str]) -> DataFrame:
    """1,024-lane accumulator per key of cells ``(keys, cell, payload)``."""
    seeded = wy_seeds(cells.select(*keys, "cell", "payload")).withColumn("_one", F.lit(0))
    return _wy_sums(seeded.drop("cell"), keys, [("_one", 1)]).drop("_v")


def _wy_history(history: DataFrame, versions: DataFrame) -> DataFrame:
    return versions.join(_wy_running(_wy_deltas(history, versions, None), versions), ["dataset", "ord"])


def _wy_deltas(rows: DataFrame, versions: DataFrame, bases: DataFrame | None) -> DataFrame:
    """Lane changes per (dataset, ord). Rows at their dataset's base are the old content of cells that change
    later: they are no change themselves, they only end."""
    from .history import validity
    seeded = wy_seeds(rows.select("dataset", "ord", "cell", "payload"))
    spans = validity(seeded, versions).select("dataset", F.col("ord").cast("int").alias("ord"),
                                              F.col("nxt").cast("int").alias("nxt"), "seed").filter("seed <> 0")
    if bases is not None:
        spans = (spans.join(bases, "dataset", "left")
                 .withColumn("ord", F.when(F.expr("base is null or ord > base"), F.col("ord"))).drop("base"))
    # a seed counts from its own version until the next change of the cell
    return _wy_sums(spans, ["dataset"], [("ord", 1), ("nxt", -1)]).withColumnRenamed("_v", "ord")


def _wy_running(deltas: DataFrame, versions: DataFrame) -> DataFrame:
    """Running sums of the deltas over the versions: (dataset, ord, acc). Rows of accumulators are streamed in order,
    one held at a time; a dataset is cut into chunks of versions."""
    zero = L.zero_acc(wyhash.WY_LANES)
    spine = (versions.select("dataset", "ord").join(deltas, ["dataset", "ord"], "left")
             .withColumn("acc", F.coalesce("acc", zero))
             .withColumn("chunk", ordered.int_chunk("ord", ordered.SPINE_CHUNK)))
    inner = T.StructType(spine.schema.fields + [T.StructField("local", T.BinaryType())])
    local = _streamed(spine, ["dataset", "chunk"], ["ord"],
                      lambda it: wyhash.streamed_running(it, ["dataset", "chunk"], "local", True), inner)
    totals = local.groupBy("dataset", "chunk").agg(F.max_by("local", "ord").alias("acc"))
    outer = T.StructType(totals.schema.fields + [T.StructField("before", T.BinaryType())])
    before = _streamed(totals, ["dataset"], ["chunk"],
                       lambda it: wyhash.streamed_running(it, ["dataset"], "before", False), outer)
    joined = local.drop("acc").join(before.drop("acc"), ["dataset", "chunk"])
    return _added(joined, "local", "before")


def _added(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, ord, acc): the lane-wise sum of two accumulator columns, NULL as zero."""
    both = rows.select("dataset", "ord", F.col(a).alias("a"), F.col(b).alias("b"))
    final = T.StructType([f for f in both.schema.fields if f.name in ("dataset", "ord")] + [T.StructField("acc", T.BinaryType())])

    def add(batches):
        import pyarrow as pa
        for batch in batches:
            acc = wyhash.add_accs(batch.column("a"), batch.column("b"))
            yield pa.RecordBatch.from_arrays([batch.column("dataset"), batch.column("ord"), acc], names=["dataset", "ord", "acc"])
    return both.mapInArrow(add, final)


def wy_subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, acc)``: accumulators of ``a`` less those of ``b``, per key; a missing one is zero."""
    both = a.select(*keys, F.col("acc").alias("_a")).join(b.select(*keys, F.col("acc").alias("_b")), keys, "full_outer")
    schema = T.StructType([f for f in both.schema.fields if f.name in keys] + [T.StructField("acc", T.BinaryType())])

    def subtract(batches):
        import pyarrow as pa
        for batch in batches:
            acc = wyhash.add_accs(batch.column("_a"), wyhash.negated_accs(batch.column("_b")))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], acc], names=[*keys, "acc"])
    return both.mapInArrow(subtract, schema)


def extend_wy_fingerprints(existing: DataFrame, history: DataFrame, versions: DataFrame, cell_size: int | None = None) -> DataFrame:
    """Complete stored ``lt-wy`` fingerprints, such as those of an imported file: kept rows, plus rows for the versions after them.

    As ``extend_fingerprints``: only changes after the base are hashed, and the old content of the cells they touch; its
    lanes are subtracted where the cell changes, and the base's accumulator comes from the stored row.
    """
    existing = checked_accumulators(existing, wyhash.WY_LANES, cell_size, WY)
    bases = materialise(covered_prefix(existing, versions).select("dataset", "base"), "bases")
    spine = versions.join(bases, "dataset")
    kept = spine.filter("ord <= base").join(existing.select("dataset", "snap", "acc"), ["dataset", "snap"])
    start = kept.filter("ord = base").select("dataset", F.col("acc").alias("_start"))
    todo = spine.filter("base is null or ord > base").select(*versions.columns)
    fresh = history.join(bases, "dataset").filter("base is null or ord > base").select(*history.columns)
    rows = fresh.unionByName(old_content(history, bases).select(*history.columns))
    sums = _wy_running(_wy_deltas(rows, versions, bases), todo).join(start, "dataset", "left")
    added = todo.join(_added(sums, "acc", "_start"), ["dataset", "ord"])
    return kept.select(*versions.columns, "acc").unionByName(added.select(*versions.columns, "acc"))
