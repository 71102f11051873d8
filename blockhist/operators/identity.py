"""Version identity: derived ids, content-gated adoption of reference ids, replica matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import derived_id

SHOWN_GAPS = 8
#: how accumulators were made; two of them compare only if these agree, as far as both sides tell
MADE_WITH = ["cell_size", "lanes", "algo"]


def derive_ids(versions: DataFrame) -> DataFrame:
    """Add ``new_id``, derived from the version's own id alone."""
    return versions.withColumn("new_id", derived_id("version_id"))


def align_ids(fingerprints: DataFrame, reference: DataFrame, allow_missing: bool = False,
              strict: bool = False) -> DataFrame:
    """Adopt the reference's id where size and accumulator agree; NULL agrees with nothing.

    ``fingerprints`` = (dataset, snap, ord, size, acc, version_id) of our versions. Adds
    ``new_id`` and ``id_origin``: ``reference``, ``derived`` (not in the reference and
    ``allow_missing``), or, without an id, ``differs`` / ``missing``. In strict mode those two
    fail the job.
    """
    made_with = [c for c in MADE_WITH if c in fingerprints.columns and c in reference.columns]
    r = reference.select("dataset", "snap", F.col("size").alias("_size"), F.col("acc").alias("_acc"),
                         F.col("version_id").alias("_id"), F.lit(True).alias("_r"),
                         *[F.col(c).alias(f"_{c}") for c in made_with])
    m = fingerprints.join(r, ["dataset", "snap"], "left")
    # an unknown size or accumulator proves nothing
    equal = F.coalesce((F.col("size") == F.col("_size")) & (F.col("acc") == F.col("_acc")), F.lit(False))
    for c in made_with:
        equal = equal & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    origin = (F.when(F.col("_r").isNull(), "derived" if allow_missing else "missing")
               .when(equal, "reference").otherwise("differs"))
    out = m.withColumn("id_origin", origin).withColumn(
        "new_id", F.when(F.col("id_origin") == "reference", F.col("_id"))
                   .when(F.col("id_origin") == "derived", derived_id("version_id")))
    if strict:
        text = F.concat(F.lit("cannot align "), "dataset", F.lit("@"), "snap", F.lit(": "), "id_origin")
        out = out.withColumn("new_id", F.when(F.col("new_id").isNull(), F.raise_error(text).cast("decimal(20,0)"))
                             .otherwise(F.col("new_id")))
    return out.drop("_size", "_acc", "_id", "_r", *[f"_{c}" for c in made_with])


def coverage_gaps(versions: DataFrame, reference: DataFrame) -> DataFrame:
    """Versions without a reference row, per dataset: count and a short list of names.

    The list names the first eight in version order, then ``+N more``. Only eight names per
    dataset are ever held: the smallest orders are found by rank within bounded chunks.
    """
    from ..functions import ordered
    gaps = versions.join(reference.select("dataset", "snap"), ["dataset", "snap"], "left_anti")
    numbered = ordered.row_numbers(gaps.select("dataset", "snap", "ord"), ["dataset"], ["ord"], "_rank",
                                   ordered.int_chunk("ord"))
    shown = F.when(F.col("_rank") <= SHOWN_GAPS, F.struct("_rank", F.concat(F.lit("@"), "snap").alias("n")))
    sums = numbered.groupBy("dataset").agg(F.count(F.lit(1)).alias("missing"),
                                           F.sort_array(F.collect_list(shown)).alias("_s"))
    names = F.array_join(F.transform("_s", lambda x: x["n"]), ", ")
    more = F.when(F.col("missing") > SHOWN_GAPS,
                  F.concat(F.lit(", ... (+"), (F.col("missing") - SHOWN_GAPS).cast("string"), F.lit(" more)"))
                  ).otherwise("")
    return sums.select("dataset", "missing", F.concat(names, more).alias("names"))


def resume_conflicts(migrated: DataFrame, reference: DataFrame, base: DataFrame) -> DataFrame:
    """Why a resumed alignment cannot continue (empty = it can).

    ``migrated`` = (dataset, snap, version_id) already in the target, ``base`` = (dataset,
    snap): the version the resume builds on. A migrated version that the reference knows must
    carry its id; the base must be known.
    """
    r = reference.select("dataset", "snap", F.col("version_id").alias("_id"))
    wrong = (migrated.join(r, ["dataset", "snap"]).filter(~F.coalesce(F.col("version_id") == F.col("_id"), F.lit(False)))
             .select("dataset", "snap", F.lit("id differs").alias("reason")))
    lost = (base.join(r, ["dataset", "snap"], "left_anti")
            .select("dataset", "snap", F.lit("base not in reference").alias("reason")))
    return wrong.unionByName(lost)


def match_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Versions that carry one id on both sides."""
    left = a.select("dataset", F.col("snap").alias("snap_a"), F.col("ord").alias("ord_a"), "version_id")
    right = b.select("dataset", F.col("snap").alias("snap_b"), F.col("ord").alias("ord_b"), "version_id")
    return left.join(right, ["dataset", "version_id"])


def newest_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Newest version common to both replicas per dataset: the base of an incremental."""
    return match_replicas(a, b).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("common"), F.max("ord_a").alias("base_ord"),
        F.max_by("snap_a", "ord_a").alias("base_snap"))


def id_conflicts(versions: DataFrame, originals: DataFrame | None = None, id_col: str = "new_id") -> DataFrame:
    """Ids used more than once in a dataset, or equal to an original id (empty = fine)."""
    twice = (versions.filter(F.col(id_col).isNotNull()).groupBy("dataset", id_col)
             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("dataset", F.col(id_col).alias("id"), F.lit("duplicate").alias("reason")))
    if originals is None:
        return twice
    clash = (versions.select("dataset", F.col(id_col).alias("id")).distinct()
             .join(originals.select("dataset", F.col("version_id").alias("id")).distinct(), ["dataset", "id"])
             .select("dataset", "id", F.lit("equals an original").alias("reason")))
    return twice.unionByName(clash)
