"""Rules around a rebuild: properties, holds, protection, reservations, pre-flight checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col

# Properties that belong to the dataset itself or are set at creation only.
MANAGED_PROPERTIES = [
    "volsize", "volblocksize", "readonly", "snapdev", "reservation", "refreservation",
    "encryption", "keyformat", "keylocation", "keystatus", "pbkdf2iters",
    "casesensitivity", "normalization", "utf8only"]
EXPLICIT_SOURCES = ["local", "received"]
UNSET_VALUES = ["", "0", "none", "-"]
SMALLEST_GRAIN = 512


def is_set(value) -> Column:
    """A property value that means something is set."""
    c = col(value)
    return F.coalesce(~c.isin(UNSET_VALUES), F.lit(False))


def carry_properties(props: DataFrame) -> DataFrame:
    """Explicitly set properties that may be recreated on the new dataset."""
    return props.filter(F.col("source").isin(EXPLICIT_SOURCES) & ~F.col("property").isin(MANAGED_PROPERTIES))


def reservation_rows(props: DataFrame) -> DataFrame:
    """Reservations to set on the new dataset, after the copy and before it is compared.

    A thick source gets its own size re-derived (``auto``); a plain reservation is copied.
    """
    value = (F.when(F.col("property") == "refreservation", F.lit("auto"))
              .when(F.col("property") == "reservation", F.col("value")))
    return (props.filter(F.col("property").isin("refreservation", "reservation") & is_set("value"))
            .select("dataset", "property", value.alias("value")))


def protection_outcome(protected, parent_protected, allow_plain) -> Column:
    """What becomes of a protected source under the target's parent.

    ``plain`` (nothing to protect), ``inherit`` (under the parent's protection), ``refuse``
    or ``allowed plain``.
    """
    return (F.when(~col(protected), "plain")
             .when(col(parent_protected), "inherit")
             .when(col(allow_plain), "allowed plain")
             .otherwise("refuse"))


def copy_holds(holds: DataFrame, versions: DataFrame) -> DataFrame:
    """Holds follow to the new version of the same name; versions without holds get none."""
    return (holds.filter(F.col("tag") != "")
            .join(versions.select("dataset", "snap"), ["dataset", "snap"], "left_semi"))


def grain_ok(grain) -> Column:
    """A power of two of at least 512."""
    g = col(grain)
    return (g >= SMALLEST_GRAIN) & (g.bitwiseAND(g - 1) == 0)


def preflight(datasets: DataFrame, versions: DataFrame, written: DataFrame, names: DataFrame,
              grain: int, force: bool = False, no_swap: bool = False, resuming: bool = False) -> DataFrame:
    """One row per (dataset, rule): ``passed``, ``overridable``, ``ok``, ``detail``.

    ``datasets`` = (dataset, readonly, target, backup), ``written`` = (dataset, written) since
    the newest version, ``names`` = (name) already taken. ``ok`` counts ``force`` in.
    """
    # the head is no version: a dataset with a head alone has nothing to rebuild
    named = F.lit(True) if "is_head" not in versions.columns else ~F.coalesce("is_head", F.lit(False))
    counts = versions.groupBy("dataset").agg(F.count_if(named).alias("_n"),
                                             F.max_by("snap", "ord").alias("_newest"))
    taken = names.select("name").distinct()
    d = (datasets.join(counts, "dataset", "left").join(written, "dataset", "left")
         .join(taken.select(F.col("name").alias("target"), F.lit(True).alias("_t")), "target", "left")
         .join(taken.select(F.col("name").alias("backup"), F.lit(True).alias("_b")), "backup", "left"))
    since = F.coalesce("written", F.lit(0))
    target_taken, backup_taken = F.coalesce("_t", F.lit(False)), F.coalesce("_b", F.lit(False))

    def rule(name, passed, overridable, detail):
        return F.struct(F.lit(name).alias("rule"), F.coalesce(passed, F.lit(False)).alias("passed"),
                        F.lit(overridable).alias("overridable"), detail.cast("string").alias("detail"))
    rules = [
        rule("grain", grain_ok(F.lit(grain)), False, F.lit(grain)),
        rule("read_only", F.col("readonly") == "on", True, F.col("readonly")),
        rule("has_versions", F.col("_n") > 0, False, F.coalesce("_n", F.lit(0))),
        rule("head_is_newest", since == 0, True, since),
        rule("target_exists" if resuming else "target_free",
             target_taken if resuming else ~target_taken, False, F.col("target"))]
    if not no_swap:
        rules.append(rule("backup_free", ~backup_taken, False, F.col("backup")))
    return (d.select("dataset", F.inline(F.array(*rules)))
            .withColumn("ok", F.col("passed") | (F.col("overridable") & F.lit(force))))
