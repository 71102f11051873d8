"""The whole job: rebuild a stored history table at a new grain, check it, publish it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import identity, policy
from ..operators.compare import compare_history
from ..operators.fingerprint import SQL, fingerprint_history
from ..operators.history import with_new_sizes
from ..operators.regrain import regrain_history
from ..session import materialise
from .dry_run import plan
from .publish import publish_verified

SHOWN = 8


@dataclass
class Options:
    """How to rebuild. ``reference`` = fingerprints to take ids from, made at ``reference_cell``
    bytes per cell; ``derive`` = derive ids instead; ``verify`` = a comparison mode."""
    old_grain: int
    new_grain: int
    force: bool = False
    verify: str = "all"
    verify_snap: str | None = None
    dry_run: bool = False
    no_swap: bool = False
    keep_backup: bool = True
    backup_suffix: str = "_old"
    derive: bool = False
    reference: DataFrame | None = None
    reference_cell: int | None = None
    allow_missing: bool = False
    algo: str = SQL
    lanes: int = 16
    location: str | None = None             # where the new table's files go; default: the warehouse


@dataclass
class Source:
    """Everything known about the original besides its table of cells."""
    versions: DataFrame                      # dataset, snap, ord, version_id, size, is_head
    settings: DataFrame                      # dataset, readonly, target, backup
    written: DataFrame                       # dataset, written since the newest version
    names: DataFrame                         # name: names already taken
    changes: DataFrame | None = None         # classified ranges, for estimates
    properties: DataFrame | None = None
    holds: DataFrame | None = None


@dataclass
class Result:
    outcome: str
    steps: DataFrame | None = None
    versions: DataFrame | None = None
    properties: DataFrame | None = None
    holds: DataFrame | None = None
    report: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def _refuse(rows: DataFrame, text) -> None:
    """Raise when ``rows`` is not empty; the message shows a few of them."""
    shown = rows.limit(SHOWN).collect()
    if shown:
        raise ValueError("; ".join(text(r) for r in shown))


def rebuild(spark: SparkSession, table: str, source: Source, options: Options) -> Result:
    """Rebuild ``table`` (dataset, ord, cell, payload) at ``options.new_grain``.

    Nothing is written before all checks passed; the original keeps its name until the new
    table has been compared with it.
    """
    o, versions = options, source.versions
    checks = policy.preflight(source.settings, versions, source.written, source.names, o.new_grain,
                              force=o.force, no_swap=o.no_swap)
    _refuse(checks.filter("not ok"), lambda r: f"{r['dataset']}: {r['rule']} ({r['detail']})")
    notes = []
    if o.reference is not None:
        gaps = identity.coverage_gaps(versions.filter("not is_head"), o.reference)
        if not o.allow_missing:
            _refuse(gaps, lambda r: f"{r['dataset']}: {r['missing']} versions not in the reference ({r['names']})")
        notes = [f"{r['dataset']}: ids derived for {r['missing']} versions ({r['names']})"
                 for r in gaps.collect()]

    changes = source.changes
    if changes is None:
        changes = spark.createDataFrame([], "dataset string, ord int, seq bigint, op string, off bigint, len bigint")
    steps = plan(versions, changes, o.new_grain, checks)
    if o.dry_run:
        return Result("planned", steps, notes=notes)

    original = spark.table(table)
    new = f"{table}_new"
    # the new table lives on under the original's name: never in the scratch folder
    writer = regrain_history(original, versions, o.old_grain, o.new_grain).write
    (writer.option("path", o.location) if o.location else writer).saveAsTable(new)
    rebuilt = spark.table(new)

    named = versions.filter("not is_head")
    if o.reference is not None:
        # fingerprints compare at the reference's cell size only
        cell = o.reference_cell or o.new_grain
        at_cell = regrain_history(rebuilt, versions, o.new_grain, cell)
        prints = fingerprint_history(at_cell, named, o.lanes, algo=o.algo)
        named = identity.align_ids(prints, o.reference, o.allow_missing)
        named = materialise(named, "ids")
        _refuse(named.filter("new_id is null"),
                lambda r: f"{r['dataset']}@{r['snap']}: content differs from the reference, not aligned")
    elif o.derive:
        named = identity.derive_ids(named)

    properties = holds = None
    if source.properties is not None:
        properties = policy.carry_properties(source.properties).select("dataset", "property", "value").unionByName(
            policy.reservation_rows(source.properties))
    if source.holds is not None:
        holds = policy.copy_holds(source.holds, named)

    report = None
    if o.verify != "none":
        sized = with_new_sizes(versions, o.new_grain).withColumn("size", F.col("new_size"))
        report = materialise(compare_history(rebuilt, sized, original, versions, o.new_grain, o.old_grain,
                                             o.verify, o.verify_snap), "report")
    outcome = publish_verified(spark, new, table, report, o.backup_suffix, o.no_swap, o.keep_backup,
                               datasets=versions)
    return Result(outcome, steps, named, properties, holds, report, notes)
