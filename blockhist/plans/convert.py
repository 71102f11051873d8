"""The whole job from a change log and images: check, resume, replay, report, record."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.cells import align_size, is_hole
from ..operators import identity, policy, resume
from ..operators.changes import change_stats, clamp_ranges, drift_report, total_stats
from ..operators.fingerprint import fingerprint_history, lthash, verify_fingerprints
from ..operators.regrain import regrain
from ..session import materialise
from .rebuild import _refuse
from .replay import replay

#: What is recorded of every version that a run has converted.
STEPS = "dataset STRING, snap STRING, ord INT, version_id DECIMAL(20,0), size BIGINT"


@dataclass
class Log:
    """What is known about the original."""
    versions: DataFrame                      # dataset, snap, ord, version_id, size, is_head
    images: DataFrame                        # dataset, ord, cell, payload at the old grain
    changes: DataFrame                       # classified ranges: dataset, ord, seq, op, off, len
    settings: DataFrame                      # dataset, readonly, target, backup [, protected, parent_protected]
    written: DataFrame                       # dataset, written since the newest version
    names: DataFrame                         # name: names already taken
    estimates: DataFrame | None = None       # dataset, ord, estimate in bytes


@dataclass
class Conversion:
    """How to convert. ``resume_from`` = (dataset, resume_from): the version each dataset goes on with;
    ``target_written`` = (dataset, written): bytes written to the target since its newest converted version;
    ``reference`` = (dataset, snap, version_id): ids that converted versions must carry."""
    old_grain: int
    new_grain: int
    force: bool = False
    allow_plain: bool = False
    resume_from: DataFrame | None = None
    target_written: DataFrame | None = None
    reference: DataFrame | None = None
    verify: bool = True
    location: str | None = None


@dataclass
class Converted:
    table: str
    steps: DataFrame                         # every version of the target, as recorded
    drift: DataFrame | None                  # estimate and bytes written, per version of this run
    totals: DataFrame                        # bytes and records written and freed, per dataset
    base: DataFrame | None                   # bytes referenced by the resume base on both sides
    cells: int                               # rows and bytes that this run wrote
    bytes: int
    notes: list[str] = field(default_factory=list)


def _protection(log: Log, o: Conversion) -> list[str]:
    """Refuse protected sources under an unprotected parent; say what becomes of the others."""
    if "protected" not in log.settings.columns:
        return []
    outcomes = log.settings.withColumn("outcome", policy.protection_outcome("protected", "parent_protected", F.lit(o.allow_plain)))
    _refuse(outcomes.filter("outcome = 'refuse'"),
            lambda r: f"{r['dataset']}: protected, but its copy {r['target']} would not be (allow_plain accepts this)")
    inherit = outcomes.filter("outcome = 'inherit'").limit(8).collect()
    return [f"{r['dataset']}: protected under the target's parent, not on its own" for r in inherit]


def _bases(spark: SparkSession, table: str, log: Log, named: DataFrame, o: Conversion) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recorded steps, plan, bases) of a resumed run, after the rules that must hold for it."""
    done = spark.table(f"{table}_steps")
    plan = materialise(resume.resume_plan(named, done, o.resume_from), "resume-plan")
    _refuse(plan.filter("status = 'unknown'"), lambda r: f"{r['dataset']}: {r['snap']} is no version to resume from")
    _refuse(plan.filter("status = 'missing'"), lambda r: f"{r['dataset']}: {r['snap']} comes before the resume point and is not in {table}")
    base = resume.resume_bases(plan)
    if o.target_written is not None and not o.force:
        _refuse(o.target_written.filter("written > 0").join(base.select("dataset", "snap"), "dataset"),
                lambda r: f"{r['dataset']}: {r['written']} bytes written to the target since {r['snap']}, it has left the resume base")
    if o.reference is not None:
        kept = done.join(plan.filter("status = 'done'").select("dataset", "snap"), ["dataset", "snap"], "left_semi")
        _refuse(identity.resume_conflicts(kept, o.reference, base), lambda r: f"{r['dataset']}@{r['snap']}: {r['reason']}")
    return done, plan, base


def convert(spark: SparkSession, table: str, log: Log, o: Conversion) -> Converted:
    """Rebuild ``table`` (dataset, ord, cell, payload) at ``o.new_grain`` from a log and images.

    The versions that are done are recorded in ``<table>_steps``, with the table's new content, at the end of the
    run. A resumed run (``resume_from``) starts from what is recorded: of earlier versions only the state at the base
    is read, later ones are replayed, and the result is the same table a full run makes. Nothing is
    written before all checks passed.
    """
    resuming = o.resume_from is not None
    # read by most of the steps: what they are made from is read once
    log = replace(log, versions=materialise(log.versions, "versions"), changes=materialise(log.changes, "changes"))
    named = log.versions.filter(~F.coalesce("is_head", F.lit(False)))
    checks = policy.preflight(log.settings, log.versions, log.written, log.names, o.new_grain, force=o.force, no_swap=True, resuming=resuming)
    _refuse(checks.filter("not ok"), lambda r: f"{r['dataset']}: {r['rule']} ({r['detail']})")
    notes = _protection(log, o)

    base, target, bases = None, None, None
    if resuming:
        _, plan, base_of = _bases(spark, table, log, named, o)
        target = spark.table(table)
        bases = log.versions.select("dataset").distinct().join(base_of.select("dataset", F.col("ord").alias("base")), "dataset", "left")
        todo = plan.filter("status = 'todo'").select("dataset", "ord")
        # the source's side is its image of the base version, the target's what the recorded history holds there
        points = materialise(base_of.select("dataset", "snap", F.col("ord").alias("ord_source"), F.col("ord").alias("ord_target")), "bases")
        at = log.images.join(points.select("dataset", F.col("ord_source").alias("ord")), ["dataset", "ord"], "left_semi")
        base = materialise(resume.base_report(points, at, target), "base-report")
    else:
        todo = named.select("dataset", "ord")
    todo = materialise(todo, "todo")

    clamped = clamp_ranges(log.changes, log.versions).join(todo, ["dataset", "ord"], "left_semi")
    stats = materialise(change_stats(clamped), "stats")
    drift = None if log.estimates is None else drift_report(log.estimates.join(todo, ["dataset", "ord"], "left_semi"), stats)

    rows = replay(log.images, log.changes, log.versions, o.old_grain, o.new_grain, target=target, bases=bases)
    progress = Observation()
    counted = rows.observe(progress, F.count(F.lit(1)).alias("cells"), F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).alias("bytes"))
    new = f"{table}_new"
    writer = counted.write.mode("overwrite")
    (writer.option("path", o.location) if o.location else writer).saveAsTable(new)

    if o.verify:
        _verify(spark.table(new), log, named, o)
    steps = materialise(named.select("dataset", "snap", "ord", F.col("version_id").cast("decimal(20,0)").alias("version_id"), "size"), "steps")
    # the recorded steps change after the table: a run that stops in between is resumed from the older record
    spark.sql(f"drop table if exists {table}")
    spark.sql(f"alter table {new} rename to {table}")
    record = steps.write.mode("overwrite")
    (record.option("path", f"{o.location}-steps") if o.location else record).saveAsTable(f"{table}_steps")
    seen = progress.get
    return Converted(table, spark.table(f"{table}_steps"), drift, total_stats(stats), base, seen["cells"], seen["bytes"] or 0, notes)


def _verify(rebuilt: DataFrame, log: Log, named: DataFrame, o: Conversion) -> None:
    """The fingerprint of every rebuilt version against that of its image."""
    sized = named.withColumn("size", align_size("size", o.new_grain))
    actual = fingerprint_history(rebuilt, sized, cell_size=o.new_grain)
    live = regrain(log.images.join(named.select("dataset", "ord"), ["dataset", "ord"], "left_semi"), ["dataset", "ord"], o.old_grain, o.new_grain)
    prints = lthash(live.filter(~is_hole("payload", o.new_grain)), ["dataset", "ord"], cell_size=o.new_grain)
    blank = F.unhex(F.lit("00" * 32))
    expected = sized.join(prints, ["dataset", "ord"], "left").withColumn("acc", F.coalesce("acc", blank))
    status = verify_fingerprints(expected, actual)
    _refuse(status.filter("status <> 'OK'"), lambda r: f"{r['dataset']}@{r['snap']}: rebuilt content differs from the image ({r['status']})")
