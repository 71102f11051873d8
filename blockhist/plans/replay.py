"""Rebuild of a whole history at a new grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import ordered
from ..functions.cells import idiv
from ..functions.filters import possible
from ..operators.changes import cut_at, lost_writes, past_end
from ..operators.history import latest_rows, resize_rows, shrinks
from ..operators.ranges import resolve_touches
from ..operators.regrain import assemble, overlay_cells, overlay_parts, ratio, unchanged_rows, with_digest
from ..session import listed, materialise

KEYS = ["dataset", "ord"]
#: Offending records named in an error.
SHOWN = 8


def overlay_images(touched: DataFrame, images: DataFrame, old: int, new: int) -> DataFrame:
    """Content of the ``touched`` cells (new grain, written) from image cells kept at the old grain.

    Image cells that no touch asks for stay where they are, all but the few that a filter lets through; the others
    are shuffled once, as they are: big cells are cut behind the join, small ones are joined by the cell they go
    into, the key they are assembled by.
    """
    at = idiv("cell", ratio(old, new)) if new <= old else F.col("cell")
    wanted = touched.filter("op = 'WRITE' or not covered").select(*KEYS, at.alias("_at"))
    placed = images.withColumn("_at", idiv("cell", ratio(new, old)) if new > old else F.col("cell"))
    asked = possible(possible(placed, wanted, KEYS), wanted, KEYS + ["_at"])
    if new <= old:
        return overlay_parts(touched, asked.drop("_at"), old, new)
    parts = asked.join(wanted, KEYS + ["_at"], "left_semi")
    return overlay_cells(touched, assemble(parts, KEYS, old, new))


def _clamped(changes: DataFrame, sizes: DataFrame, strict: bool) -> DataFrame:
    """The ranges of the log, cut at their version's size. Written: they are read several times. Writes past
    the end are counted on the way; only a log that has any is looked into."""
    log = changes.select(*KEYS, "seq", "op", "off", "len").join(listed(sizes), KEYS, "left")
    seen = Observation()
    past = F.sum(F.when(past_end(F.col("size")).isNotNull(), 1).otherwise(0)).alias("past")
    log = materialise(log.observe(seen, past), "log")
    if strict and seen.get["past"]:
        lost = lost_writes(log.drop("size"), sizes).limit(SHOWN).collect()
        if lost:
            raise ValueError("; ".join(f"{r['dataset']}@{r['ord']}: write of {r['len']} at {r['off']} {r['reason']}" for r in lost))
    return cut_at(log, F.col("size")).drop("size")


def _content(touched: DataFrame, images: DataFrame, old: int, new: int) -> DataFrame:
    """Cells ``(dataset, ord, cell, payload, digest)`` as the touches leave them; payload NULL = a hole."""
    # the touches are read twice, and what they came from is no small plan
    touched = materialise(touched, "touched")
    rows = overlay_images(touched, images, old, new).select(*KEYS, "cell", "payload")
    rows = with_digest(rows, new).withColumn("payload", F.when(F.col("digest").isNotNull(), F.col("payload")))
    # the rebuilt content is read by several branches later: written once
    return materialise(rows, "rebuilt")


def _settled(rows: DataFrame, versions: DataFrame, new: int) -> DataFrame:
    """``rows`` (with digests) after the shrinks of the versions, without rows that change nothing.

    Both steps compare digests; payloads are read at the end, and of them only those are shuffled that may go.
    """
    narrow = rows.select(*KEYS, "cell", "digest")
    added = resize_rows(rows, narrow.select(*KEYS, "cell", F.col("digest").isNotNull().alias("live")), versions, new)
    added = materialise(with_digest(added, new), "resized")
    both = narrow.unionByName(added.select(*narrow.columns))
    gone = materialise(unchanged_rows(both, ordered.history_chunk(versions)), "unchanged")
    every = rows.unionByName(added).select(*KEYS, "cell", "payload")
    doubtful = possible(every, gone, KEYS + ["cell"]).join(listed(gone), KEYS + ["cell"], "left_anti")
    return possible(every, gone, KEYS + ["cell"], "left_anti").unionByName(doubtful)


def replay(images: DataFrame, changes: DataFrame, versions: DataFrame, old: int, new: int,
           strict: bool = True, target: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """Cell history at grain ``new`` of every version, in one job.

    ``images`` = (dataset, ord, cell, payload): cells of each version's image at grain
    ``old``; ``changes`` = classified ranges. The log says which cells a version touches, the
    image says what is in them; sizes that shrink add tombstones and cut boundary cells. A write past
    the end of its version fails the job, unless later frees of the same version take back what is past it;
    without ``strict`` it is cut there, and the caller keeps what ``lost_writes`` lists.

    To resume, give the history that is there already, ``target`` at grain ``new``, and the version it
    is to be continued from, ``bases`` (dataset, base); a dataset without a base, or with a NULL
    one, starts anew. Only later changes are read; of the target, rows after the base are replaced
    and of those before it just the state of the cells at the base is. The result is the whole history.
    """
    versions = materialise(versions.select(*KEYS, "size"), "sizes")
    if target is not None:
        return _resumed(images, changes, versions, old, new, strict, target, bases)
    touched = resolve_touches(_clamped(changes, versions, strict), new, ordered.history_chunk(versions))
    rows = _content(touched, images, old, new)
    return _settled(rows, versions, new)


def _resumed(images, changes, versions, old, new, strict, target, bases) -> DataFrame:
    points = materialise(bases.select("dataset", "base").filter("base is not null"), "bases")

    def later(df: DataFrame) -> DataFrame:
        return df.join(points, "dataset", "left").filter("base is null or ord > base").drop("base")
    kept = target.select(*KEYS, "cell", "payload").join(points, "dataset").filter("ord <= base").drop("base")
    changes = materialise(later(changes), "later")
    # the state at the base: what the first later change of a cell, or a shrink, is compared with; a dataset that has neither needs none
    moving = materialise(changes.select("dataset").unionByName(later(shrinks(versions).withColumnRenamed("at", "ord")).select("dataset")).distinct(), "moving")
    state = materialise(latest_rows(possible(kept, moving, ["dataset"])), "state")
    live = state.filter("payload is not null").select("dataset", "cell", "ord")
    touched = resolve_touches(_clamped(changes, versions, strict), new, ordered.history_chunk(versions), live)
    rows = _content(touched, later(images), old, new)
    added = _settled(with_digest(state, new).unionByName(rows), versions, new)
    return kept.unionByName(later(added).select(*kept.columns))
