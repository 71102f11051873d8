"""Comparison of two histories, down to the first differing byte.

Cells are compared by the sha-256 digest of the whole cell (short payloads are padded with
zeros). The histories of neighbouring cells are first compared by one digest per block, so equal histories move one
row a block; of blocks that differ the shuffle carries 32 bytes per change. Payloads are read again only for the first
differing cell of each version. A change is compared once, however many versions share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ordered
from ..functions.cells import full_cell, idiv, is_hole
from ..session import materialise
from .regrain import to_finer

KEY = ["dataset", "cell"]
MODES = ("none", "head", "all", "one")
#: cells whose histories share a digest
BLOCK = 1 << 8
#: levels of the binary tree over version numbers (ord is a 32-bit integer)
LEVELS = 31


def paired_versions(a: DataFrame, b: DataFrame, mode: str = "all", snap: str | None = None) -> DataFrame:
    """Versions to compare: ``(dataset, snap, ord_a, ord_b, size_a, size_b, is_head)``.

    ``b`` is the original. ``all`` takes every version of the original and the head,
    ``head`` the head only, ``one`` one version, which must exist on both sides.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "one" and snap is None:
        raise ValueError("mode 'one' needs the name of a version")
    side_a = a.select("dataset", "snap", "is_head", F.col("ord").alias("ord_a"), F.col("size").alias("size_a"))
    side_b = b.select("dataset", "snap", "is_head", F.col("ord").alias("ord_b"), F.col("size").alias("size_b"))
    if mode == "none":
        side_b = side_b.filter(F.lit(False))
    elif mode == "head":
        side_b = side_b.filter("is_head")
    elif mode == "one":
        # every dataset of either side is asked for, so that an absent version cannot pass
        asked = (a.select("dataset").union(b.select("dataset")).distinct()
                 .withColumn("snap", F.lit(snap)).withColumn("is_head", F.lit(False)))
        both = (asked.join(side_b, ["dataset", "snap", "is_head"], "left")
                .join(side_a, ["dataset", "snap", "is_head"], "left"))
        text = F.when(F.col("ord_b").isNull(), "not a version of the original").when(
            F.col("ord_a").isNull(), "missing on the target")
        checked = F.when(text.isNull(), F.col("ord_b")).otherwise(F.raise_error(text).cast("int"))
        return both.withColumn("ord_b", checked).select("dataset", "snap", "is_head", "ord_a", "ord_b",
                                                        "size_a", "size_b")
    return side_b.join(side_a, ["dataset", "snap", "is_head"], "left").select(
        "dataset", "snap", "is_head", "ord_a", "ord_b", "size_a", "size_b")


def order_conflicts(pairs: DataFrame) -> DataFrame:
    """Common versions that come in another order on the two sides. No numbering fits both
    then, and nothing can be compared (see ``version_list_diff``)."""
    both = pairs.filter("ord_a is not null")
    line = ordered.previous(both, ["dataset"], "ord_b", {"_before": "ord_a"}, ordered.int_chunk("ord_b"))
    return line.filter("_before > ord_a").select("dataset", "snap")


def _numbered(pairs: DataFrame) -> DataFrame:
    """Give the compared versions one common number ``v``: the original's."""
    return pairs.withColumn("v", F.col("ord_b"))


def _last_byte(grain: int):
    """Offset of a cell's last non-zero byte, -1 for a hole."""
    length = F.call_function("div", F.length(F.rtrim(F.hex("payload"), F.lit("0"))) + 1, F.lit(2))
    return F.when(F.col("_d").isNotNull(), F.col("cell") * grain + length - 1).otherwise(F.lit(-1).cast("long"))


def _in_common_numbers(history: DataFrame, pairs: DataFrame, side: str, grain: int, common: DataFrame | None = None) -> DataFrame:
    """Narrow rows ``(dataset, cell, block, v, ord, late, d, last)``: ``v`` = first compared version that sees the row,
    ``late`` = how far that version's own number is from the row's, ``d`` the digest of the content (NULL = hole).

    Both sides may number and skip versions differently. Written: payloads are read and hashed once. The last byte
    is looked for only where the sizes of the two sides differ.
    """
    marks = pairs.filter(F.col(f"ord_{side}").isNotNull()).select(
        "dataset", F.col(f"ord_{side}").alias("ord"), F.struct("v", F.col(f"ord_{side}").alias("mark")).alias("_m"))
    known = history.select("dataset", "ord").distinct().withColumn("_m", F.lit(None).cast("struct<v:int,mark:int>"))
    line = (marks.unionByName(known).groupBy("dataset", "ord").agg(F.max("_m").alias("_m"))
            .withColumn("_neg", -F.col("ord")))
    # one row per version: with its size known the history need not move to be numbered
    line = materialise(line, "numbers")
    chunk = None if ordered.history_chunk(line) is None else -ordered.int_chunk("ord")
    mapped = ordered.carry_forward(line, ["dataset"], "_neg", ["_m"], chunk).filter("_m is not null")
    uneven = (common or _common_sizes(pairs)).select("dataset", F.lit(True).alias("_uneven"))
    mapped = materialise(mapped.join(uneven, "dataset", "left").select("dataset", "ord", "_m", "_uneven"), "numbered")
    full = history.withColumn("payload", full_cell("payload", grain))
    rows = full.withColumn("_d", F.when(~is_hole("payload", grain), F.unhex(F.sha2("payload", 256))))
    return materialise(rows.join(mapped, ["dataset", "ord"]).select(
        *KEY, idiv("cell", BLOCK).alias("block"), F.col("_m.v").alias("v"), "ord", (F.col("_m.mark") - F.col("ord")).alias("late"),
        F.col("_d").alias("d"), F.when(F.col("_uneven"), _last_byte(grain)).alias("last")), f"side-{side}")


def block_digests(rows: DataFrame) -> DataFrame:
    """One row per (dataset, block of BLOCK cells): sums of two hashes over all rows of the block's whole history.

    Equal sums mean equal rows, and so equal content in every compared version. Summed before the shuffle.
    """
    what = [F.col("cell"), F.col("v"), F.col("late"), F.coalesce("d", F.lit(b""))]
    return rows.groupBy("dataset", "block").agg(
        F.sum(F.xxhash64(F.lit(1), *what).cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(2), *what).cast("decimal(20,0)")).alias("h2"),
        F.count(F.lit(1)).alias("n"))


def open_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Blocks ``(dataset, block)`` that have to be looked into: those whose digests differ, and those of datasets
    whose sizes differ in some version."""
    a, b = (block_digests(x).select("dataset", "block", F.struct("h1", "h2", "n").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, ["dataset", "block"], "full_outer")
    uneven = (common or _common_sizes(pairs)).select("dataset", F.lit(True).alias("_uneven"))
    return both.join(uneven, "dataset", "left").filter("not (a <=> b) or _uneven").select("dataset", "block")


def _common_sizes(pairs: DataFrame) -> DataFrame:
    """Smallest common size per dataset over the versions whose sizes differ."""
    return (pairs.filter("ord_a is not null and size_a <> size_b").groupBy("dataset")
            .agg(F.min(F.least("size_a", "size_b")).alias("_common")))


def compared_spans(a: DataFrame, b: DataFrame, pairs: DataFrame, grain: int) -> DataFrame:
    """Spans of versions ``[v, nxt)`` that matter: the core of the comparison.

    Columns: dataset, cell, v, nxt (NULL = to the end), ``differs``: whether the cell differs,
    at_a, at_b: the stored rows that hold the cell's content on each side (NULL = hole), and
    ``last``: the offset of the last non-zero byte on either side. A span in which the sides agree is
    listed only if it reaches past the common size of some version whose sizes differ.
    """
    p = _numbered(pairs)
    # written: its size is known then, so that no row of a cell is moved to a dataset's one key
    common = materialise(_common_sizes(p), "common-sizes")
    left, right = (_in_common_numbers(x, p, n, grain, common) for x, n in ((a, "a"), (b, "b")))
    # from the top: equal blocks are one row a side, only the others are opened
    opened = materialise(open_blocks(left, right, p, common), "open-blocks")
    chunk = ordered.history_chunk(p.select(F.col("v").alias("ord")))
    if chunk is not None:
        chunk = ordered.int_chunk("v")
    both = [x.join(opened, ["dataset", "block"], "left_semi").select(*KEY, "v", F.struct("ord", "d", "last").alias(n))
            for x, n in ((left, "sa"), (right, "sb"))]
    # a cell's line is moved once; of the rows that no compared version tells apart the latest holds
    line = both[0].unionByName(both[1], allowMissingColumns=True)
    line = (line if chunk is not None else line.repartition(*KEY)).groupBy(*KEY, "v").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    state = ordered.carry_forward(line, KEY, "v", ["sa", "sb"], chunk)
    if chunk is None:
        nxt = state.withColumn("nxt", F.lead("v").over(Window.partitionBy(*KEY).orderBy("v")))
    else:
        back = state.withColumn("_back", -F.col("v").cast("long"))
        nxt = ordered.previous(back, KEY, "_back", {"nxt": "v"}, -ordered.int_chunk("v"))
    unequal = ~F.col("sa.d").eqNullSafe(F.col("sb.d"))
    last = F.greatest(F.coalesce("sa.last", F.lit(-1)), F.coalesce("sb.last", F.lit(-1))).cast("long")
    return (nxt.join(common, "dataset", "left")
            .withColumn("differs", unequal).withColumn("last", last)
            .filter("differs or last >= _common")
            .select(*KEY, "v", "nxt", "differs", "last",
                    F.when(F.col("sa.d").isNotNull(), F.col("sa.ord")).alias("at_a"),
                    F.when(F.col("sb.d").isNotNull(), F.col("sb.ord")).alias("at_b")))


def differing_counts(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differing cells per compared version: +1 where a span starts, -1 where it ends."""
    p, spans = _numbered(pairs), spans.filter("differs")
    starts = spans.select("dataset", "v", F.lit(1).alias("n"))
    ends = spans.filter("nxt is not null").select("dataset", F.col("nxt").alias("v"), F.lit(-1).alias("n"))
    steps = starts.unionByName(ends).groupBy("dataset", "v").agg(F.sum("n").alias("n"))
    line = (p.select("dataset", "v", F.lit(True).alias("_p"))
            .join(steps, ["dataset", "v"], "full_outer")
            .withColumn("n", F.coalesce("n", F.lit(0))))
    sums = ordered.running_sums(line, ["dataset"], ["v"], {"cells_differ": "n"},
                                ordered.int_chunk("v", ordered.SPINE_CHUNK))
    return p.join(sums.filter("_p").select("dataset", "v", "cells_differ"), ["dataset", "v"])


def first_cells(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """First differing cell of each compared version."""
    return _least_per_version(spans.filter("differs"), pairs, F.struct("cell", "at_a", "at_b")).select(
        "dataset", "snap", "is_head", "v", "_f.cell", "_f.at_a", "_f.at_b")


def last_bytes(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Offset of the last non-zero byte of each compared version that ``spans`` know of."""
    return _least_per_version(spans, pairs, F.struct((-F.col("last")).alias("neg"))).select(
        "dataset", "snap", "is_head", (-F.col("_f.neg")).alias("_last"))


def _least_per_version(spans: DataFrame, pairs: DataFrame, value) -> DataFrame:
    """Smallest ``value`` among the spans that hold each version, without listing versions x cells.

    A span of versions is cut into aligned blocks of a binary tree (at most two per level),
    the smallest value is kept per block, and each version looks up the blocks above it.
    """
    last = pairs.groupBy("dataset").agg(F.max("ord_b").alias("_max"))
    s = spans.join(last, "dataset").select(
        "dataset", F.col("v").cast("long").alias("_lo"),
        F.coalesce(F.col("nxt"), F.col("_max") + 1).cast("long").alias("_hi"),
        value.alias("_first"))
    s = s.groupBy("dataset", "_lo", "_hi").agg(F.min("_first").alias("_first"))
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))

    def blocks(level):
        lo, hi = F.col("_lo"), F.col("_hi")
        # bounds of what is left for this level, in units of the level
        up = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        down = F.call_function("shiftright", hi, level)
        left = (up < down) & (F.pmod(up, F.lit(2)) == 1)
        right = (up < down) & (F.pmod(down, F.lit(2)) == 1) & ~(left & (up + 1 == down))
        return F.filter(F.array(F.when(left, F.struct(level.alias("level"), up.alias("block"))),
                                F.when(right, F.struct(level.alias("level"), (down - 1).alias("block")))),
                        lambda x: x.isNotNull())

    tree = materialise(s.select("dataset", "_first", F.explode(F.flatten(F.transform(levels, blocks))).alias("b"))
                       .groupBy("dataset", F.col("b.level").alias("level"), F.col("b.block").alias("block"))
                       .agg(F.min("_first").alias("_first")), "tree")
    # a version asks only the levels that its dataset's tree has: none where nothing was found
    used = tree.groupBy("dataset").agg(F.collect_set("level").alias("_levels"))
    asks = _numbered(pairs).join(used, "dataset").select("dataset", "snap", "is_head", "v", F.explode("_levels").alias("level")).withColumn(
        "block", F.call_function("shiftright", F.col("v").cast("long"), F.col("level")))
    # Spark takes an exploded table for as small as its source, and would send it whole through the driver
    return (asks.hint("merge").join(tree, ["dataset", "level", "block"])
            .groupBy("dataset", "snap", "is_head", "v").agg(F.min("_first").alias("_f")))


def first_diff(firsts: DataFrame, a: DataFrame, b: DataFrame, cell_size: int) -> DataFrame:
    """Byte offset of the first difference per version; reads two payloads per version.

    ``firsts`` is written first: its size is known then, and the histories are scanned for the
    few wanted payloads without being shuffled (or not at all when nothing differs).
    """
    firsts = materialise(firsts, "firsts")

    def payloads(history, side):
        keys = ["dataset", "cell", f"at_{side}"]
        wanted = firsts.filter(F.col(f"at_{side}").isNotNull()).select(*keys).distinct()
        return (history.select("dataset", "cell", F.col("ord").alias(f"at_{side}"), F.col("payload").alias(f"_p{side}"))
                .join(wanted, keys))
    blank = F.lit(bytes(cell_size))
    both = (firsts.join(payloads(a, "a"), ["dataset", "cell", "at_a"], "left")
            .join(payloads(b, "b"), ["dataset", "cell", "at_b"], "left")
            .withColumn("_pa", F.rpad(F.coalesce("_pa", blank), F.lit(cell_size), F.lit(b"\0")))
            .withColumn("_pb", F.rpad(F.coalesce("_pb", blank), F.lit(cell_size), F.lit(b"\0"))))
    at = F.filter(F.sequence(F.lit(1), F.lit(cell_size)),
                  lambda i: F.substring("_pa", i, F.lit(1)) != F.substring("_pb", i, F.lit(1)))
    return both.select("dataset", "snap", "is_head", "v",
                       (F.col("cell") * cell_size + F.get(at, F.lit(0)) - 1).alias("first_diff"))


def common_grain(history: DataFrame, cell_size: int, grain: int) -> DataFrame:
    rows = history.select("dataset", "ord", "cell", "payload")
    return rows if cell_size == grain else to_finer(rows, cell_size, grain)


def compare_history(a: DataFrame, versions_a: DataFrame, b: DataFrame, versions_b: DataFrame,
                    cell_a: int, cell_b: int | None = None, mode: str = "all",
                    snap: str | None = None) -> DataFrame:
    """Compare history ``a`` with the original ``b``, possibly kept at another cell size.

    One row per compared version: sizes, ``identical`` bytes, number of differing cells,
    ``first_diff`` and ``status``: ``same``, ``differs`` (inside the common size), ``tail``
    (bytes past the shorter size are not all zero, be they equal on both sides or not) or
    ``missing`` (no such version in ``a``). Where the sides agree but hold bytes past the shorter
    size, ``first_diff`` is the last of these bytes.
    """
    cell_b = cell_b or cell_a
    grain = min(cell_a, cell_b)
    # one row per version, read by every step below
    pairs = materialise(paired_versions(versions_a, versions_b, mode, snap), "pairs")
    turned = order_conflicts(pairs).limit(8).collect()
    if turned:
        raise ValueError("versions come in another order: " + ", ".join(f"{r['dataset']}@{r['snap']}" for r in turned))
    ga, gb = common_grain(a, cell_a, grain), common_grain(b, cell_b, grain)
    # small where the histories agree, and read twice below: written once
    spans = materialise(compared_spans(ga, gb, pairs, grain), "spans")
    counts = differing_counts(spans, pairs)
    offsets = first_diff(first_cells(spans, pairs), ga, gb, grain)
    common = F.least("size_a", "size_b")
    beyond = (F.col("size_a") != F.col("size_b")) & (F.coalesce("_last", F.lit(-1)) >= common)
    lost = F.raise_error(F.concat(F.lit("cells differ without a differing byte: "), "dataset", F.lit("@"), "snap")).cast("string")
    status = (F.when(F.col("ord_a").isNull(), "missing")
               .when((F.col("cells_differ") > 0) & F.col("first_diff").isNull(), lost)
               .when(F.col("first_diff") < common, "differs")
               .when((F.col("cells_differ") > 0) | beyond, "tail").otherwise("same"))
    return (counts.join(offsets.drop("v"), ["dataset", "snap", "is_head"], "left")
            .join(last_bytes(spans, pairs), ["dataset", "snap", "is_head"], "left")
            .withColumn("status", status)
            .withColumn("first_diff", F.coalesce("first_diff", F.when(beyond, F.col("_last"))))
            .withColumn("identical", F.when(F.col("status") == "same", common)
                        .when(F.col("status") != "missing", F.least("first_diff", common)))
            .select("dataset", "snap", "is_head", "size_a", "size_b",
                    F.when(F.col("ord_a").isNotNull(), F.col("cells_differ")).alias("cells_differ"),
                    F.when(F.col("status").isin("differs", "tail"), F.col("first_diff")).alias("first_diff"),
                    "status", "identical"))


def check_tail(cells: DataFrame, sizes: DataFrame, cell_size: int) -> DataFrame:
    """Zero-tail rule on one image: the first non-zero byte at or past ``common``.

    ``cells`` = live cells (dataset, cell, payload), ``sizes`` = (dataset, common). Returns
    the violating datasets with ``first_nonzero``.
    """
    start = F.col("cell") * cell_size
    past = (cells.join(sizes.select("dataset", "common"), "dataset")
            .filter(start + cell_size > F.col("common"))
            .withColumn("_skip", F.greatest(F.col("common") - start, F.lit(0)).cast("int"))
            .withColumn("_t", F.substring("payload", F.col("_skip") + 1, F.lit(cell_size)))
            .filter(~is_hole("_t", cell_size)))
    first = past.groupBy("dataset").agg(F.min(F.struct("cell", "_skip", "_t")).alias("f"))
    at = F.filter(F.sequence(F.lit(1), F.octet_length("f._t")),
                  lambda i: F.substring("f._t", i, F.lit(1)) != F.lit(b"\0"))
    return first.select("dataset", (F.col("f.cell") * cell_size + F.col("f._skip") + F.get(at, F.lit(0)) - 1)
                        .alias("first_nonzero"))


def version_list_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Versions whose name or position differs between two catalogs (empty = equal)."""
    la = a.select("dataset", "snap", F.col("ord").alias("ord_a"))
    lb = b.select("dataset", "snap", F.col("ord").alias("ord_b"))
    return la.join(lb, ["dataset", "snap"], "full_outer").filter(
        ~F.col("ord_a").eqNullSafe(F.col("ord_b"))).select("dataset", "snap", "ord_a", "ord_b")


def compare_totals(report: DataFrame) -> DataFrame:
    """Overall verdict per dataset."""
    def n(s):
        return F.sum((F.col("status") == s).cast("long")).alias(s)
    return report.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("versions"), n("same"), n("differs"), n("tail"), n("missing"),
        F.sum(F.coalesce("identical", F.lit(0))).cast("long").alias("identical"),
        F.every(F.col("status") == "same").alias("passed"))


def verify_only(a: DataFrame, versions_a: DataFrame, b: DataFrame, versions_b: DataFrame,
                cell_a: int, cell_b: int | None = None, mode: str = "all",
                snap: str | None = None) -> DataFrame:
    """Compare two stored histories without any transfer; a missing target is an error."""
    if not versions_a.limit(1).count():
        raise ValueError("the target has no versions: nothing to verify")
    return compare_history(a, versions_a, b, versions_b, cell_a, cell_b,
                           "all" if mode == "none" else mode, snap)
