"""Merkle manifest of a dataset, by nested-interval labels.

Every row is a leaf. The leaves of a group (a source) are ranked by an order column; a node carries the
interval ``lo .. hi`` of leaf ranks it covers, its level and its hash. Level l holds intervals of up to
FANOUT^l leaves, cut at its multiples, so ``lo div FANOUT^l`` is the bucket of a node. A node meets its parent in
an equi join on the bucket of the level above, with containment as the condition; the siblings of a node are the
intervals inside the parent's that lie before or after its own. The roots of the groups are the leaves of one more
tree above them.

Scale: texts are hashed where they are read; only ids and digests move. Ranks come from one range shuffle and
the row counts of its pieces, so a hot group is spread over many tasks. A key of a group-by or join
is one parent: FANOUT children at most. Levels shrink by FANOUT, so all levels together cost about one
shuffle of the leaves, and paths are passed down level by level instead of joining every leaf with
every ancestor. The driver sees the size of the largest group, to know the number of levels, and the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Children of a node.
FANOUT = 16
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name of the tree above the groups.
ABOVE = "above"


def combined(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return combined(*[encoded(v) for v in values])


def bucket(level: int, at: str = "lo") -> Column:
    return F.call_function("div", F.col(at), F.lit(FANOUT ** level).cast("long"))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``lo`` = ``hi``, their 0-based rank inside ``tree`` by ``order``, and ``n``, the size of the tree.

    One range shuffle sorts all rows; a last, arbitrary key lets equal rows be cut apart. A rank is the place
    in the written piece plus the rows of the tree in earlier pieces, of which there is one number per piece and tree.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "spread")]
    cut = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    laid = materialise(cut.withColumn("at", F.monotonically_increasing_id()), label)
    pieces = (laid.groupBy(F.col("tree").alias("of_tree"), F.shiftright("at", 33).alias("piece"))
              .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")))
    whole = Window.partitionBy("of_tree")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = materialise(pieces.select("of_tree", "piece", "first", F.sum("rows").over(whole).alias("n"),
                                       F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), label + "-pieces")
    rank = F.col("at") - F.col("first") + F.col("before")
    return (laid.join(pieces, (F.col("tree") == F.col("of_tree")) & (F.shiftright("at", 33) == F.col("piece")))
            .withColumns({"lo": rank, "hi": rank}).drop("at", "of_tree", "piece", "first", "before"))


@dataclass
class Trees:
    """``levels[l]``: the nodes (tree, n, lo, hi, hash, and from level 1 ``family``, the (lo, hi, hash) of the
    children) of level l. A tree ends at the level where one node covers all its ``n`` leaves."""

    levels: list[DataFrame]

    def tops(self, level: int) -> DataFrame:
        """Nodes of this level that cover a whole tree."""
        low, high = (FANOUT ** (level - 1) if level else 0), FANOUT ** level
        return self.levels[level].where((F.col("n") > low) & (F.col("n") <= high))

    def roots(self) -> DataFrame:
        """(tree, hash), one row per tree."""
        out = self.tops(0).select("tree", "hash")
        for level in range(1, len(self.levels)):
            out = out.unionByName(self.tops(level).select("tree", "hash"))
        return out

    def paths(self, above: DataFrame, keep: list[str]) -> DataFrame:
        """The leaves with what stands beside them on the way up: ``path``, one (left, right) per level, the hashes of
        the siblings before and after, and then the path of the tree itself, ``above`` (of_tree, path, ...);
        its other columns and the leaves' columns ``keep`` are carried."""
        extra = [c for c in above.columns if c not in ("of_tree", "path")]
        node = ["tree", "lo", "hi"]

        def family(level):
            return ["family"] if level else keep

        def started(level):
            return (self.tops(level).join(above, F.col("tree") == F.col("of_tree"))
                    .select(*node, *family(level), "path", *extra))
        parents = started(len(self.levels) - 1)
        for level in reversed(range(len(self.levels) - 1)):
            high = FANOUT ** level
            inner = self.levels[level].where(F.col("n") > high).select(*node, *family(level), bucket(level + 1).alias("bucket"))
            p = parents.select(F.col("tree").alias("of_tree"), bucket(level + 1).alias("of_bucket"), F.col("lo").alias("from"),
                               F.col("hi").alias("to"), F.col("family").alias("kin"), "path", *extra)
            contained = ((F.col("tree") == F.col("of_tree")) & (F.col("bucket") == F.col("of_bucket"))
                         & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to")))

            def hashes(difference):
                return F.array_join(F.transform(F.filter("kin", difference), lambda c: c["hash"]), "")
            beside = F.struct(hashes(lambda c: c["hi"] < F.col("lo")).alias("left"), hashes(lambda c: c["lo"] > F.col("hi")).alias("right"))
            attached = inner.join(p, contained).select(
                *node, *family(level), F.concat(F.array(beside), F.col("path")).alias("path"), *extra)
            parents = attached.unionByName(started(level))
        return parents


def grown(leaves: DataFrame, label: str) -> Trees:
    """The trees over ranked ``leaves`` (tree, n, lo, hi, hash, ...); each level is written once."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > FANOUT ** (len(levels) - 1):
        level = len(levels)
        kin = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash")))
        nodes = (levels[-1].where(F.col("n") > FANOUT ** (level - 1))
                 .groupBy("tree", "n", bucket(level).alias("bucket")).agg(kin.alias("family")))
        hashed = nodes.select("tree", "n", F.get("family", F.lit(0))["lo"].alias("lo"), F.element_at("family", -1)["hi"].alias("hi"),
                              combined(F.array_join(F.transform("family", lambda c: c["hash"]), "")).alias("hash"), "family")
        levels.append(materialise(hashed, f"{label}-{level}"))
    return Trees(levels)


@dataclass
class Manifest:
    """A built manifest: ``groups`` are the trees of the groups, ``above`` the tree over their roots, ``root`` its hash
    (None for an empty table), ``carried`` the caller's columns on a leaf."""

    groups: Trees
    above: Trees
    root: str | None
    carried: list[str]

    def nodes(self) -> DataFrame:
        """All nodes: (tree, level, lo, hi, hash). Trees of groups are named ``=`` and the group, or empty for the null
        group; the tree over them is named ``above``."""
        parts = [t.select("tree", F.lit(level).alias("level"), "lo", "hi", "hash")
                 for trees in (self.groups, self.above) for level, t in enumerate(trees.levels)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """Per leaf: the carried columns, ``subroot`` and ``path``, (left, right) from the leaf up to the root."""
        spark = self.groups.levels[0].sparkSession
        start = spark.createDataFrame([(ABOVE, [])], "of_tree string, path array<struct<left: string, right: string>>")
        # one row per group, used at every level: written, so that its size is known to the joins
        of_groups = materialise(self.above.paths(start, ["group", "hash"]).select(
            F.col("group").alias("of_tree"), F.col("hash").alias("subroot"), "path"), "group-paths")
        return self.groups.paths(of_groups, ["leaf", *self.carried]).select("leaf", *self.carried, "subroot", "path")


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
          carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: leaves are ``fields`` in order, grouped by ``group``, ascending by ``order``.

    ``carry`` are expressions over ``docs`` kept on the leaves; other columns are not read, so their names cannot
    clash (a name of ``carry`` must not be one of tree, n, lo, hi, hash, leaf, family, path, subroot).
    Nulls are leaves like any other: a null field is written ``-``, the null group comes first, a null order
    value first in its group. Rows of one group and order value are ordered by their hash, so equal rows change
    places without effect and reruns agree. Texts of any length are hashed whole. An empty table has no leaves and root None.
    """
    carry = carry or {}
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("_order"), leaf_hash(*[F.col(c) for c in fields]).alias("hash"),
                         *[e.alias(c) for c, e in carry.items()])
    # written: a range shuffle reads its input twice, once for the bounds, and texts should be hashed once
    placed = ranked(materialise(leaves, "hashed"), ["_order", "hash"], "leaves").drop("_order").withColumn("leaf", F.col("hash"))
    groups = grown(placed, "groups")
    subroots = groups.roots().select(F.lit(ABOVE).alias("tree"), F.col("tree").alias("group"), "hash")
    above = grown(ranked(subroots, ["group"], "subroots"), "above")
    top = above.roots().first()
    return Manifest(groups, above, top["hash"] if top else None, list(carry))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to. A node without siblings is still hashed."""
    return F.aggregate(path, leaf, lambda acc, p: combined(p["left"], acc, p["right"]))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, leaf, subroot, root, proof_sha256, and for the documents tampered with
    (5 divides the CRC-32 of the decimal doc_id: A-Z of the text lower-cased) or as they are: folded_root, verified."""
    lowered = leaf_hash(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    manifest = build(docs, carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    rows = manifest.proofs().select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
