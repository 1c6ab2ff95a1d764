"""A Merkle manifest of a dataset, with inclusion proofs by stored parent preimages.

Rows are hashed to leaves; the leaves of each group stand in one order, and every FANOUT consecutive nodes
become one parent, level by level, until one node is left: the group's subroot. The subroots, by group,
are the leaves of one more tree, whose last node is the root. A parent is stored as its preimage, the
concatenated 64-character digests of its children, beside the digest of that. A node's ancestors are found
from the top down: each node joins its parent's preimage and what stands above the parent, so a leaf gets
all its ancestor preimages in one last join with a row for FANOUT leaves. Cutting a leaf's own 64 characters
out of a preimage leaves its siblings; putting another digest there and hashing folds a changed leaf to a root.

Leaves are numbered by ranges: a task sorts and numbers its own range, and the counts of the ranges before
it are added, so no group meets in one task, whatever it holds. A later join has one range or FANOUT rows for
a key at most. Each level is a table in the shared folder.

Cases: a null value is hashed as "-" and differs from an empty one ("0:"). Leaves of a group ascend by id
(null first), then by digest; rows equal in everything are leaves of their own and each gets one of their
places. Null groups come first. A group with one leaf is its own subroot; a table of one row is its own root,
and its proof is the digest of no text. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .util import staged

FANOUT, DIGEST = 8, 64
#: Rows of a range that one task numbers.
RANGE_ROWS = 200_000


def field(value: Column) -> Column:
    """A value as it is hashed: "-", or its UTF-8 byte count, ":" and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with _range and _at, each one's task and its place there, in the order of (group, order), and for each (group, _range) of them
    _add (what to add to _at to number the rows of a group from 0) and _n (rows of the group). rows must be staged.
    """
    schema = StructType([*rows.schema.fields, StructField("_range", LongType()), StructField("_at", LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.append_column("_range", pa.array(np.full(b.num_rows, own, dtype=np.int64))).append_column("_at", pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // RANGE_ROWS)
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_tie")
    ranged = staged(ranged.sortWithinPartitions(group, *order, "_tie").drop("_tie").mapInArrow(count, schema), "ranged")
    held = ranged.groupBy(group, "_range").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, held.select(group, "_range", (before - F.col("first")).alias("_add"), F.sum("n").over(whole).alias("_n"))


def parent(idx: Column) -> Column:
    return F.floor(idx / FANOUT).cast("long")


def levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The parents of (tree, idx, n, hash) rows, n being the nodes of the tree: (tree, idx, n, preimage, hash) of each level, and the
    last node of every tree (tree, height, hash). most: the largest n. A tree has no nodes in the levels above its last one.
    """
    out, tops = [], nodes.filter("n = 1").select("tree", F.lit(0).alias("height"), "hash")
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        made = nodes.filter("n > 1").groupBy("tree", parent(F.col("idx")).alias("idx")).agg(F.ceil(F.first("n") / FANOUT).cast("long").alias("n"), F.array_join(run["hash"], "").alias("preimage"))
        out.append(staged(made.withColumn("hash", F.sha2("preimage", 256)), "level"))
        nodes, most = out[-1].select("tree", "idx", "n", "hash"), -(-most // FANOUT)
        tops = tops.unionByName(nodes.filter("n = 1").select("tree", F.lit(len(out)).alias("height"), "hash"))
    return out, tops


#: What stands above a node, from its parent up: its slot in each preimage, and the preimage.
ABOVE = "array<struct<slot:int,preimage:string>>"


def with_above(leaves: DataFrame, parents: list[DataFrame], tops: DataFrame) -> DataFrame:
    """leaves (tree, idx, ...) with above and the other columns of tops.

    tops (tree, height, above, ...): what stands above each tree's last node, and what all leaves of the tree share. Both
    go down with the preimages, level by level, so a tree's own row never meets all of its leaves.
    """
    shared = [c for c in tops.columns if c not in ("tree", "height", "above")]

    def joined(nodes: DataFrame, over: DataFrame) -> DataFrame:
        both = nodes.join(over, (F.col("tree") == F.col("_tree")) & (parent(F.col("idx")) == F.col("_parent")))
        step = F.array(F.struct((F.col("idx") % FANOUT).cast("int").alias("slot"), F.col("_preimage").alias("preimage")))
        own = F.when(F.col("_preimage").isNull(), F.col("_above")).otherwise(F.concat(step, F.col("_above")))
        return both.withColumn("above", own).drop("_tree", "_parent", "_preimage", "_above")

    known = None
    for k in range(len(parents), -1, -1):
        ends = tops.filter(F.col("height") == k).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_parent"), F.lit(None).cast("string").alias("_preimage"), F.col("above").alias("_above"), *shared)
        over = ends if known is None else known.unionByName(ends)
        if k:
            made = joined(parents[k - 1].select("tree", "idx", F.col("preimage").alias("own")), over)
            known = staged(made.select(F.col("tree").alias("_tree"), F.col("idx").alias("_parent"), F.col("own").alias("_preimage"), F.col("above").alias("_above"), *shared), "above")
    return joined(leaves, over)


def siblings(above: Column) -> Column:
    """All digests beside a node and its ancestors, left to right, level by level: each preimage without the own slot."""
    cut = F.transform(above, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substr(s["preimage"], (s["slot"] + 1) * DIGEST + 1)))
    return F.array_join(cut, "")


def fold(leaf: Column, above: Column) -> Column:
    """The root that a leaf's digest gives, put in its slot of the first preimage, that one's digest in the next, and so on."""

    def put(own: Column, s: Column) -> Column:
        rest = F.substr(s["preimage"], (s["slot"] + 1) * DIGEST + 1)
        return F.sha2(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * DIGEST), own, rest), 256)

    return F.aggregate(above, leaf, put)


def manifest(rows: DataFrame) -> DataFrame:
    """rows (group, id, leaf, and columns of any other name without a leading underscore) with subroot, root and above (see siblings() and fold()).

    leaf is the row's digest (see digest()); the leaves of a group stand by id, then digest.
    """
    own = rows.columns
    ranged, ranges = numbered(staged(rows, "leaves"), "group", ["id", "leaf"])
    ranges = staged(ranges, "ranges")
    #: Groups are numbered likewise: null first, then bytewise.
    groups = staged(ranges.groupBy("group").agg(F.first("_n").alias("_size")).withColumn("all", F.lit(0)), "groups")
    placed, begin = numbered(groups, "all", ["group"])
    placed = placed.join(begin.select("_range", "_add"), "_range").select(F.col("group").alias("_group"), (F.col("_at") + F.col("_add")).alias("tree"))
    ranges = staged(ranges.join(placed, F.col("group").eqNullSafe(F.col("_group"))).select("_group", F.col("_range").alias("_r"), "_add", F.col("_n").alias("n"), "tree"), "places")
    nodes = ranged.join(ranges, (F.col("_range") == F.col("_r")) & F.col("group").eqNullSafe(F.col("_group")))
    nodes = staged(nodes.select(*own, "tree", "n", (F.col("_at") + F.col("_add")).alias("idx")), "nodes")
    largest, trees = groups.agg(F.max("_size"), F.count("*")).first()
    parents, subroots = levels(nodes.select("tree", "idx", "n", F.col("leaf").alias("hash")), largest or 0)
    zero, last = F.lit(0).cast("long").alias("tree"), F.lit(trees).alias("n")
    subroots = staged(subroots, "subroots")
    upper, root = levels(subroots.select(zero, F.col("tree").alias("idx"), last, "hash"), trees)
    root = root.select("tree", "height", F.array().cast(ABOVE).alias("above"), F.col("hash").alias("root"))
    tops = with_above(subroots.select(zero, F.col("tree").alias("idx"), F.col("height").alias("own_height"), F.col("hash").alias("subroot")), upper, root)
    tops = staged(tops.select(F.col("idx").alias("tree"), F.col("own_height").alias("height"), "above", "subroot", "root"), "tops")
    return with_above(nodes, parents, tops).select(*own, "subroot", "root", "above")
