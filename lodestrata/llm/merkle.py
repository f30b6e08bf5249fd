"""Merkle manifest of a documents table by slot pivots.

A leaf is the SHA-256 of a row's fields. Within a source, leaves ascend by doc_id; every ``FANOUT`` consecutive
nodes become their parent until one, the source's subroot, is left; subroots ascend by source and become the
root in the same way. Digests are joined as lowercase hex text.

A level is one grouping: conditional aggregates spread the children of each parent into ``FANOUT`` columns.
Joining the columns' text and hashing it gives the parent; leaving out a child's own column gives its siblings.
On the way down each parent hands its children what stands left and right of them, and what stood so above, so
that a leaf's proof is hashed, and its path to the root is folded anew, in the row of its parent.

Places within a source come from a sort by range: a row's place in its part of the sort, and the counts of the
parts before. No source gathers in one task, however many rows it has; a level has a sixteenth of the rows of
the one below, and what a leaf's parent carries for its children is written once for sixteen of them.

Defined results: a null field is ``-``; null sources come first, null ids first in their source; rows of equal
ids stand in order of their leaves; a source of one leaf has that as its subroot; an empty table gives no rows;
columns besides the five take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, settle

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(name)) for name in FIELDS[:-1]], field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def every_fifth(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """(grp, item, hash): a leaf a row; item holds doc_id and, where ``changed``, the leaf the row has with ``text``.

    ``grp`` orders as sources do, null first.
    """
    own = docs.select(*FIELDS)
    item = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.when(changed, leaf(text)).alias("changed"))
    return own.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"), item.alias("item"), leaf(F.col("text")).alias("hash"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with place, from 0 in the group's order, and size, the number of nodes of the group."""
    rows = settle(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    keys = [F.asc_nulls_first(name) for name in ["grp", *order, "row"]]
    dealt = rows.repartitionByRange(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = settle(dealt.withColumn("at", F.monotonically_increasing_id()).drop("row"), "sorted")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))  # the upper bits of such an id are the partition
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = settle(parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size")), "parts")
    return dealt.join(parts, ["grp", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Tree:
    """``levels``: a table a level with a row a parent (grp, place, size, c0 ... of structs with hash).

    ``lone``: the nodes that are their group's only ones. ``roots``: (grp, level, hash), a row a group.
    """

    levels: list[DataFrame]
    lone: DataFrame
    roots: DataFrame


SLOTS = [f"c{k}" for k in range(FANOUT)]


def pivot(nodes: DataFrame) -> DataFrame:
    """A row a parent with its children in FANOUT columns, null past the last one."""
    child = F.struct(*[name for name in nodes.columns if name not in ("grp", "place", "size")])
    slots = [F.max(F.when(F.col("place") % FANOUT == k, child)).alias(name) for k, name in enumerate(SLOTS)]
    size = F.ceil(F.max("size") / FANOUT).alias("size")
    return nodes.groupBy("grp", F.floor(F.col("place") / FANOUT).alias("parent")).agg(*slots, size).withColumnRenamed("parent", "place")


def build(nodes: DataFrame) -> Tree:
    """The tree over placed nodes, all groups side by side."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    lone = nodes.filter("size = 1")
    levels: list[DataFrame] = []
    roots = lone.select("grp", F.lit(0).alias("level"), "hash")
    while largest > 1:
        levels.append(settle(pivot(nodes.filter("size > 1")), "level"))
        largest = -(-largest // FANOUT)
        nodes = levels[-1].select("grp", "place", "size", F.sha2(F.concat_ws("", *[f"{c}.hash" for c in SLOTS]), 256).alias("hash"))
        roots = roots.union(nodes.filter("size = 1").select("grp", F.lit(len(levels)), "hash"))
    return Tree(levels, lone, roots)


def _children() -> Column:
    """The slots of a parent, each with the digests of the slots left and right of it."""
    digests = F.array(*[f"{c}.hash" for c in SLOTS])
    beside = lambda start, count: F.concat_ws("", F.slice(digests, start, count))
    return F.transform(
        F.array(*SLOTS), lambda child, s: F.struct(beside(F.lit(1), s).alias("left"), beside(s + 2, F.lit(FANOUT)).alias("right"), child.alias("child"))
    )


def descend(tree: Tree, tops: DataFrame, kept: list[str]) -> DataFrame:
    """(item, hash, steps, ``kept``): the lowest nodes, each with what stands beside its path, from below to above.

    ``tops`` has for each group its root's level, the root's own steps and the columns ``kept``.
    """
    tops = settle(tops, "tops")
    here = None
    for k in reversed(range(len(tree.levels))):
        top = tops.filter(F.col("level") == k + 1).select("grp", F.lit(0).cast("long").alias("place"), "steps", *kept)
        here = top if here is None else settle(here, "below").unionByName(top)
        below = tree.levels[k].join(here, ["grp", "place"]).select("grp", "place", "steps", *kept, F.posexplode(_children()).alias("slot", "own"))
        below = below.filter("own.child IS NOT NULL")
        steps = F.concat(F.array(F.struct("own.left", "own.right")), "steps").alias("steps")
        here = below.select("grp", (F.col("place") * FANOUT + F.col("slot")).alias("place"), steps, *kept, *(["own.child.*"] if k == 0 else []))
    lone = tree.lone.join(tops.filter("level = 0"), "grp").select("item", tree.lone["hash"], "steps", *kept)
    return lone if here is None else here.select("item", "hash", "steps", *kept).union(lone)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and what stands beside its path lead to."""
    return F.aggregate(steps, start, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proofs(docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, changed): a row a document with its siblings up to the root.

    ``changed`` is the leaf that the row has with ``text``, null where the column ``changed`` is false.
    """
    nodes = placed(leaves(docs, changed, text).withColumn("doc_id", F.col("item.doc_id")), ["doc_id", "hash"]).drop("doc_id")
    own = build(nodes)
    sources = own.roots.select(F.lit("").alias("grp"), F.struct(F.col("grp").alias("source"), "level").alias("item"), "hash")
    above = build(placed(sources.withColumn("source", F.col("item.source")), ["source"]).drop("source"))
    root = above.roots.select("grp", "level", F.array().cast(STEPS).alias("steps"), F.col("hash").alias("root"))
    subroots = descend(above, root, ["root"])
    tops = subroots.select(F.col("item.source").alias("grp"), "item.level", "steps", "root", F.col("hash").alias("subroot"))
    found = descend(own, tops, ["root", "subroot"])
    return found.select("item.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "steps", "item.changed")


def manifest(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row a document.

    Rows where ``changed`` holds are folded from the leaf they have with ``text``; by default every fifth with
    its capitals lowered.
    """
    changed = every_fifth(F.col("doc_id")) if changed is None else changed
    found = proofs(docs, changed, lowered(F.col("text")) if text is None else text)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
