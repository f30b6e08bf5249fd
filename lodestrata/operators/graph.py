"""Graph operators: frontier searches, degrees, slices, validation and compaction, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dealt, settle

#: The legal (source kind, edge kind, target kinds).
EDGE_RULES = [
    ("File", "CONTAINS", "Module Class Function Method Constant Section"),
    ("Module", "DEFINES", "Class Function Constant Section"),
    ("Class", "DEFINES", "Method Constant"),
    ("Module", "IMPORTS", "Module External"),
    ("Section", "IMPORTS", "Module External"),
    ("Function", "CALLS", "Function Method External"),
    ("Method", "CALLS", "Function Method External"),
    ("Class", "INHERITS", "Class External"),
    ("Function", "REFERENCES", "Class Function Method Constant External"),
    ("Method", "REFERENCES", "Class Function Method Constant External"),
]


def edge_allowed(src_kind: Column, kind: Column, dst_kind: Column) -> Column:
    legal = F.lit(False)
    for a, k, b in EDGE_RULES:
        legal = legal | ((src_kind == a) & (kind == k) & dst_kind.isin(b.split()))
    return F.coalesce(legal, F.lit(False))


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src_id").alias("here"), F.col("dst_id").alias("there"), "kind", F.lit("out").alias("way"))
    return out.union(edges.select(F.col("dst_id").alias("here"), F.col("src_id").alias("there"), "kind", F.lit("in").alias("way")))


def held(edges: DataFrame, depth: int) -> DataFrame:
    """The edges as a written table where a search reads them more than once: one way only, both are made as they are read."""
    return settle(edges.select("src_id", "kind", "dst_id"), "edges") if depth > 1 else edges


def reach(steps: DataFrame, seeds: DataFrame, depth: int, barred: DataFrame | None = None) -> DataFrame:
    """(node_id, depth) within ``depth`` steps of the seeds, seeds at 0; nodes in ``barred`` are not entered.

    ``steps`` has here and there, and is read once a round; edges that are dear to make are written before (``held``).
    Each round joins only the newest nodes, drops those met before and is written, so the plan does not grow with
    depth. Steps may repeat: what they lead to is made distinct, which is less than all of them.
    """
    met = seeds.select("node_id").distinct().withColumn("depth", F.lit(0).cast("long"))
    newest = met
    for k in range(1, depth + 1):
        found = steps.join(newest.select(F.col("node_id").alias("here")), "here", "left_semi").select(F.col("there").alias("node_id")).distinct()
        found = found.join(met, "node_id", "left_anti")
        if barred is not None:
            found = found.join(barred.select("node_id"), "node_id", "left_anti")
        newest = settle(found.withColumn("depth", F.lit(k).cast("long")), "frontier")
        met = met.union(newest)
    return met


#: What a caller can follow from a node, as (edge kind, way); ``all`` follows any edge.
DIRECTIONS = {"callers": ("CALLS", "in"), "callees": ("CALLS", "out"), "imports": ("IMPORTS", "out"), "imported_by": ("IMPORTS", "in"), "inherits": ("INHERITS", "out"), "all": None}
NEIGHBOURS, EDGES = 50, 200


def explore(edges: DataFrame, seed: DataFrame, direction: str, depth: int) -> DataFrame:
    """(node_id, distance, relation) by breadth-first search from the one node of ``seed``.

    A node's relation is the edge that meets it first when nodes are taken in the order they were found, and edges of a
    node by (other, kind, way). A node's place in that order is the list of ids on its way, which compares as text.
    """
    rule = DIRECTIONS[direction]
    own = held(edges.filter(F.col("kind") == rule[0]) if rule else edges, depth)
    steps = both_ways(own).filter(F.col("way") == rule[1]) if rule else both_ways(own)
    newest = seed.select("node_id", F.lit("").alias("place"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("relation"))
    met = newest
    for k in range(1, depth + 1):
        found = steps.join(newest.select(F.col("node_id").alias("here"), "place"), "here").groupBy(F.col("there").alias("node_id")).agg(F.min(F.struct("place", "kind", "way")).alias("first"))
        found = found.join(met.select("node_id"), "node_id", "left_anti")
        relation = F.concat("first.kind", F.when(F.col("first.way") == "out", " ->").otherwise(" <-"))
        newest = settle(found.select("node_id", F.concat("first.place", F.lit("\0"), "node_id").alias("place"), F.lit(k).cast("long").alias("distance"), relation.alias("relation")), "frontier")
        met = met.union(newest)
    return met.filter("distance > 0").drop("place")


def nearest(reached: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """The first ``most`` by (distance, node_id), and whether there were more."""
    kept = reached.orderBy("distance", "node_id").limit(most + 1)
    order = Window.orderBy("distance", "node_id")  # over most + 1 rows
    return kept.withColumn("n", F.row_number().over(order)).withColumn("truncated", F.max("n").over(Window.partitionBy(F.lit(1))) > most).filter(F.col("n") <= most).drop("n")


def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct edges with both ends in ``ids``."""
    ends = [ids.select(F.col("node_id").alias(c)) for c in ("src_id", "dst_id")]
    return edges.join(ends[0], "src_id", "left_semi").join(ends[1], "dst_id", "left_semi").select("src_id", "kind", "dst_id").distinct()


def explored_edges(edges: DataFrame, seed: DataFrame, kept: DataFrame, most: int = EDGES) -> DataFrame:
    """The first ``most`` edges among the seed and its kept neighbours, and whether there were more."""
    found = edges_among(edges, seed.select("node_id").union(kept.select("node_id"))).orderBy("src_id", "kind", "dst_id").limit(most + 1)
    order = Window.orderBy("src_id", "kind", "dst_id")
    return found.withColumn("n", F.row_number().over(order)).withColumn("truncated", F.max("n").over(Window.partitionBy(F.lit(1))) > most).filter(F.col("n") <= most).drop("n")


def neighbours(edges: DataFrame, start: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """Nodes within ``depth`` undirected steps, the start itself left out."""
    own = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    return reach(both_ways(held(own, depth)).select("here", "there"), start, depth).filter("depth > 0")


def graph_candidates(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth, score) by undirected steps that never enter External nodes; seeds always stay."""
    met = reach(both_ways(held(edges, depth)).select("here", "there"), seeds, depth, nodes.filter("kind = 'External'"))
    return met.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.col("depth")))


def directed(edges: DataFrame, start: DataFrame, kind: str, way: str, depth: int) -> DataFrame:
    """Callers, callees, imports and the like: steps of one kind and one orientation."""
    own = both_ways(held(edges.filter(F.col("kind") == kind), depth)).filter(F.col("way") == way).select("here", "there")
    return reach(own, start, depth).filter("depth > 0")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src_id").alias("node_id")).union(edges.select("dst_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def _ways(edges: DataFrame, parts: int | None) -> list[DataFrame]:
    """(node_id, neighbour), distinct, out and in; edges that are dealt out by src_id are shuffled for the latter only."""
    pairs = edges.select("src_id", "dst_id").distinct()
    way = lambda here, there: pairs.select(F.col(here).alias("node_id"), F.col(there).alias("neighbour"))
    return [way("src_id", "dst_id"), dealt(way("dst_id", "src_id"), parts, "node_id")]


def slices(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """One-step slices of nodes that are not External: distinct neighbours in and out and their counts."""
    found = dealt(nodes.filter("kind <> 'External'").select("node_id"), parts, "node_id")
    for way, met in zip(("out", "in"), _ways(edges, parts), strict=True):
        found = found.join(met.groupBy("node_id").agg(F.count("neighbour").alias(f"n_{way}"), F.min("neighbour").alias(f"first_{way}")), "node_id", "left")
    return found.fillna(0, ["n_out", "n_in"]).withColumn("degree", F.col("n_out") + F.col("n_in"))


def slice_lists(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(node_id, way, neighbour), distinct, of nodes that are not External, which are looked up by hash."""
    inner = dealt(nodes.filter("kind <> 'External'").select("node_id"), parts, "node_id").hint("shuffle_hash")
    outs, ins = [met.join(inner, "node_id", "left_semi").select("node_id", F.lit(way).alias("way"), "neighbour") for way, met in zip(("out", "in"), _ways(edges, parts), strict=True)]
    return outs.union(ins)


def with_ends(edges: DataFrame, facts: DataFrame, parts: int | None = None) -> DataFrame:
    """``edges`` with what ``facts`` (node_id and more) say of both ends, as src_... and dst_..., null where they do not have the node.

    Facts are looked up by hash and their tasks are as many as stated, so edges are not sorted and need no memory of their own.
    """
    for end in ("src", "dst"):
        own = facts.select(F.col("node_id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in facts.columns if c != "node_id"])
        edges = edges.join(dealt(own, parts, f"{end}_id").hint("shuffle_hash"), f"{end}_id", "left")
    return edges


def validate(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(src_id, kind, dst_id, issue): orphan, self_edge or edge_rule, the first that holds."""
    both = with_ends(edges, nodes.select("node_id", "kind"), parts)
    issue = F.when(F.col("src_kind").isNull() | F.col("dst_kind").isNull(), "orphan").when(F.col("src_id") == F.col("dst_id"), "self_edge").when(~edge_allowed(F.col("src_kind"), F.col("kind"), F.col("dst_kind")), "edge_rule")
    return both.withColumn("issue", issue).filter("issue is not null").select("src_id", "kind", "dst_id", "issue")


def id_mismatches(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Nodes, but External ones, whose unit has another id; ``units`` has node_id and unit_id."""
    return nodes.filter("kind <> 'External'").join(units.select("node_id", "unit_id"), "node_id").filter("unit_id <> node_id").select("node_id", F.lit("id_mismatch").alias("issue"))


def prefixes(qname: Column) -> Column:
    """Proper dotted prefixes, as (depth, prefix), from the name alone."""
    parts = F.split(qname, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), ".").alias("prefix")))


def nearest_module(nodes: DataFrame) -> DataFrame:
    """(node_id, module_id): the module with the longest proper prefix of the node's name, by equal keys, not ranges."""
    modules = nodes.filter("kind = 'Module'").select(F.col("qualified_name").alias("prefix"), F.col("node_id").alias("module_id"))
    held = nodes.filter("instr(qualified_name, '.') > 0").select("node_id", F.explode(prefixes(F.col("qualified_name"))).alias("p")).select("node_id", "p.depth", "p.prefix")
    return held.join(modules, "prefix").groupBy("node_id").agg(F.max_by("module_id", "depth").alias("module_id"))


def compaction(nodes: DataFrame, edges: DataFrame, centrality: DataFrame, threshold: float, leaf_kinds: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Leaves of low centrality fold into their module; the edges that touch them, rewritten, distinct, without loops."""
    folded = nodes.filter(F.col("kind").isin(leaf_kinds)).join(centrality, "node_id").filter(F.col("centrality") < threshold).join(nearest_module(nodes), "node_id").select("node_id", "module_id")
    moved = with_ends(edges, folded.withColumnRenamed("module_id", "module"), parts).filter("src_module is not null or dst_module is not null")
    moved = moved.select(F.coalesce("src_module", "src_id").alias("src_id"), "kind", F.coalesce("dst_module", "dst_id").alias("dst_id")).filter("src_id <> dst_id").distinct()
    return folded, moved
