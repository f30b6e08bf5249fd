"""The graph of parsed units: file, unit and external nodes, their edges, and summaries of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import module_name
from ..shared import settle

#: Edge kind -> (units that have it, column of references, kinds they may resolve to, whether the module is tried).
REFERENCES = {
    "IMPORTS": (["module", "section"], "imports", ["module"], False),
    "CALLS": (["function", "method"], "calls", ["function", "method"], True),
    "INHERITS": (["class"], "bases", ["class"], True),
}


def file_id(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), F.sha2(F.concat_ws("\0", repo, path), 256))


def resolver(units: DataFrame) -> DataFrame:
    """(repo_id, qualified_name, target, target_kind): of units that share a name, the last in file order."""
    last = F.max_by(F.struct(F.col("unit_id").alias("target"), F.col("kind").alias("target_kind")), F.struct("file_path", "line_start", "unit_id"))
    return units.groupBy("repo_id", "qualified_name").agg(last.alias("last")).select("repo_id", "qualified_name", "last.*")


def reference_edges(units: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """IMPORTS, CALLS and INHERITS: a name as it is, then within the module if it has no dot, else an external node.

    ``asking`` are the units whose references are wanted, all by default.
    """
    names, out = resolver(units), None
    for kind, (holders, column, kinds, local) in REFERENCES.items():
        known = names.filter(F.col("target_kind").isin(kinds))
        first = known.select("repo_id", F.col("qualified_name").alias("ref"), F.col("target").alias("direct"))
        second = known.select("repo_id", F.col("qualified_name").alias("near"), F.col("target").alias("within"))
        holding = (units if asking is None else asking).filter(F.col("kind").isin(holders))
        asked = holding.select("repo_id", "unit_id", module_name(F.col("file_path")).alias("module"), F.explode(column).alias("ref")).distinct()
        met = asked.join(first, ["repo_id", "ref"], "left")
        if local:
            near = F.when(~F.col("ref").contains("."), F.concat_ws(".", "module", "ref"))
            met = met.withColumn("near", near).join(second, ["repo_id", "near"], "left")
        else:
            met = met.withColumn("within", F.lit(None).cast("string"))
        dst = F.coalesce("direct", "within", F.concat(F.lit("external:"), "ref"))
        rows = met.select("repo_id", F.col("unit_id").alias("src_id"), F.lit(kind).alias("kind"), dst.alias("dst_id")).filter("src_id <> dst_id")
        out = rows if out is None else out.union(rows)
    return out


def structural_edges(units: DataFrame) -> DataFrame:
    """A file CONTAINS its units but the module; a parent of the same file DEFINES its children."""
    contains = units.filter("kind <> 'module'").select("repo_id", file_id(F.col("repo_id"), F.col("file_path")).alias("src_id"), F.lit("CONTAINS").alias("kind"), F.col("unit_id").alias("dst_id"))
    parents = units.select("repo_id", "file_path", F.col("qualified_name").alias("parent_qualified_name"), F.col("unit_id").alias("src_id"))
    defines = units.join(parents, ["repo_id", "file_path", "parent_qualified_name"]).select("repo_id", "src_id", F.lit("DEFINES").alias("kind"), F.col("unit_id").alias("dst_id"))
    return contains.union(defines)


def graph_edges(units: DataFrame) -> DataFrame:
    """(repo_id, src_id, kind, dst_id), distinct."""
    return structural_edges(units).union(reference_edges(units)).distinct()


def graph_nodes(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, kind, repo_id, qualified_name, name) of files, units and what edges name outside; one row a node."""
    leaf = lambda c, mark: F.element_at(F.split(c, mark), -1)
    files = units.select("repo_id", "file_path").distinct().select(file_id(F.col("repo_id"), F.col("file_path")).alias("node_id"), F.lit("File").alias("kind"), "repo_id", F.col("file_path").alias("qualified_name"), leaf(F.col("file_path"), "/").alias("name"))
    own = units.select(F.col("unit_id").alias("node_id"), F.initcap("kind").alias("kind"), "repo_id", "qualified_name", "name")
    qname = F.substring("node_id", 10, 2**31 - 1)
    outside = edges.filter(F.col("dst_id").startswith("external:")).groupBy(F.col("dst_id").alias("node_id")).agg(F.min("repo_id").alias("repo_id"))
    outside = outside.select("node_id", F.lit("External").alias("kind"), "repo_id", qname.alias("qualified_name"), leaf(qname, r"\.").alias("name"))
    return files.union(own).union(outside)


def module_of(units: DataFrame) -> DataFrame:
    """(repo_id, unit_id, module): up the parents, however many, to the first module.

    A parent that is no unit is taken for the module; without a module above, or with parents in a circle, it is
    the unit's own name. The names that are parents hold a pointer upwards each, which a round of self-joins doubles:
    rounds grow with the logarithm of the depth. Names still open after a round that closed none go in circles.
    """
    at = F.col("parent_qualified_name").alias("at")
    parents = units.select("repo_id", at).filter("at IS NOT NULL").distinct()
    up = units.select(F.col("unit_id").alias("target"), F.col("parent_qualified_name").alias("up"))
    known = resolver(units).withColumnRenamed("qualified_name", "at").join(up, "target")
    is_module = F.col("target_kind").isNull() | (F.col("target_kind") == "module")
    met = parents.join(known, ["repo_id", "at"], "left")
    ends = settle(met.select("repo_id", "at", F.when(is_module, F.col("at")).alias("module"), F.when(~is_module, F.col("up")).alias("next")), "parents")
    before, left = None, ends.filter("next IS NOT NULL").count()
    while left and left != before:
        above = ends.select("repo_id", F.col("at").alias("next"), F.col("module").alias("above"), F.col("next").alias("further"))
        module = F.when(F.col("next").isNull(), F.col("module")).otherwise(F.col("above"))
        ends = settle(ends.join(above, ["repo_id", "next"], "left").select("repo_id", "at", module.alias("module"), F.col("further").alias("next")), "parents")
        before, left = left, ends.filter("next IS NOT NULL").count()
    own = F.when((F.col("kind") != "module"), F.col("parent_qualified_name")).alias("at")
    found = F.when(F.col("at").isNotNull() & F.col("next").isNull(), F.col("module"))
    return units.select("repo_id", "unit_id", "qualified_name", own).join(ends, ["repo_id", "at"], "left").select("repo_id", "unit_id", F.coalesce(found, "qualified_name").alias("module"))


def _names(holds: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(holds, F.element_at(F.split("qualified_name", r"\."), -1))))


def module_summaries(units: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, module, cls, fn, const, imp, file): classes of all depths, direct functions and constants; modules without a unit of their own are left out."""
    direct = F.col("parent_qualified_name") == F.col("module")
    held = units.join(modules, ["repo_id", "unit_id"])
    own = F.col("kind") == "module"
    summed = held.groupBy("repo_id", "module").agg(
        _names(F.col("kind") == "class").alias("cls"), _names((F.col("kind") == "function") & direct).alias("fn"), _names((F.col("kind") == "constant") & direct).alias("const"),
        F.max(F.when(own, F.array_sort(F.array_distinct("imports")))).alias("imp"), F.max(F.when(own, F.col("file_path"))).alias("file"),
    )
    return summed.filter("file is not null")


def api_summaries(units: DataFrame) -> DataFrame:
    """(repo_id, module, api, cls, file): public direct functions and classes; modules with neither are left out."""
    modules = units.filter("kind = 'module'").select("repo_id", F.col("qualified_name").alias("parent_qualified_name"), F.col("file_path").alias("file"))
    public = units.filter(~F.col("name").startswith("_") & F.col("kind").isin("function", "class")).join(modules, ["repo_id", "parent_qualified_name"])
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return public.groupBy("repo_id", F.col("parent_qualified_name").alias("module")).agg(names("function").alias("api"), names("class").alias("cls"), F.max("file").alias("file"))


def memory_compaction(units: DataFrame, modules: DataFrame, scores: DataFrame, relevant: float = 0.3) -> DataFrame:
    """(repo_id, module, cls, fn, const, merged): modules with units of low score, those units' ids, and a summary of what stays."""
    scored = units.join(scores.select("unit_id", "score"), "unit_id", "left")
    victim = F.coalesce((F.col("score") < relevant) & ~F.col("kind").isin("module", "class"), F.lit(False))
    held = scored.withColumn("victim", victim).join(modules, ["repo_id", "unit_id"])
    merged = held.filter("victim").groupBy("repo_id", "module").agg(F.array_sort(F.collect_list("unit_id")).alias("merged"))
    summary = module_summaries(held.filter("not victim").drop("victim", "score", "module"), modules).select("repo_id", "module", "cls", "fn", "const")
    empty = F.array().cast("array<string>")
    return merged.join(summary, ["repo_id", "module"], "left").select("repo_id", "module", *[F.coalesce(c, empty).alias(c) for c in ("cls", "fn", "const")], "merged")
