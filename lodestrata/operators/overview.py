"""What a caller gets of a repository at first sight, for all repositories at once, and summaries of all modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_doc
from . import build
from .graph import degrees

#: Entries of a list of largest or most connected.
MOST = 10


def _first(rows: DataFrame, section: str, n: Column, most: int | None = MOST) -> DataFrame:
    """(repo_id, section, place, name, n) of the largest by ``n``, then by name; Spark cuts each task's rows before they meet."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("n"), "name")
    placed = rows.select("repo_id", F.lit(section).alias("section"), "name", n.cast("long").alias("n"))
    placed = placed.withColumn("place", F.row_number().over(order).cast("long"))
    return (placed.filter(F.col("place") <= most) if most else placed).select("repo_id", "section", "place", "name", "n")


def _counted(rows: DataFrame, section: str, name: Column) -> DataFrame:
    """The same of groups, in order of their names."""
    counts = rows.groupBy("repo_id", name.alias("name")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("name")).cast("long")
    return counts.select("repo_id", F.lit(section).alias("section"), place.alias("place"), "name", "n")


def module_sizes(units: DataFrame) -> DataFrame:
    """(repo_id, name, n, file_path): modules with the units whose names they begin, themselves included."""
    modules = units.filter("kind = 'module'").groupBy("repo_id", F.col("qualified_name").alias("name")).agg(F.min("file_path").alias("file_path"))
    parts = F.split("qualified_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    named = units.select("repo_id", F.explode(prefixes).alias("name"))
    counts = named.groupBy("repo_id", "name").agg(F.count("*").alias("n"))
    return modules.join(counts, ["repo_id", "name"])


def overview(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, section, place, name, n): units and files, languages, kinds, first parts of names with their units, largest and most connected modules, documents.

    ``edges`` has src_id, kind and dst_id between units; what leads to other nodes does not count for an end that is none.
    """
    totals = units.groupBy("repo_id").agg(F.count("*").alias("units"), F.countDistinct("file_path").alias("files"))
    entry = F.explode(F.array(F.struct(F.lit("files").alias("name"), F.col("files").alias("n")), F.struct(F.lit("units").alias("name"), F.col("units").alias("n")))).alias("e")
    rows = totals.select("repo_id", entry).select("repo_id", F.lit("totals").alias("section"), F.when(F.col("e.name") == "files", 1).otherwise(2).cast("long").alias("place"), "e.name", "e.n")
    rows = rows.union(_counted(units, "language", F.col("language"))).union(_counted(units, "kind", F.col("kind")))
    top = units.groupBy("repo_id", F.split_part("qualified_name", F.lit("."), F.lit(1)).alias("name")).agg(F.count("*").alias("n"))
    rows = rows.union(_first(top, "tree", F.col("n"), None))
    rows = rows.union(_first(module_sizes(units), "largest", F.col("n")))
    docs = units.filter(is_doc(F.col("file_path")))
    rows = rows.union(_counted(docs, "document", F.col("file_path")))
    own = units.select("repo_id", F.col("unit_id").alias("node_id"), F.col("qualified_name").alias("name"))
    met = degrees(edges).join(own, "node_id")
    return rows.union(_first(met, "connected", F.col("degree")))


def module_summary(units: DataFrame) -> DataFrame:
    """(repo_id, module, cls, fn, const, imp, file, unit_count): a row a module that has a unit of its own; the count takes in all whose names it begins."""
    sizes = module_sizes(units).select("repo_id", F.col("name").alias("module"), F.col("n").alias("unit_count"))
    return build.module_summaries(units, build.module_of(units)).join(sizes, ["repo_id", "module"])
