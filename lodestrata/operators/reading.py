"""Units and files as callers read them: references to units, their parents, and files put together from units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import is_unit_id
from ..functions.text import cut_at_line
from .build import resolver

#: Fixed value: tokens that a response may hold.
MOST_TOKENS = 8000
FILE = ["repo_id", "file_path"]


def uncovered(units: DataFrame) -> DataFrame:
    """Of each file's units, by line and the widest first, those that reach past all lines before them."""
    before = Window.partitionBy(*FILE).orderBy("line_start", F.desc("line_end"), "qualified_name").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_covered", F.coalesce(F.max("line_end").over(before), F.lit(0))).filter("line_end > _covered").drop("_covered")


def _in_order(value: Column, *order: Column) -> Column:
    """The values of a group, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("value")))), lambda x: x["value"])


def stitched(units: DataFrame) -> DataFrame:
    """(repo_id, file_path, content): the source of files as their units hold it.

    A module unit from line 1 on is the whole file; else the units that no other covers stand one after another,
    with a blank line between and without their own line ends. A file's text is one value, so it is put together in one task.
    """
    whole = units.filter("kind = 'module' AND line_start = 1").groupBy(*FILE).agg(F.max_by("content", F.struct("line_end", "unit_id")).alias("whole"))
    parts = _in_order(F.rtrim(F.coalesce("content", F.lit("")), F.lit("\n")), F.col("line_start"), -F.col("line_end"), F.col("qualified_name"))
    joined = uncovered(units.join(whole, FILE, "left_anti")).groupBy(*FILE).agg(F.array_join(parts, "\n\n").alias("content"))
    return whole.withColumnRenamed("whole", "content").unionByName(joined)


def files(units: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(repo_id, file_path, language, content, truncated, outline): files cut at the last whole line of a budget; outline lists their units by line and name."""
    entry = F.struct("qualified_name", "kind", "line_start", "line_end")
    about = units.groupBy(*FILE).agg(F.min("language").alias("language"), _in_order(entry, F.col("line_start"), F.col("qualified_name")).alias("outline"))
    cut = cut_at_line(F.col("content"), most_tokens)
    held = stitched(units).select(*FILE, cut.alias("content"), (F.length("content") > 4 * most_tokens).alias("truncated"))
    return held.join(about, FILE).select(*FILE, "language", "content", "truncated", "outline")


def similar_paths(units: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """(repo_id, file_path, similar): for paths that a repository does not have, its first paths, in order, that hold their last part, whatever its case."""
    known = units.select(*FILE).distinct()
    lost = asked.select("repo_id", F.col("file_path").alias("asked")).distinct()
    lost = lost.join(known.withColumnRenamed("file_path", "asked"), ["repo_id", "asked"], "left_anti")
    leaf = F.lower(F.substring_index(F.replace("asked", F.lit("\\"), F.lit("/")), "/", -1))
    # Few paths are asked for at once; a repository's paths meet those asked of it alone.
    met = lost.withColumn("leaf", leaf).filter("leaf <> ''").join(known, "repo_id").filter(F.contains(F.lower("file_path"), F.col("leaf")))
    order = Window.partitionBy("repo_id", "asked").orderBy("file_path")
    first = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    found = first.groupBy("repo_id", "asked").agg(F.array_sort(F.collect_list("file_path")).alias("similar"))
    return lost.join(found, ["repo_id", "asked"], "left").select("repo_id", F.col("asked").alias("file_path"), F.coalesce("similar", F.array().cast("array<string>")).alias("similar"))


def resolved(units: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo_id, reference, unit_id): the unit that each reference means; no row where it means none.

    ``asked`` has reference and repo_id, null for any. A unit's id counts first; then, by repository in order, an
    exact name (of several the first by line and file), else, if it has a slash, a path: the module of the file,
    else its widest first unit.
    """
    own = asked.select(F.col("repo_id").alias("asked_repo"), "reference").distinct()
    here = F.col("asked_repo").isNull() | (F.col("asked_repo") == F.col("repo_id"))
    place = lambda *order: F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ids = own.filter(is_unit_id(F.col("reference"))).join(units.select(F.col("unit_id").alias("reference"), "repo_id"), "reference")
    found = ids.select("asked_repo", "reference", F.col("reference").alias("unit_id"), place(F.lit(0), F.lit(""), F.lit(0), F.lit("")).alias("place"))
    first = F.min(F.struct("line_start", "file_path", "unit_id")).alias("first")
    names = units.groupBy("repo_id", F.col("qualified_name").alias("reference")).agg(first)
    named = own.join(names, "reference").filter(here)
    found = found.union(named.select("asked_repo", "reference", "first.unit_id", place(F.lit(1), F.col("repo_id"), F.lit(1), F.lit(""))))
    slash = own.filter(F.contains("reference", F.lit("/")) | F.contains("reference", F.lit("\\")))
    best = F.min(F.struct((F.col("kind") != "module").alias("other"), "line_start", (-F.col("line_end")).alias("widest"), "unit_id")).alias("best")
    paths = units.groupBy("repo_id", F.col("file_path").alias("reference")).agg(best)
    pathed = slash.join(paths, "reference").filter(here)
    found = found.union(pathed.select("asked_repo", "reference", "best.unit_id", place(F.lit(1), F.col("repo_id"), F.lit(2), F.lit(""))))
    return found.groupBy(F.col("asked_repo").alias("repo_id"), "reference").agg(F.min_by("unit_id", "place").alias("unit_id"))


def parent_chains(units: DataFrame, wanted: DataFrame, hops: int = 5) -> DataFrame:
    """(unit_id, chain) of the wanted units: their parents in their repository, innermost first, at most ``hops``; one that is no unit is unknown and the last."""
    up = units.select(F.col("unit_id").alias("target"), F.col("parent_qualified_name").alias("up"))
    parents = units.select("repo_id", F.col("parent_qualified_name").alias("qualified_name")).distinct()
    known = resolver(units).join(parents, ["repo_id", "qualified_name"], "left_semi").join(up, "target")
    known = known.select("repo_id", F.col("qualified_name").alias("at"), "target_kind", "up")
    link = "array<struct<qualified_name:string,kind:string>>"
    here = units.join(wanted.select("unit_id").distinct(), "unit_id", "left_semi")
    here = here.select("repo_id", "unit_id", F.col("parent_qualified_name").alias("at"), F.array().cast(link).alias("chain"))
    for _ in range(hops):
        met = here.join(known, ["repo_id", "at"], "left")
        one = F.array(F.struct(F.col("at").alias("qualified_name"), F.coalesce("target_kind", F.lit("unknown")).alias("kind")))
        here = met.select("repo_id", "unit_id", F.col("up").alias("at"), F.when(F.col("at").isNull(), F.col("chain")).otherwise(F.concat("chain", one)).alias("chain"))
    return here.select("unit_id", "chain")
