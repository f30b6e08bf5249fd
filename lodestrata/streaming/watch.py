"""Watched files to an index that is kept up: units, edges and vectors of touched files alone.

A stream of changes (at, path, op, content) goes through these steps a batch: paths that mean nothing are left
out, each path goes to the repository of the longest root above it, of several changes to a file in the batch the
last counts (the debounce), what is left is parsed, and the files' rows are replaced in keyed tables, whose other
buckets are not written. References lead to units by name, so files that name something which a batch brought or
took away have their edges resolved anew too; they are found by the changed names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.embedding import embed
from ..functions.paths import is_relevant, module_name
from ..operators import build
from ..operators.navigation import longest_root
from ..shared import settle
from ..sources import parsers
from ..sources.ingest import embed_text, shaped
from ..sources.keyed import KeyedTable
from ..sources.repository import language

FILE = ["repo_id", "file_path"]
UNITS = "repo_id string, file_path string, unit_id string, kind string, name string, qualified_name string, parent_qualified_name string, line_start int, line_end int, docstring string, imports array<string>, calls array<string>, bases array<string>, content string, source_sha string"
EDGES = "repo_id string, file_path string, src_id string, kind string, dst_id string"
VECTORS = "repo_id string, file_path string, unit_id string, source_sha string, vector array<float>"


def touched(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, content): the files that changes leave, content null where they are gone."""
    relevant = changes.filter(is_relevant(F.col("path")))
    last = relevant.groupBy("path").agg(F.max_by(F.struct("op", "content"), F.struct("at", "op")).alias("last"))
    owned = last.join(longest_root(last.select("path"), roots.select("root", "repo_id")), "path").join(roots, "repo_id")
    path = F.ltrim(F.col("path").substr(F.length("root") + 1, F.length("path")), F.lit("/"))
    held = owned.select("repo_id", path.alias("file_path"), F.when(F.col("last.op") != "removed", F.col("last.content")).alias("content"))
    return held.withColumn("language", language(F.col("file_path"))).filter("language IS NOT NULL")


@dataclass
class Index:
    """Units, edges and vectors below ``place``, with the repositories' ``roots`` (root, repo_id); one root a repository."""

    spark: SparkSession
    place: str
    roots: DataFrame
    dim: int = 16
    buckets: int = 64
    units: KeyedTable = field(init=False)
    edges: KeyedTable = field(init=False)
    vectors: KeyedTable = field(init=False)

    def __post_init__(self) -> None:
        for name, schema in (("units", UNITS), ("edges", EDGES), ("vectors", VECTORS)):
            setattr(self, name, KeyedTable(self.spark, f"{self.place}/{name}", StructType.fromDDL(schema), FILE, self.buckets))

    def write(self, changes: DataFrame, number: int) -> None:
        """Takes a batch in; one that comes again starts from what was there before it."""
        files = settle(touched(changes, self.roots), "files")
        keys = files.select(*FILE)
        sources = files.filter("content IS NOT NULL").withColumnRenamed("file_path", "path")
        parsed, failed = parsers.units(sources)
        units = settle(shaped(parsed, sources).select(self.units.schema.fieldNames()), "units")
        # A file that does not parse keeps the units it had.
        keys = settle(keys.join(failed.select("repo_id", F.col("path").alias("file_path")), FILE, "left_anti"), "keys")
        before = self.units.read(before=number)
        gone = before.join(keys, FILE, "left_semi")
        self._write_vectors(keys, units, number)
        self.units.replace(keys, units, number)
        self._write_edges(keys, gone, units, number)

    def _write_vectors(self, keys: DataFrame, units: DataFrame, number: int) -> None:
        """Units of an unchanged digest keep their vector."""
        old = self.vectors.read(before=number).join(keys, FILE, "left_semi").select("unit_id", "source_sha", "vector")
        own = units.filter("trim(content) <> ''").join(old, ["unit_id", "source_sha"], "left")
        kept = own.filter("vector IS NOT NULL").select(self.vectors.schema.fieldNames())
        fresh = own.filter("vector IS NULL").withColumn("vector", embed(embed_text(), self.dim)).select(self.vectors.schema.fieldNames())
        self.vectors.replace(keys, kept.unionByName(fresh), number)

    def _write_edges(self, keys: DataFrame, gone: DataFrame, units: DataFrame, number: int) -> None:
        named = lambda df: df.select("repo_id", "qualified_name", "unit_id", "kind")
        changed = named(gone).exceptAll(named(units)).union(named(units).exceptAll(named(gone))).select("repo_id", "qualified_name").distinct()
        every = self.units.read(before=number + 1)
        refs = every.select(*FILE, F.explode(F.concat("imports", "calls", "bases")).alias("ref"))
        near = F.concat_ws(".", module_name(F.col("file_path")), "ref")  # a name without a dot is looked for in its module too
        asked = refs.select(*FILE, F.explode(F.array("ref", near)).alias("qualified_name"))
        affected = settle(asked.join(changed, ["repo_id", "qualified_name"], "left_semi").select(*FILE).union(keys).distinct(), "affected")
        asking = every.join(affected, FILE, "left_semi")
        found = build.structural_edges(asking).union(build.reference_edges(every, asking)).distinct()
        holders = asking.select("unit_id", "file_path").union(asking.select(build.file_id(F.col("repo_id"), F.col("file_path")), "file_path").distinct())
        rows = found.join(holders.withColumnRenamed("unit_id", "src_id"), "src_id").select(self.edges.schema.fieldNames())
        self.edges.replace(affected, rows, number)
