"""A repository's files to units, graph and vectors, against what is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..functions.paths import one_line
from ..operators import build, overloads
from ..shared import settle
from . import parsers, store

STORED = "unit_id string, repo_id string, file_path string, source_sha string"


@dataclass(frozen=True)
class Ingested:
    """What a run finds: tables, and the rows to write to each store."""

    files: DataFrame
    failed: DataFrame
    units: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame

    def counted(self) -> DataFrame:
        """The counters as one row, each from its table."""
        ends = [self.nodes.select(F.col("node_id").alias(f"{end}_id")) for end in ("src", "dst")]
        written = self.edges.join(ends[0], "src_id", "left_semi").join(ends[1], "dst_id", "left_semi")
        tables = {
            "files_walked": self.files,
            "files_failed": self.failed,
            "units_emitted": self.units,
            "units_changed": self.units.filter("changed"),
            "nodes_written": self.nodes,
            "edges_written": written,
            "vector_payloads_written": self.units,
            "units_embedded": self.vectors,
        }
        rows = None
        for name, table in tables.items():
            row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
            rows = row if rows is None else rows.union(row)
        one = rows.agg(*[F.max(F.when(F.col("counter") == name, F.col("n"))).alias(name) for name in tables])
        return one.withColumn("files_parsed", F.col("files_walked") - F.col("files_failed"))

    def counters(self) -> dict[str, int]:
        return self.counted().first().asDict()


def shaped(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed units with their lines as content, their digest and id; units of one name in a file are told apart by ``overloads.renamed``."""
    lines = files.select("repo_id", "path", F.split("content", "\n").alias("lines"))
    count = F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))
    own = F.array_join(F.slice("lines", F.greatest("line_start", F.lit(1)), count), "\n")
    held = parsed.join(lines, ["repo_id", "path"]).withColumn("content", own).drop("lines")
    held = held.withColumnsRenamed({"path": "file_path", "parent": "parent_qualified_name"}).withColumn("source_sha", F.sha2("content", 256))
    # Units of the same lines keep an order of their own, whatever order they are read in.
    place = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("line_start", F.desc("line_end"), "qualified_name", "kind"))
    return overloads.renamed(held.withColumn("place", place)).drop("place")


def embed_text() -> Column:
    """What is embedded of a unit: name and kind, its signature (here the first line that is not blank), and the first chunk."""
    return F.concat("qualified_name", F.lit(" ("), "kind", F.lit(")\n"), F.coalesce(one_line(F.col("content")), F.lit("")), F.lit("\n"), F.substring("content", 1, 1600))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, failed files) of ``files``, which are parsed once."""
    found, failed = parsers.units(files, "parsed")
    return settle(shaped(found, files), "units"), failed


def ingest(files: DataFrame, stored: DataFrame | None = None, dim: int = 64, parsed: tuple[DataFrame, DataFrame] | None = None) -> Ingested:
    """``files`` has repo_id, path, language and content; ``stored`` the units written before (STORED); ``parsed`` what ``read`` gave for the files, if they were read before."""
    units, failed = read(files) if parsed is None else parsed
    before = stored if stored is not None else files.sparkSession.createDataFrame([], STORED)
    units = settle(store.changed(before, units), "units")
    edges = settle(build.graph_edges(units), "edges")
    vectors = units.filter("changed and trim(content) <> ''").select("unit_id", "repo_id", embed(embed_text(), dim).alias("vector"))
    return Ingested(files, failed, units, build.graph_nodes(units, edges), edges, vectors)


def reindex(vectors: DataFrame, units: DataFrame, repo_id: str, dim: int = 64) -> DataFrame:
    """The vectors after a repository's units are embedded anew: its rows are replaced, units without text have none, others' stay."""
    own = units.filter(F.col("repo_id") == repo_id)
    text = F.concat("qualified_name", F.lit(" ("), "kind", F.lit(")\n"), F.substring("content", 1, 1600))
    fresh = own.filter("trim(content) <> ''").select("unit_id", "repo_id", embed(text, dim).alias("vector"))
    return vectors.filter(F.col("repo_id") != repo_id).select("unit_id", "repo_id", "vector").union(fresh)
