"""What callers can ask, as methods over the model tables: each checks its arguments and gives a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import cut_at_line
from .operators import graph, navigation, overview, reading, search

#: The ranges that requests may use.
MOST = {"top_k": 200, "limit": 100, "depth": 5, "nodes": 20_000}


def within(name: str, value: int) -> int:
    if not 1 <= value <= MOST[name]:
        raise ValueError(f"{name} must be from 1 to {MOST[name]}")
    return value


def request_faults(fields: list[str]) -> Column:
    """The fields of a row of requests that are null, empty or out of their range, joined by commas."""
    wrong = [F.when(~F.coalesce(F.col(f).between(1, MOST[f]) if f in MOST else F.length(F.trim(f)) > 0, F.lit(False)), f) for f in fields]
    return F.concat_ws(",", *wrong)


@dataclass(frozen=True)
class Tools:
    units: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None

    def search_code(self, text: str, repo_id: str | None = None, top_k: int = 50, vector: list[float] | None = None) -> DataFrame:
        """Ranked units for a question, with their rows; no graph channel, as there are no seeds."""
        own = self.units.filter(F.col("repo_id") == repo_id) if repo_id else self.units
        k = within("top_k", top_k)
        keyword = search.keyword_top_k(own, text, k).select("unit_id")
        empty = keyword.limit(0)
        near = search.cosine_top_k(self.vectors, vector, k).select("unit_id", "score") if vector and self.vectors is not None else empty.withColumn("score", F.lit(0.0))
        fused = search.fuse(near, empty.withColumn("depth", F.lit(0)), keyword)
        return search.rank(fused, k).join(own.select("unit_id", "repo_id", "qualified_name", "file_path", "kind"), "unit_id", "left")

    def find_symbol(self, text: str, limit: int = 20) -> DataFrame:
        return search.find_symbol(self.units, text, within("limit", limit))

    def read_unit(self, reference: str, repo_id: str | None = None) -> DataFrame:
        """The unit that a reference means (id, exact name, else path) in a repository or in any, its text within the budget, and its parents."""
        asked = self._one("reference string, repo_id string", reference, repo_id)
        found = reading.resolved(self.units, asked).select("unit_id")
        content = cut_at_line(F.col("content"), reading.MOST_TOKENS).alias("content")
        own = self.units.join(found, "unit_id", "left_semi").withColumn("truncated", F.length("content") > 4 * reading.MOST_TOKENS)
        own = own.select(*[c for c in own.columns if c != "content"], content)
        return own.join(reading.parent_chains(self.units, found), "unit_id").withColumnRenamed("chain", "parent_chain")

    def read_file(self, repo_id: str, path: str) -> DataFrame:
        """A file put together from its units, within the budget, with its outline; no row if the repository has no such path."""
        return reading.files(self.units.filter((F.col("repo_id") == repo_id) & (F.col("file_path") == path)))

    def similar_paths(self, repo_id: str, path: str) -> DataFrame:
        """The nearest paths to one that a repository does not have."""
        asked = self._one("repo_id string, file_path string", repo_id, path)
        return reading.similar_paths(self.units.filter(F.col("repo_id") == repo_id), asked)

    def _one(self, schema: str, *values: str | None) -> DataFrame:
        return self.units.sparkSession.createDataFrame([values], schema)

    def suggest(self, name: str) -> DataFrame:
        return navigation.suggestions(self.units, [name])

    def explore(self, qualified_name: str, direction: str = "all", depth: int = 1) -> DataFrame:
        """The nearest nodes that a direction leads to: distance, relation, their rows, and whether there were more."""
        if direction not in graph.DIRECTIONS:
            raise ValueError(f"direction must be one of {sorted(graph.DIRECTIONS)}")
        start = self.nodes.filter(F.col("qualified_name") == qualified_name).select("node_id")
        kept = graph.nearest(graph.explore(self.edges, start, direction, within("depth", depth)))
        return kept.join(self.nodes, "node_id").orderBy("distance", "qualified_name")

    def explore_edges(self, qualified_name: str, direction: str = "all", depth: int = 1) -> DataFrame:
        """The edges among what ``explore`` keeps and its start."""
        start = self.nodes.filter(F.col("qualified_name") == qualified_name).select("node_id")
        kept = graph.nearest(graph.explore(self.edges, start, direction, within("depth", depth)))
        return graph.explored_edges(self.edges, start, kept)

    def parents(self, unit_id: str) -> DataFrame:
        """A unit's parents, innermost first."""
        return navigation.parent_chain(self.units.filter(F.col("unit_id") == unit_id), self.units).orderBy("hop")

    def risks(self, qualified_name: str) -> DataFrame:
        """External nodes one step away."""
        start = self.nodes.filter(F.col("qualified_name") == qualified_name).select("node_id")
        outside = self.nodes.filter("kind = 'External'")
        return graph.neighbours(self.edges, start, 1).join(outside, "node_id").orderBy("node_id")

    def repo_graph(self, repo_id: str, most: int = 5000) -> DataFrame:
        """The edges among a repository's first nodes."""
        ids = self.nodes.filter((F.col("repo_id") == repo_id) & (F.col("kind") != "External")).select("node_id").orderBy("node_id").limit(within("nodes", most))
        return self.edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select("src_id", "kind", "dst_id").distinct()

    def module_summary(self, module: str) -> DataFrame:
        """Units of a module and of all below it, by kind; ``_`` in the name matches any character, as in LIKE."""
        held = self.units.filter((F.col("qualified_name") == module) | F.col("qualified_name").like(f"{module}.%"))
        return held.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file_path")).alias("files"))

    def get_module_summary(self, module: str, repo_id: str) -> DataFrame:
        """Names of a module's classes, functions and constants, its imports and file, and how many units its name begins."""
        inside = (F.col("qualified_name") == module) | F.col("qualified_name").startswith(f"{module}.")
        return overview.module_summary(self.units.filter((F.col("repo_id") == repo_id) & inside)).filter(F.col("module") == module)

    def repo_overview(self, repo_id: str) -> DataFrame:
        """(repo_id, section, place, name, n) of one repository, as ``overview.overview`` has it for all."""
        own = self.units.filter(F.col("repo_id") == repo_id)
        ids = own.select("unit_id")
        among = self.edges.join(ids.withColumnRenamed("unit_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("unit_id", "dst_id"), "dst_id", "left_semi")
        return overview.overview(own, among)


#: What callers may ask by name, each with its method's arguments.
REGISTERED = ["search_code", "find_symbol", "read_unit", "read_file", "similar_paths", "suggest", "explore", "explore_edges", "parents", "risks", "repo_graph", "module_summary", "get_module_summary", "repo_overview"]


def registry() -> dict[str, list[str]]:
    """Each tool's arguments in order."""
    return {name: [p for p in signature(getattr(Tools, name)).parameters if p != "self"] for name in sorted(REGISTERED)}


def call(tools: Tools, name: str, /, **arguments: object) -> DataFrame:
    """Runs a tool by name; an unknown tool or argument is an error that says which there are."""
    known = registry()
    if name not in known:
        raise ValueError(f"unknown tool {name}; there are {', '.join(known)}")
    if extra := sorted(set(arguments) - set(known[name])):
        raise ValueError(f"{name} does not take {', '.join(extra)}; it takes {', '.join(known[name])}")
    return getattr(tools, name)(**arguments)
