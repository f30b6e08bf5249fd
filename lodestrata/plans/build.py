"""Queries over source units: their graph, what a re-ingest writes, exploration, summaries and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions.identity import unit_id
from ..operators import build, graph
from ..shared import settle
from ..sources import store
from ..tables import code_units, edges, nodes
from .views import sql


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, nodes, edges) of the whole build; edges are written once, as nodes are read from them."""
    units = code_units(spark, sf_dir)
    found = settle(build.graph_edges(units), "edges")
    return units, build.graph_nodes(units, found), found


@query(sql("SELECT src_id, kind, dst_id FROM built_edges", "built_edges"))
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS, DEFINES, IMPORTS, CALLS and INHERITS of all units, references resolved by name."""
    return build.graph_edges(code_units(spark, sf_dir)).select("src_id", "kind", "dst_id").distinct()


@query(sql("SELECT node_id, kind, repo_id, qualified_name, name FROM built_nodes", "built_nodes"))
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query(sql("SELECT c.repo_id, count(*)::BIGINT AS n_calls, count(*) FILTER (starts_with(dst_id, 'external:'))::BIGINT AS n_external FROM built_edges e JOIN code c ON c.unit_id = e.src_id WHERE e.kind = 'CALLS' GROUP BY 1", "built_edges"))
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each repository, and those that lead outside."""
    calls = build.reference_edges(code_units(spark, sf_dir)).filter("kind = 'CALLS'").distinct()
    return calls.groupBy("repo_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("dst_id").startswith("external:")).alias("n_external"))


# Re-ingest


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, new, failed files): what was stored, what is parsed now, and files that could not be parsed."""
    units = code_units(spark, sf_dir)
    file = F.floor(F.col("doc_id") / 12)
    failed = units.filter(file % 17 == 5).select("repo_id", "file_path").distinct()
    good = units.filter(file % 17 != 5)
    old = good.filter("doc_id % 9 <> 3").withColumn("source_sha", F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("source_sha")))
    return old, good.filter("doc_id % 50 <> 8"), failed


STATES = """good AS (SELECT * FROM code WHERE k % 17 <> 5), old AS (SELECT unit_id, repo_id, file_path, CASE WHEN doc_id % 4 = 0 THEN sha256(content || 'x') ELSE source_sha END AS sha FROM good WHERE doc_id % 9 <> 3),
  fresh AS (SELECT * FROM good WHERE doc_id % 50 <> 8), lost AS (SELECT DISTINCT repo_id, file_path FROM old WHERE unit_id NOT IN (SELECT unit_id FROM fresh)),
  changes AS (SELECT f.unit_id, f.repo_id, l.file_path IS NOT NULL OR o.sha IS NULL OR o.sha <> f.source_sha AS changed FROM fresh f LEFT JOIN old o USING (unit_id) LEFT JOIN lost l ON l.repo_id = f.repo_id AND l.file_path = f.file_path)"""


@query(sql(STATES + " SELECT unit_id, changed FROM changes", "code"))
def changed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a re-ingest embeds anew: new or altered ones, and all of a file that lost one."""
    old, new, _ = _states(spark, sf_dir)
    return store.changed(old, new).select("unit_id", "changed")


@query(
    sql(STATES + """, o AS (SELECT g.*, old.sha FROM good g JOIN old USING (unit_id)) SELECT coalesce(o.unit_id, f.unit_id) AS unit_id, CASE WHEN o.unit_id IS NULL THEN 'inserted' WHEN f.unit_id IS NULL THEN 'obsolete' WHEN o.sha <> f.source_sha THEN 'updated' ELSE 'unchanged' END AS state,
        CASE WHEN o.unit_id IS NULL THEN 200 ELSE 100 END::BIGINT AS created_at, CASE WHEN o.unit_id IS NULL OR (f.unit_id IS NOT NULL AND o.sha <> f.source_sha) THEN 200 ELSE 100 END::BIGINT AS updated_at,
        (coalesce(o.line_start, f.line_start) + CASE WHEN o.unit_id IS NULL OR (f.unit_id IS NOT NULL AND o.sha <> f.source_sha) THEN 1 ELSE 0 END)::BIGINT AS line_start FROM o FULL JOIN fresh f ON f.unit_id = o.unit_id""", "code")
)
def upserted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units table after a write: rows of an equal digest stay whole, with their old lines; the rest keep when they were made."""
    old, new, _ = _states(spark, sf_dir)
    at = lambda df, t, lines: df.select("unit_id", "source_sha", (F.col("line_start") + lines).alias("line_start"), F.lit(t).cast("long").alias("created_at"), F.lit(t).cast("long").alias("updated_at"))
    return store.reconcile(at(old, 100, 0), at(new, 200, 1), "unit_id", "source_sha").select("unit_id", "state", "created_at", "updated_at", "line_start")


@query(
    sql(STATES + """ SELECT count(DISTINCT (repo_id, file_path))::BIGINT AS files_walked, count(DISTINCT (repo_id, file_path)) FILTER (k % 17 <> 5)::BIGINT AS files_parsed, count(DISTINCT (repo_id, file_path)) FILTER (k % 17 = 5)::BIGINT AS files_failed,
        (SELECT count(*) FROM fresh)::BIGINT AS units_emitted, (SELECT count(*) FROM changes WHERE changed)::BIGINT AS units_changed,
        (SELECT count(*) FROM fresh)::BIGINT AS vector_payloads_written, (SELECT count(*) FROM changes c JOIN fresh f USING (unit_id) WHERE changed AND trim(content) <> '')::BIGINT AS units_embedded FROM code""", "code")
)
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all files walks, parses, changes and embeds."""
    units = code_units(spark, sf_dir)
    old, new, failed = _states(spark, sf_dir)
    changes = store.changed(old, new)
    files = lambda df: df.select("repo_id", "file_path").distinct().agg(F.count("*").alias("n"))
    counted = [
        ("files_walked", files(units)), ("files_parsed", files(units.join(failed, ["repo_id", "file_path"], "left_anti"))), ("files_failed", files(failed)), ("units_emitted", new.agg(F.count("*").alias("n"))),
        ("units_changed", changes.filter("changed").agg(F.count("*").alias("n"))), ("vector_payloads_written", new.agg(F.count("*").alias("n"))), ("units_embedded", changes.filter("changed and trim(content) <> ''").agg(F.count("*").alias("n"))),
    ]
    rows = None
    for name, df in counted:
        row = df.select(F.lit(name).alias("counter"), "n")
        rows = row if rows is None else rows.union(row)
    return rows.agg(*[F.max(F.when(F.col("counter") == name, F.col("n"))).alias(name) for name, _ in counted])


@query(sql("SELECT unit_id, file_path, line_start, qualified_name FROM code WHERE repo_id = 'fr'", "code"))
def repo_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository's units in order of file, line and name."""
    return code_units(spark, sf_dir).filter("repo_id = 'fr'").select("unit_id", "file_path", "line_start", "qualified_name").orderBy("file_path", "line_start", "qualified_name")


# Summaries


@query(sql("SELECT repo_id, unit_id, module FROM module_of", "module_of"))
def module_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's module, up its parents."""
    return build.module_of(code_units(spark, sf_dir))


def _text(*names: str) -> list:
    return [F.array_join(c, ",").alias(c) for c in names]


LEAF = "split_part(qualified_name, '.', -1)"
LISTED = "array_to_string(list_sort(coalesce(list(DISTINCT {what}) FILTER ({holds}), [])), ',')"
SUMMED = ", ".join(LISTED.format(what=LEAF, holds=h) + f" AS {c}" for c, h in (("cls", "kind = 'class'"), ("fn", "kind = 'function' AND parent_qualified_name = module"), ("const", "kind = 'constant' AND parent_qualified_name = module")))


@query(sql(f"SELECT repo_id, module, {SUMMED}, max(array_to_string(list_sort(list_distinct(imports)), ',')) FILTER (kind = 'module') AS imp, max(file_path) FILTER (kind = 'module') AS file FROM code JOIN module_of USING (repo_id, unit_id) GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'module') > 0", "module_of"))
def module_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each module's classes at all depths, direct functions and constants, imports and file."""
    units = code_units(spark, sf_dir)
    return build.module_summaries(units, build.module_of(units)).select("repo_id", "module", *_text("cls", "fn", "const", "imp"), "file")


@query(sql("SELECT c.repo_id, m.qualified_name AS module, " + ", ".join(LISTED.format(what="c.name", holds=f"c.kind = '{k}'") + f" AS {a}" for a, k in (("api", "function"), ("cls", "class"))) + ", max(m.file_path) AS file FROM code c JOIN code m ON m.kind = 'module' AND m.repo_id = c.repo_id AND m.qualified_name = c.parent_qualified_name WHERE c.kind IN ('function', 'class') AND NOT starts_with(c.name, '_') GROUP BY 1, 2", "code"))
def api_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of public functions and classes of each module."""
    return build.api_summaries(code_units(spark, sf_dir)).select("repo_id", "module", *_text("api", "cls"), "file")


SCORE = "CASE WHEN doc_id % 10 <> 9 THEN (doc_id * 37 % 100) / 100.0 END"


@query(
    sql(f"""s AS (SELECT *, coalesce({SCORE} < 0.3, false) AND kind NOT IN ('module', 'class') AS victim FROM code JOIN module_of USING (repo_id, unit_id)),
      stay AS (SELECT repo_id, module, {SUMMED} FROM s WHERE NOT victim GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'module') > 0), gone AS (SELECT repo_id, module, array_to_string(list_sort(list(unit_id)), ',') AS merged FROM s WHERE victim GROUP BY 1, 2)
      SELECT repo_id, module, coalesce(cls, '') AS cls, coalesce(fn, '') AS fn, coalesce(const, '') AS const, merged FROM gone LEFT JOIN stay USING (repo_id, module)""", "module_of")
)
def memory_compaction_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that lose units of low score: which, and a summary of those that stay. Units without a score stay."""
    units = code_units(spark, sf_dir)
    scores = units.select("unit_id", F.when(F.col("doc_id") % 10 != 9, F.col("doc_id") * 37 % 100 / 100.0).alias("score")).filter("score is not null")
    return build.memory_compaction(units, build.module_of(units), scores).select("repo_id", "module", *_text("cls", "fn", "const", "merged"))


@query(
    sql("""m AS (SELECT DISTINCT repo_id, split_part(qualified_name, '.', 1) AS top, qualified_name FROM code WHERE kind = 'module' AND len(string_split(qualified_name, '.')) <= 2),
      t AS (SELECT repo_id, split_part(qualified_name, '.', 1) AS top, count(*)::BIGINT AS n_units FROM code GROUP BY 1, 2)
      SELECT t.repo_id, t.top, n_units, count(m.top)::BIGINT AS n_modules, md5(array_to_string(list_sort(coalesce(list(qualified_name) FILTER (qualified_name IS NOT NULL), [])), ',')) AS modules FROM t LEFT JOIN m ON m.repo_id = t.repo_id AND m.top = t.top GROUP BY ALL""", "code")
)
def module_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parts of names, their units and their modules of at most two parts; most units first, then by name."""
    top = F.split_part("qualified_name", F.lit("."), F.lit(1))
    shallow = (F.col("kind") == "module") & (F.size(F.split("qualified_name", r"\.")) <= 2)
    held = F.array_sort(F.collect_set(F.when(shallow, F.col("qualified_name"))))
    found = code_units(spark, sf_dir).groupBy("repo_id", top.alias("top")).agg(F.count("*").alias("n_units"), held.alias("held"))
    return found.select("repo_id", "top", "n_units", F.size("held").cast("long").alias("n_modules"), F.md5(F.array_join("held", ",")).alias("modules")).orderBy(F.desc("n_units"), "top")


# Exploration and validation

SEED = "customer:1"
EXPLORED = f"""adj AS (SELECT src_id AS here, dst_id AS there, kind || '|out' AS how FROM edges UNION ALL SELECT dst_id, src_id, kind || '|in' FROM edges),
  l1 AS (SELECT there AS node, min(how) AS how FROM adj WHERE here = '{SEED}' AND there <> '{SEED}' GROUP BY 1),
  l2 AS (SELECT there AS node, min(l1.node || chr(0) || adj.how) AS how FROM l1 JOIN adj ON here = l1.node WHERE there <> '{SEED}' AND there NOT IN (SELECT node FROM l1) GROUP BY 1),
  found AS (SELECT node, 1::BIGINT AS distance, how FROM l1 UNION ALL SELECT node, 2, split_part(how, chr(0), 2) FROM l2),
  kept AS (SELECT node AS node_id, distance, split_part(how, '|', 1) || CASE WHEN ends_with(how, 'out') THEN ' ->' ELSE ' <-' END AS relation, (SELECT count(*) > 50 FROM found) AS truncated FROM found ORDER BY distance, node LIMIT 50)"""


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter(F.col("node_id") == SEED).select("node_id")


@query(sql(EXPLORED + " SELECT k.*, n.kind, n.qualified_name FROM kept k JOIN nodes n USING (node_id)", "nodes", "edges"))
def explore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's surroundings two steps out: distance, the edge that met each first, and its row; the nearest fifty."""
    reached = graph.explore(edges(spark, sf_dir), _seed(spark, sf_dir), "all", 2)
    return graph.nearest(reached).join(nodes(spark, sf_dir).select("node_id", "kind", "qualified_name"), "node_id")


@query(sql(EXPLORED + f", ids AS (SELECT node_id FROM kept UNION ALL SELECT '{SEED}'), e AS (SELECT DISTINCT src_id, kind, dst_id FROM edges WHERE src_id IN (SELECT node_id FROM ids) AND dst_id IN (SELECT node_id FROM ids)) SELECT *, (SELECT count(*) > 200 FROM e) AS truncated FROM e ORDER BY src_id, kind, dst_id LIMIT 200", "edges"))
def explore_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among what ``explore_all`` keeps and its seed."""
    e, seed = edges(spark, sf_dir), _seed(spark, sf_dir)
    return graph.explored_edges(e, seed, graph.nearest(graph.explore(e, seed, "all", 2)))


FAULTS = """n AS (SELECT b.node_id, b.kind FROM built_nodes b LEFT JOIN code c ON c.unit_id = b.node_id WHERE c.doc_id IS NULL OR c.doc_id % 29 <> 7),
  e AS (SELECT * FROM built_edges UNION ALL SELECT unit_id, 'CALLS', unit_id FROM code WHERE doc_id % 31 = 3 UNION ALL SELECT 'file:' || sha256(repo_id || chr(0) || file_path), 'DEFINES', unit_id FROM code WHERE doc_id % 37 = 1),
  issues AS (SELECT CASE WHEN a.node_id IS NULL OR b.node_id IS NULL THEN 'orphan' WHEN e.src_id = e.dst_id THEN 'self_edge' WHEN e.kind = 'DEFINES' AND a.kind = 'File' THEN 'edge_rule' END AS issue FROM e LEFT JOIN n a ON a.node_id = e.src_id LEFT JOIN n b ON b.node_id = e.dst_id
    UNION ALL SELECT 'id_mismatch' FROM n JOIN code c ON c.unit_id = n.node_id WHERE c.doc_id % 41 = 2)"""


@query(sql(FAULTS + " SELECT issue, count(*)::BIGINT AS n FROM issues WHERE issue IS NOT NULL GROUP BY 1", "built_nodes"))
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build with lost nodes, loops, unlawful edges and moved units: its violations by kind."""
    units, all_nodes, found = _graph(spark, sf_dir)
    lost = units.filter("doc_id % 29 = 7").select(F.col("unit_id").alias("node_id"))
    n = all_nodes.join(lost, "node_id", "left_anti")
    loops = units.filter("doc_id % 31 = 3").select(F.col("unit_id").alias("src_id"), F.lit("CALLS").alias("kind"), F.col("unit_id").alias("dst_id"))
    wrong = units.filter("doc_id % 37 = 1").select(build.file_id(F.col("repo_id"), F.col("file_path")).alias("src_id"), F.lit("DEFINES").alias("kind"), F.col("unit_id").alias("dst_id"))
    e = found.select("src_id", "kind", "dst_id").union(loops).union(wrong)
    moved = F.when(F.col("doc_id") % 41 == 2, F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path"))
    now = units.select(F.col("unit_id").alias("node_id"), unit_id(F.col("repo_id"), moved, F.col("qualified_name")).alias("unit_id"))
    return graph.validate(e, n).select("issue").union(graph.id_mismatches(n, now).select("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(sql("ids AS (SELECT unit_id AS node_id FROM code WHERE repo_id = 'en' ORDER BY 1 LIMIT 500), e AS (SELECT DISTINCT src_id, kind, dst_id FROM built_edges WHERE src_id IN (SELECT node_id FROM ids) AND dst_id IN (SELECT node_id FROM ids)) SELECT *, (SELECT count(*) >= 500 FROM ids) AS truncated FROM e", "built_edges"))
def source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's first 500 units in order of id, the edges among them, and whether there may be more."""
    units, _, found = _graph(spark, sf_dir)
    ids = units.filter("repo_id = 'en'").select(F.col("unit_id").alias("node_id")).orderBy("node_id").limit(500)
    ids = settle(ids, "ids")
    full = ids.agg((F.count("*") >= 500).alias("truncated"))
    return graph.edges_among(found, ids).join(F.broadcast(full))
