"""Usage, relevance, decay, compaction and refresh plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions import scoring
from ..operators import graph, lifecycle
from ..shared import dealt, settle
from ..tables import NOW, edge_parts, edges, nodes, usage
from .graph import FOLDED, signed_twice
from .views import SIGNED_PREVIOUS, sql


def _scored(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """``held`` are the edges, where they are used otherwise too."""
    n = nodes(spark, sf_dir)
    stats = lifecycle.usage_stats(usage(spark, sf_dir))
    return lifecycle.relevance(n, stats, graph.in_degree(n, edges(spark, sf_dir) if held is None else held), NOW)


def _with_status(scored: DataFrame) -> DataFrame:
    """A status for each entity, as the tables have none: low for those whose id's digest says so."""
    low = F.ascii(F.substring(F.sha2("entity_id", 256), 1, 1)) % 7 == 0
    return scored.withColumn("status", F.when(low, "low_priority_index").otherwise("active"))


@query(sql("SELECT entity_id, usage_count, last_us FROM usage_stats", "usage_stats"))
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.usage_stats(usage(spark, sf_dir)).select("entity_id", "usage_count", "last_us")


@query(sql("SELECT entity_id, attempts, successes, round(CASE WHEN attempts = 0 THEN 0.0 ELSE successes / attempts END, 6) AS success_rate FROM usage_stats", "usage_stats"))
def feedback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.usage_stats(usage(spark, sf_dir)).select("entity_id", "attempts", "successes", F.round(lifecycle.success_rate(), 6).alias("success_rate"))


@query(sql("SELECT entity_id, score FROM relevance", "relevance"))
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("entity_id", "score")


DECAY = """low AS (SELECT *, hash_low AS is_low FROM (SELECT *, ascii(substr(sha256(entity_id), 1, 1)) % 7 = 0 AS hash_low FROM relevance)),
  d AS (SELECT entity_id, score, CASE WHEN is_low AND score >= 0.3 THEN 'PROMOTE' WHEN NOT is_low AND (age_days IS NULL OR age_days > {days}) AND centrality < 0.2 AND score < 0.3 THEN 'DOWNGRADE' ELSE 'NO_OP' END AS action FROM low)"""


@query(sql(DECAY.format(days=30) + " SELECT * FROM d", "relevance"))
def decay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.decay(_with_status(_scored(spark, sf_dir)), stale_days=30).select("entity_id", "score", "action")


@query(sql(DECAY.format(days=7) + " SELECT action, count(*)::BIGINT AS n FROM d WHERE action <> 'NO_OP' GROUP BY action", "relevance"))
def decay_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a plan would write: its rows without NO_OP, by action, at a shorter age."""
    return lifecycle.decay(_with_status(_scored(spark, sf_dir)), stale_days=7).filter("action <> 'NO_OP'").groupBy("action").agg(F.count("*").alias("n"))


@query(sql(DECAY.format(days=7) + " SELECT l.entity_id, CASE action WHEN 'PROMOTE' THEN 'active' WHEN 'DOWNGRADE' THEN 'low_priority_index' ELSE CASE WHEN is_low THEN 'low_priority_index' ELSE 'active' END END AS status, action <> 'NO_OP' AS written FROM low l JOIN d USING (entity_id)", "relevance"))
def applied_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses after a plan is applied: only its rows without NO_OP are written."""
    planned = lifecycle.decay(_with_status(_scored(spark, sf_dir)), stale_days=7)
    return lifecycle.apply_decay(planned).select("entity_id", "status", "written")


REASONS = """, r AS (SELECT v.entity_id, list_filter([CASE WHEN score < 0.4 THEN 'LOW_RELEVANCE' END, CASE WHEN success_rate < 0.5 THEN 'LOW_SUCCESS_RATE' END, CASE WHEN p.signature <> s.signature THEN 'NEIGHBOR_DRIFT' END], lambda x: x IS NOT NULL) AS reasons
        FROM relevance v JOIN signed s ON s.node_id = v.entity_id JOIN previous p ON p.node_id = v.entity_id)"""


@query(
    sql(SIGNED_PREVIOUS + REASONS + ", " + DECAY.format(days=30) + ", " + FOLDED + """, c AS (SELECT arg_max(x.node_id, p.i) AS module_id FROM (SELECT * FROM relevance WHERE score < 0.3 AND kind NOT IN ('Module', 'Class')) v, LATERAL (SELECT unnest(range(1, len(string_split(v.qualified_name, '.')))) AS i) p
        JOIN nodes x ON x.kind = 'Module' AND x.qualified_name = array_to_string(list_slice(string_split(v.qualified_name, '.'), 1, p.i), '.') GROUP BY v.entity_id)
      SELECT (SELECT count(*) FROM relevance)::BIGINT AS n_entities, (SELECT count(*) FROM d WHERE action = 'PROMOTE')::BIGINT AS n_promote, (SELECT count(*) FROM d WHERE action = 'DOWNGRADE')::BIGINT AS n_downgrade,
        (SELECT count(*) FROM r WHERE len(reasons) > 0)::BIGINT AS n_refresh, (SELECT count(*) FROM f)::BIGINT AS n_folded, (SELECT count(DISTINCT module_id) FROM c)::BIGINT AS n_compacted""", "relevance")
)
def lifecycle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the lifecycle: scores once, then decay, refresh, compaction of graph and memory, in figures."""
    parts = edge_parts(spark, sf_dir)
    n, e = nodes(spark, sf_dir), settle(edges(spark, sf_dir, parts), "edges")
    in_degree = graph.in_degree(n, e)
    scored = settle(_with_status(lifecycle.relevance(n, lifecycle.usage_stats(usage(spark, sf_dir)), in_degree, NOW)), "scored")
    planned = lifecycle.decay(scored, stale_days=30).agg(F.count("*").alias("n_entities"), F.count_if(F.col("action") == "PROMOTE").alias("n_promote"), F.count_if(F.col("action") == "DOWNGRADE").alias("n_downgrade"))
    fresh = lifecycle.refresh(scored, signed_twice(n, dealt(e, parts, "src_id"))).agg(F.count("*").alias("n_refresh"))
    folded, _ = graph.compaction(n, e, scored.select(F.col("entity_id").alias("node_id"), "centrality"), 0.2, ["Function", "Method", "Constant", "Section"])
    merged = lifecycle.memory_compaction(scored, graph.nearest_module(n)).agg(F.count("*").alias("n_compacted"))
    out = planned
    for row in (fresh, folded.agg(F.count("*").alias("n_folded")), merged):
        out = out.join(F.broadcast(row))  # a row each
    return out


@query(
    sql(SIGNED_PREVIOUS + """, r AS (SELECT v.entity_id, list_filter([CASE WHEN score < 0.4 THEN 'LOW_RELEVANCE' END, CASE WHEN success_rate < 0.5 THEN 'LOW_SUCCESS_RATE' END, CASE WHEN p.signature <> s.signature THEN 'NEIGHBOR_DRIFT' END], lambda x: x IS NOT NULL) AS reasons
        FROM relevance v JOIN signed s ON s.node_id = v.entity_id JOIN previous p ON p.node_id = v.entity_id)
      SELECT entity_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""", "relevance")
)
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities to embed anew; the earlier signatures are those without CALLS edges."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return lifecycle.refresh(_scored(spark, sf_dir, e), signed_twice(n, e)).select("entity_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    sql("""m AS (SELECT v.*, arg_max(x.node_id, p.i) AS module_id FROM relevance v, LATERAL (SELECT unnest(range(1, len(string_split(v.qualified_name, '.')))) AS i) p JOIN nodes x ON x.kind = 'Module' AND x.qualified_name = array_to_string(list_slice(string_split(v.qualified_name, '.'), 1, p.i), '.') GROUP BY ALL)
      SELECT module_id, count(*) FILTER (score < 0.3 AND kind NOT IN ('Module', 'Class'))::BIGINT AS n_victims, count(*) FILTER (NOT (score < 0.3 AND kind NOT IN ('Module', 'Class')))::BIGINT AS n_survivors,
        md5(array_to_string(list_sort(list(entity_id) FILTER (score < 0.3 AND kind NOT IN ('Module', 'Class'))), ',')) AS victims FROM (SELECT DISTINCT entity_id, kind, score, module_id FROM m) GROUP BY 1 HAVING n_victims > 0""", "relevance")
)
def memory_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.memory_compaction(_scored(spark, sf_dir), graph.nearest_module(nodes(spark, sf_dir)))


@query(
    sql("""t AS (SELECT sum(attempts) AS a, sum(successes) AS s FROM usage_stats), r AS (SELECT CASE WHEN coalesce(a, 0) = 0 THEN 0 ELSE (s / a - 0.5) * 0.05 END AS d FROM t),
      w AS (SELECT * FROM (VALUES ('semantic', 0.35, 1), ('graph', 0.25, 1), ('recency', 0.20, 1), ('importance', 0.15, 0), ('feedback', 0.05, 0)) v(feature, w, moves)),
      n AS (SELECT feature, greatest(0, w + moves * d) AS w FROM w, r) SELECT feature, round(w / sum(w) OVER (), 6)::DOUBLE AS weight FROM n""", "usage_stats")
)
def weight_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ranking weights from the success rate over all entities."""
    return lifecycle.weight_proposal(lifecycle.usage_stats(usage(spark, sf_dir)), scoring.RANKING, 0.05)
