"""Search, ranking and context queries over units and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import query
from ..functions import identity, scoring
from ..operators import search
from ..tables import load, units
from .views import sql

TEXT, K, SCAN = "the", 50, 200
BUDGET, COST_EXTRA, COST_CAP = 600, 50, 8000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("vector"))


def asked_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The request's vector: that of the least id."""
    row = vectors(spark, sf_dir).orderBy("unit_id").select("vector").first()
    return list(row["vector"]) if row else []


@query(sql("SELECT doc_id, unit_id, source_sha, substr(sha256(repo_id || chr(0) || name), 1, 16) AS query_id, ceil(length(content) / 4.0)::BIGINT AS tokens FROM units", "units"))
def unit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.select("doc_id", "unit_id", "source_sha", identity.query_id(F.col("repo_id"), F.col("name")).alias("query_id"), scoring.token_estimate(F.col("content")).alias("tokens"))


KEYWORD = "qualified_name ILIKE '%the%' OR name ILIKE '%the%' OR docstring ILIKE '%the%' OR signature ILIKE '%the%'"


@query(sql(f"SELECT unit_id, doc_id, updated_s FROM units WHERE {KEYWORD} ORDER BY updated_s DESC, unit_id LIMIT {K}", "units"))
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_top_k(units(spark, sf_dir), TEXT, K).select("unit_id", "doc_id", "updated_s")


@query(sql("SELECT qualified_name, unit_id FROM units WHERE contains(lower(qualified_name), 'en.d1') ORDER BY length(qualified_name), qualified_name LIMIT 20", "units"))
def qname_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.autocomplete(units(spark, sf_dir), "en.d1", 20).select("qualified_name", "unit_id")


@query(
    sql("""held AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY length(qualified_name), qualified_name) AS place FROM units WHERE contains(lower(qualified_name), 'd1') OR contains(lower(name), 'd1')),
      more AS (SELECT repo_id, max(place) > 25 AS truncated FROM held WHERE place <= 26 GROUP BY repo_id)
      SELECT repo_id, qualified_name, truncated FROM held JOIN more USING (repo_id) WHERE place <= 25 ORDER BY length(qualified_name), qualified_name, repo_id LIMIT 25""", "units")
)
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_symbol(units(spark, sf_dir), "d1", 25).select("repo_id", "qualified_name", "truncated")


VECTOR = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
  scored AS (SELECT vec_id AS unit_id, label::VARCHAR AS kind, round(list_inner_product(embedding::DOUBLE[], q.v) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q.v, q.v))), 9) AS raw FROM embeddings, q),
  best AS (SELECT unit_id, kind, least(1.0, greatest(0.0, raw)) AS score FROM scored ORDER BY raw DESC, unit_id LIMIT {k})"""


@query("WITH " + VECTOR.format(k=K) + " SELECT unit_id, kind, round(score, 6) AS score FROM best")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_top_k(vectors(spark, sf_dir), asked_vector(spark, sf_dir), K).select("unit_id", "kind", F.round("score", 6).alias("score"))


@query("WITH " + VECTOR.format(k=K) + " SELECT unit_id, kind, round(score, 6) AS score FROM best WHERE kind IN ('1', '3')")
def vector_topk_kind_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_top_k(vectors(spark, sf_dir), asked_vector(spark, sf_dir), K, ["1", "3"]).select("unit_id", "kind", F.round("score", 6).alias("score"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are joined to the next unit of their repository, by id."""
    near = Window.partitionBy("repo_id").orderBy("doc_id")
    u = units(spark, sf_dir).select("doc_id", "repo_id").withColumn("next", F.lead("doc_id").over(near)).filter("next is not null")
    return u.select(F.col("doc_id").alias("src_id"), F.lit("REFERENCES").alias("kind"), F.col("next").alias("dst_id"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import both_ways, held, reach

    u = units(spark, sf_dir)
    asked = asked_vector(spark, sf_dir)
    vector = search.cosine_top_k(vectors(spark, sf_dir).drop("kind").withColumn("kind", F.lit("")), asked, K).select("unit_id", F.round("score", 6).alias("score"))
    keyword = search.keyword_top_k(u, TEXT, K).select(F.col("doc_id").alias("unit_id"))
    seeds = u.agg(F.min("doc_id").alias("node_id")).filter("node_id is not null")
    graph = reach(both_ways(held(_links(spark, sf_dir), 2)).select("here", "there"), seeds, 2).select(F.col("node_id").alias("unit_id"), "depth")
    return search.rank(search.fuse(vector, graph, keyword), K)


RANKED = (
    VECTOR.format(k=K)
    + f""", links AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY repo_id ORDER BY doc_id) AS b FROM units),
  steps AS (SELECT a AS here, b AS there FROM links WHERE b IS NOT NULL UNION ALL SELECT b, a FROM links WHERE b IS NOT NULL),
  walk AS (SELECT min(doc_id) AS node, 0 AS depth FROM units UNION ALL SELECT there, depth + 1 FROM walk JOIN steps ON node = here WHERE depth < 2),
  keyword AS (SELECT doc_id FROM units WHERE {KEYWORD} ORDER BY updated_s DESC, unit_id LIMIT {K}),
  cand AS (SELECT node AS unit_id, 'graph' AS channel, NULL::DOUBLE AS cosine, min(depth) AS depth, NULL::DOUBLE AS keyword FROM walk WHERE node IS NOT NULL GROUP BY node
    UNION ALL SELECT doc_id, 'metadata', NULL, NULL, 0.5 FROM keyword UNION ALL SELECT unit_id, 'vector', round(score, 6), NULL, NULL FROM best),
  fused AS (SELECT unit_id, max(cosine) AS cosine, min(depth) AS depth, max(keyword) AS keyword, list_sort(list(DISTINCT channel)) AS channels FROM cand GROUP BY unit_id),
  ranked AS (SELECT unit_id, channels, round(0.35 * greatest(coalesce(cosine, 0), coalesce(keyword, 0)) + 0.25 * coalesce(1.0 / (1 + depth), 0), 6) AS final_score
    FROM fused ORDER BY final_score DESC, unit_id LIMIT {K})"""
)


@query(sql(RANKED + " SELECT unit_id, final_score, array_to_string(channels, ',') AS channels FROM ranked", "units", recursive=True))
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: vector, graph and keyword channels fused and ranked."""
    return _ranked(spark, sf_dir).select("unit_id", "final_score", F.array_join("channels", ",").alias("channels"))


@query(
    sql(RANKED + f""", entries AS (SELECT r.unit_id, r.final_score, u.qualified_name, ceil((length(r.unit_id::VARCHAR) + length(u.qualified_name) + length(u.file_path) + length(u.kind)
        + list_sum(list_transform(channels, lambda c: length(c) + 2)) + 2 * (len(channels) - 1) + 2) / 4.0)::BIGINT AS cost,
        CASE u.kind WHEN 'constant' THEN 0 WHEN 'module' THEN 2 WHEN 'class' THEN 2 WHEN 'section' THEN 3 ELSE 4 END AS pri FROM ranked r JOIN units u ON u.doc_id = r.unit_id),
      seq AS (SELECT *, row_number() OVER (ORDER BY pri, final_score DESC, unit_id) AS n FROM entries),
      fold AS (SELECT 0::BIGINT AS n, 0::HUGEINT AS used, false AS taken UNION ALL
        SELECT s.n, CASE WHEN f.used + s.cost <= {BUDGET} THEN f.used + s.cost ELSE f.used END, f.used + s.cost <= {BUDGET} FROM fold f JOIN seq s ON s.n = f.n + 1)
      SELECT row_number() OVER (ORDER BY s.n)::BIGINT AS place, s.unit_id, s.cost, round(avg(s.final_score) OVER (), 6) AS confidence FROM seq s JOIN fold f USING (n) WHERE f.taken""", "units", recursive=True)
)
def retrieve_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked units with their rows, packed under a token budget, and the packet's confidence."""
    u = units(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), "qualified_name", "file_path", "kind")
    held = _ranked(spark, sf_dir).select("unit_id", "final_score", "channels").join(u, "unit_id")
    cost = search.context_cost(F.col("unit_id").cast("string"), [F.col("qualified_name"), F.col("file_path"), F.col("kind")], F.col("channels"))
    kind = search.context_type(F.col("kind"))
    priority = F.array_position(F.array(*map(F.lit, ["constraint", "risk", "architecture", "logic", "code"])), kind)
    entries = held.select(F.lit(1).alias("request"), "unit_id", "final_score", cost.alias("cost"), priority.alias("pri"))
    packed = search.pack_greedy(entries, "request", [F.col("pri"), -F.col("final_score"), F.col("unit_id")], "cost", BUDGET)
    mean = F.round(F.avg("final_score").over(Window.partitionBy("request")), 6)
    return packed.withColumn("confidence", mean).select("place", "unit_id", "cost", "confidence")


@query(
    sql(f"""hits AS (SELECT unit_id, updated_s, ceil(length(docstring) / 4.0)::BIGINT + {COST_EXTRA} AS cost, repo_id FROM units WHERE {KEYWORD}),
      run AS (SELECT *, sum(cost) OVER (PARTITION BY repo_id ORDER BY updated_s DESC, unit_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY repo_id ORDER BY updated_s DESC, unit_id) AS place FROM hits)
      SELECT repo_id, unit_id, place::BIGINT AS place, used FROM run WHERE used <= {COST_CAP} OR place = 1""", "units")
)
def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each repository, the newest hits up to the response budget."""
    hits = units(spark, sf_dir).filter(search.keyword_match(TEXT, "qualified_name", "name", "docstring", "signature"))
    hits = hits.withColumn("cost", F.ceil(F.length("docstring") / 4).cast("long") + COST_EXTRA)
    return search.pack_prefix(hits, ["repo_id"], [F.desc("updated_s"), F.col("unit_id")], "cost", COST_CAP).select("repo_id", "unit_id", F.col("place").cast("long").alias("place"), "used")


@query(
    sql("""n AS (SELECT unit_id, content, CASE WHEN length(content) = 0 THEN 0 WHEN length(content) <= 1600 THEN 1 ELSE 1 + ceil((length(content) - 1600) / 1440.0) END::BIGINT AS chunks FROM units)
      SELECT unit_id || '#c' || i AS chunk_id, (i * 1440)::BIGINT AS char_start, least(i * 1440 + 1600, length(content))::BIGINT AS char_end, md5(substr(content, i * 1440 + 1, 1600)) AS digest, ceil(length(substr(content, i * 1440 + 1, 1600)) / 4.0)::BIGINT AS tokens
      FROM n, LATERAL (SELECT unnest(range(chunks)) AS i)""", "units")
)
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1,600 characters every 1,440, the last one ending with the text."""
    size = F.length("content")
    count = F.when(size == 0, 0).when(size <= 1600, 1).otherwise(1 + F.ceil((size - 1600) / 1440)).cast("int")
    chunks = units(spark, sf_dir).select("unit_id", "content", F.explode(F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1))).alias("i"))
    text = F.substring(F.col("content"), F.col("i") * 1440 + 1, F.lit(1600))
    return chunks.select(F.concat("unit_id", F.lit("#c"), F.col("i").cast("string")).alias("chunk_id"), (F.col("i") * 1440).cast("long").alias("char_start"), F.least(F.col("i") * 1440 + 1600, size).cast("long").alias("char_end"), F.md5(text).alias("digest"), scoring.token_estimate(text).alias("tokens"))


@query(
    sql("""d AS (SELECT repo_id, '{"id":"' || unit_id || '","k":"' || kind || '","p":"' || file_path || '","q":"' || qualified_name || '"}' AS j, strlen(content) AS raw FROM units)
      SELECT repo_id, sum(raw)::BIGINT AS bytes_in, sum(strlen(j))::BIGINT AS bytes_out, round(greatest(0, 1 - sum(strlen(j)) / sum(raw)), 6) AS reduction FROM d GROUP BY repo_id""", "units")
)
def dense_encode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense records with sorted short keys, and the bytes they save."""
    record = F.to_json(F.struct(F.col("unit_id").alias("id"), F.col("kind").alias("k"), F.col("file_path").alias("p"), F.col("qualified_name").alias("q")))
    d = units(spark, sf_dir).select("repo_id", F.octet_length("content").alias("raw"), F.octet_length(record).alias("dense"))
    return d.groupBy("repo_id").agg(F.sum("raw").alias("bytes_in"), F.sum("dense").alias("bytes_out")).withColumn("reduction", F.round(F.greatest(F.lit(0.0), 1 - F.col("bytes_out") / F.col("bytes_in")), 6))


@query(sql("SELECT 'r' AS k, qualified_name, file_path FROM units WHERE file_path ILIKE '%d1%' OR file_path ILIKE '%1.md%' ORDER BY file_path, qualified_name LIMIT 5", "units"))
def similar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).filter(search.keyword_match("d1", "file_path") | search.keyword_match("1.md", "file_path")).orderBy("file_path", "qualified_name").limit(5).select(F.lit("r").alias("k"), "qualified_name", "file_path")


@query(
    sql("""o AS (SELECT *, max(line_end) OVER (PARTITION BY repo_id, language ORDER BY line_start, qualified_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM units)
      SELECT repo_id, language, qualified_name, line_start, line_end FROM o WHERE covered IS NULL OR line_end > covered""", "units")
)
def covered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a file that reach past all lines before them."""
    order = Window.partitionBy("repo_id", "language").orderBy("line_start", "qualified_name").rowsBetween(Window.unboundedPreceding, -1)
    u = units(spark, sf_dir).withColumn("covered", F.max("line_end").over(order))
    return u.filter(F.col("covered").isNull() | (F.col("line_end") > F.col("covered"))).select("repo_id", "language", "qualified_name", "line_start", "line_end")
