"""Ingestion queries: documents as files, parsed to units and edges; vectors from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions import paths
from ..functions.embedding import embed
from ..sources import parsers, store
from ..tables import load, units
from .views import sql


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))


@query()
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and sections of all documents."""
    return parsers.units(files(spark, sf_dir))[0].select("repo_id", "qualified_name", "kind", "line_start", "line_end")


@query("SELECT doc_id, split_part(ltrim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10), 1) AS line, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that is not blank, and the number of lines."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.split_part(F.ltrim(F.col("text"), F.lit(" \n\t\r")), F.lit("\n"), F.lit(1)).alias("line"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS href FROM pages) SELECT page_id, count(*)::BIGINT AS n_links, count(DISTINCT href)::BIGINT AS n_targets, min(href) AS first_link FROM l GROUP BY page_id")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of raw pages, as import edges."""
    links = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), 1)).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"), F.min("href").alias("first_link"))


PATHS = "['src/', 'a/target/', '.next/', 'venv/x/', 'targets/', 'a/.mypy_cache/b/', 'node_modules/', 'docs/'][doc_id % 8 + 1] || doc_id || ['.md', '.RST', '.py', '.txt', ''][doc_id % 5 + 1]"


@query(
    sql(f"""p AS (SELECT doc_id, {PATHS} AS path, CASE WHEN doc_id % 3 = 0 THEN upper(unit_id) WHEN doc_id % 3 = 1 THEN unit_id ELSE substr(unit_id, 2) END AS id FROM units)
      SELECT doc_id, NOT regexp_matches('/' || path, '/(\\.git|node_modules|dist|build|target|\\.venv|venv|__pycache__|\\.next|\\.mypy_cache|\\.pytest_cache)/') AS relevant, regexp_matches(lower(path), '\\.(md|rst|txt)$') AS is_doc, regexp_matches(id, '^[0-9a-f]{{64}}$') AS is_id FROM p""", "units")
)
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many paths matter, are documents, and which ids are well formed."""
    from ..functions.identity import is_unit_id

    folder = F.element_at(F.array(*map(F.lit, ["src/", "a/target/", ".next/", "venv/x/", "targets/", "a/.mypy_cache/b/", "node_modules/", "docs/"])), (F.col("doc_id") % 8 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, [".md", ".RST", ".py", ".txt", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(folder, F.col("doc_id").cast("string"), suffix)
    own = F.when(F.col("doc_id") % 3 == 0, F.upper("unit_id")).when(F.col("doc_id") % 3 == 1, F.col("unit_id")).otherwise(F.substring("unit_id", 2, 64))
    return units(spark, sf_dir).select("doc_id", paths.is_relevant(path).alias("relevant"), paths.is_doc(path).alias("is_doc"), is_unit_id(own).alias("is_id"))


@query()
def embed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic vector for the first chunk of each unit."""
    u = units(spark, sf_dir)
    text = F.concat("qualified_name", F.lit(" ("), "kind", F.lit(")\n"), F.coalesce("signature", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, 1600))
    return u.select("unit_id", embed(text, 16).alias("vector"))


@query("SELECT vec_id, vec_id % 5 <> 0 AS has_vector, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE len(embedding) END::BIGINT AS n_given FROM embeddings")
def vector_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("vector"))
    return store.with_placeholders(points, 64).select("vec_id", "has_vector", F.when(F.col("has_vector"), F.size("vector")).otherwise(0).cast("long").alias("n_given"))


@query("SELECT l_partkey AS key, arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS l_suppkey FROM lineitem GROUP BY 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("at"))
    return store.last_wins(rows, ["key"], "at").select("key", "l_suppkey")


@query("SELECT l_suppkey AS src, l_partkey AS dst, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS first_weight, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS last_weight FROM lineitem GROUP BY 1, 2")
def deduplicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written many times: across a run the first stays, within one build the last."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("at"))
    key = ["src", "dst"]
    return store.first_wins(rows, key, "at").select(*key, F.col("weight").alias("first_weight")).join(store.last_wins(rows, key, "at").select(*key, F.col("weight").alias("last_weight")), key)


@query(sql("SELECT repo_id, count(*)::BIGINT AS n_vectors, count(*) FILTER (fresh)::BIGINT AS n_fresh FROM (SELECT repo_id, repo_id = 'fr' AS fresh, content, doc_id FROM code) WHERE CASE WHEN fresh THEN trim(content) <> '' ELSE doc_id % 6 <> 4 END GROUP BY 1", "code"))
def reindexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by repository after one repository is embedded anew (its vectors have another length here)."""
    from ..sources.ingest import reindex
    from ..tables import code_units

    u = code_units(spark, sf_dir)
    stored = u.filter("doc_id % 6 <> 4").select("unit_id", "repo_id", embed(F.col("qualified_name"), 16).alias("vector"))
    now = reindex(stored, u, "fr", 32)
    return now.groupBy("repo_id").agg(F.count("*").alias("n_vectors"), F.count_if(F.size("vector") == 32).alias("n_fresh"))
