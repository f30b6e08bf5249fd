"""Overviews of repositories, modules and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import query
from ..functions import identity, text
from ..tables import code_units, units
from .views import sql

SHARDS = 4


@query(sql("SELECT repo_id, count(*)::BIGINT AS n_units, count(DISTINCT file_path)::BIGINT AS n_files, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM units GROUP BY repo_id", "units"))
def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.groupBy("repo_id").agg(F.count("*").alias("n_units"), F.countDistinct("file_path").alias("n_files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query(sql("SELECT repo_id, language, kind, count(*)::BIGINT AS n_units, count(DISTINCT file_path)::BIGINT AS n_files FROM units GROUP BY repo_id, language, kind", "units"))
def repo_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy("repo_id", "language", "kind").agg(F.count("*").alias("n_units"), F.countDistinct("file_path").alias("n_files"))


@query(sql("SELECT split_part(qualified_name, '.', 1) AS top, count(*)::BIGINT AS n_units, array_to_string(list_sort(list(DISTINCT parent_qualified_name)), ',') AS children FROM units GROUP BY 1", "units"))
def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.groupBy(F.split_part("qualified_name", F.lit("."), F.lit(1)).alias("top")).agg(F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_set("parent_qualified_name")), ",").alias("children"))


@query(
    sql("""p AS (SELECT n.node_id, array_to_string(list_slice(string_split(qualified_name, '.'), 1, i), '.') AS prefix FROM nodes n, LATERAL (SELECT unnest(range(1, len(string_split(qualified_name, '.')))) AS i))
      SELECT m.qualified_name, count(*)::BIGINT AS n FROM p JOIN nodes m ON m.qualified_name = p.prefix AND m.kind IN ('Module', 'File') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""", "nodes")
)
def largest_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by name, over all depths: names give their prefixes, which meet modules by equality."""
    from ..operators.graph import prefixes
    from ..tables import nodes

    n = nodes(spark, sf_dir)
    modules = n.filter("kind in ('Module', 'File')").select(F.col("qualified_name").alias("prefix"))
    held = n.filter("instr(qualified_name, '.') > 0").select(F.explode(prefixes(F.col("qualified_name"))).alias("p")).select("p.prefix")
    return held.join(modules, "prefix").groupBy(F.col("prefix").alias("qualified_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qualified_name").limit(10)


@query(
    sql("""d AS (SELECT parent_qualified_name AS module, kind, name FROM units)
      SELECT module, count(*) FILTER (kind = 'class')::BIGINT AS n_classes, count(*) FILTER (kind = 'function')::BIGINT AS n_functions, count(*) FILTER (kind = 'constant')::BIGINT AS n_constants,
        md5(array_to_string(list_sort(list(DISTINCT name) FILTER (kind = 'class')), ',')) AS classes FROM d GROUP BY module""", "units")
)
def module_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    n = lambda k: F.count_if(F.col("kind") == k)
    names = F.collect_set(F.when(F.col("kind") == "class", F.col("name")))
    return u.groupBy(F.col("parent_qualified_name").alias("module")).agg(n("class").alias("n_classes"), n("function").alias("n_functions"), n("constant").alias("n_constants"), F.when(n("class") > 0, F.md5(F.array_join(F.array_sort(names), ","))).alias("classes"))


@query(sql("SELECT parent_qualified_name AS module, count(*) FILTER (kind = 'function')::BIGINT AS n_functions, count(*) FILTER (kind = 'class')::BIGINT AS n_classes, min(name) FILTER (kind IN ('function', 'class')) AS first_name FROM units WHERE NOT starts_with(name, '_') GROUP BY 1 HAVING count(*) FILTER (kind IN ('function', 'class')) > 0", "units"))
def api_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions and classes of each module; modules without either are left out."""
    u = units(spark, sf_dir).filter(~F.col("name").startswith("_") & F.col("kind").isin("function", "class"))
    return u.groupBy(F.col("parent_qualified_name").alias("module")).agg(F.count_if(F.col("kind") == "function").alias("n_functions"), F.count_if(F.col("kind") == "class").alias("n_classes"), F.min("name").alias("first_name"))


SHARD = f"(('0x' || substr(sha256(repo_id), 1, 16))::UBIGINT % {SHARDS})::BIGINT"


@query(sql(f"SELECT DISTINCT repo_id, {SHARD} AS shard FROM units", "units"))
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("repo_id").distinct().withColumn("shard", identity.shard(F.col("repo_id"), SHARDS))


@query(sql(f"SELECT {SHARD} AS shard, count(DISTINCT repo_id)::BIGINT AS n_repos, count(*)::BIGINT AS n_units, sum(length(content))::BIGINT AS n_chars FROM units GROUP BY 1", "units"))
def ingestion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).withColumn("shard", identity.shard(F.col("repo_id"), SHARDS))
    return u.groupBy("shard").agg(F.countDistinct("repo_id").alias("n_repos"), F.count("*").alias("n_units"), F.sum(F.length("content")).alias("n_chars"))


@query(
    sql("""q AS (SELECT *, 'src.f' || k || '.' || kind AS common FROM code), d AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, common ORDER BY line_start, doc_id) AS nth FROM q),
      n AS (SELECT doc_id, repo_id, file_path, CASE WHEN nth = 1 THEN common ELSE common || '#' || nth END AS qualified_name FROM d) SELECT doc_id, qualified_name, sha256(repo_id || chr(0) || file_path || chr(0) || qualified_name) AS unit_id FROM n""", "code")
)
def overload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and later units of one name in a file (here they are named by their kind alone) get #2, #3 and so on, and ids to match."""
    common = F.concat(F.lit("src.f"), F.floor(F.col("doc_id") / 12).cast("string"), F.lit("."), "kind")
    nth = F.row_number().over(Window.partitionBy("repo_id", "file_path", "common").orderBy("line_start", "doc_id"))
    u = code_units(spark, sf_dir).withColumn("common", common).withColumn("nth", nth)
    name = F.when(F.col("nth") == 1, F.col("common")).otherwise(F.concat("common", F.lit("#"), F.col("nth").cast("string")))
    return u.select("doc_id", name.alias("qualified_name"), identity.unit_id(F.col("repo_id"), F.col("file_path"), name).alias("unit_id"))


@query(
    sql("""r AS (SELECT unit_id, kind, file_path, qualified_name, list_sort(list_distinct(CASE WHEN kind IN ('module', 'section') THEN imports WHEN kind IN ('function', 'method') THEN calls WHEN kind = 'class' THEN bases ELSE [] END)) AS dep FROM code)
      SELECT unit_id, '{' || CASE WHEN len(dep) > 0 THEN '"dep":["' || array_to_string(dep, '","') || '"],' ELSE '' END || '"id":"' || unit_id || '","k":"' || kind || '","p":"' || file_path || '","q":"' || qualified_name || '"}' AS record FROM r""", "code")
)
def dense_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as short records: what a unit depends on, by its kind, then its id, kind, path and name; empty lists are left out."""
    dep = F.when(F.col("kind").isin("module", "section"), F.col("imports")).when(F.col("kind").isin("function", "method"), F.col("calls")).when(F.col("kind") == "class", F.col("bases"))
    dep = F.array_sort(F.array_distinct(dep))
    return code_units(spark, sf_dir).select("unit_id", text.record(dep=F.when(F.size(dep) > 0, dep), id=F.col("unit_id"), k=F.col("kind"), p=F.col("file_path"), q=F.col("qualified_name")).alias("record"))


@query(sql("SELECT doc_id, regexp_replace(regexp_replace(file_path, '\\.md$', ''), '/', '.', 'g') AS module_name FROM units", "units"))
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import module_name

    return units(spark, sf_dir).select("doc_id", module_name(F.col("file_path")).alias("module_name"))
