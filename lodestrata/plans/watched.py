"""Source files made from documents: a whole ingest of them, and the same files as a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..shared import new_path, settle
from ..sources import ingest, repository
from ..streaming import rolling
from ..streaming.watch import Index
from ..tables import load
from .streams import _in_batches

# A function a document, twelve a file: it calls the next function, the first one of the next file, and print.
FINAL = """d AS (SELECT doc_id, doc_id // 12 AS k, 'r' || doc_id // 12 % 3 AS repo_id, 'src/f' || doc_id // 12 || '.py' AS file_path, 'src.f' || doc_id // 12 AS module FROM documents),
  kept AS (SELECT *, k % 5 = 1 AS second FROM d WHERE NOT (k % 5 = 1 AND doc_id % 3 = 0) AND k % 6 <> 2),
  placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY file_path) AS total FROM kept),
  bodies AS (SELECT *, 'def d' || doc_id || '():' || chr(10) || '    d' || (doc_id + 1) || '()' || chr(10) || '    src.f' || (k + CASE WHEN second THEN 2 ELSE 1 END) || '.d' || ((k + 1) * 12 + doc_id % 4) || '()' || chr(10) || '    print()' AS body FROM placed),
  units AS (SELECT repo_id, file_path, module, doc_id, 'function' AS kind, module || '.d' || doc_id AS qualified_name, body AS content, second FROM bodies
    UNION ALL SELECT repo_id, file_path, module, NULL, 'module', module, string_agg(body, chr(10) ORDER BY doc_id) || chr(10), bool_or(second) FROM bodies GROUP BY 1, 2, 3),
  found AS (SELECT *, sha256(repo_id || chr(0) || file_path || chr(0) || qualified_name) AS unit_id FROM units),
  asked AS (SELECT repo_id, unit_id, module, doc_id, unnest(['d' || (doc_id + 1), 'src.f' || (doc_id // 12 + CASE WHEN second THEN 2 ELSE 1 END) || '.d' || ((doc_id // 12 + 1) * 12 + doc_id % 4), 'print']) AS ref FROM found WHERE kind = 'function'),
  edges AS (SELECT 'file:' || sha256(repo_id || chr(0) || file_path) AS src_id, 'CONTAINS' AS kind, unit_id AS dst_id FROM found WHERE kind = 'function'
    UNION SELECT sha256(repo_id || chr(0) || file_path || chr(0) || module), 'DEFINES', unit_id FROM found WHERE kind = 'function'
    UNION SELECT a.unit_id, 'CALLS', coalesce(x.unit_id, y.unit_id, 'external:' || ref) FROM asked a LEFT JOIN found x ON x.kind = 'function' AND x.repo_id = a.repo_id AND x.qualified_name = ref LEFT JOIN found y ON y.kind = 'function' AND NOT contains(ref, '.') AND y.repo_id = a.repo_id AND y.qualified_name = a.module || '.' || ref)"""


def _file(rows: DataFrame, second: bool) -> DataFrame:
    """(k, path, content): files of the first or the second version of their functions."""
    body = F.expr(f"'def d' || doc_id || '():\\n    d' || (doc_id + 1) || '()\\n    src.f' || (k + {2 if second else 1}) || '.d' || ((k + 1) * 12 + doc_id % 4) || '()\\n    print()'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", body.alias("body")))), lambda x: x["body"]), "\n")
    return rows.groupBy("k").agg(F.concat(text, F.lit("\n")).alias("content"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 12").alias("k"))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, language, content) of the files as they are in the end."""
    rows = _functions(spark, sf_dir).filter("k % 6 <> 2")
    files = _file(rows.filter("k % 5 <> 1"), False).union(_file(rows.filter("k % 5 = 1 AND doc_id % 3 <> 0"), True))
    return files.select(F.expr("'r' || k % 3").alias("repo_id"), F.expr("'src/f' || k || '.py'").alias("path"), F.lit("python").alias("language"), "content")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, at, path, op, content): files in batches, first three of four, then the rest and second versions, then removals; also changes that mean nothing."""
    rows = _functions(spark, sf_dir)
    path = lambda folder: F.expr(f"'/w/r' || k % 3 || '/{folder}/f' || k || '.py'").alias("path")
    change = lambda df, batch, at, op, folder="src": df.select(F.lit(batch).alias("batch"), F.lit(at).cast("long").alias("at"), path(folder), F.lit(op).alias("op"), "content")
    first = _file(rows, False)
    removed = first.withColumn("content", F.lit(None).cast("string"))
    # A file whose functions all go is removed, as there is no second version of it.
    emptied = rows.filter("k % 5 = 1").groupBy("k").agg(F.count_if(F.col("doc_id") % 3 != 0).alias("n")).filter("n = 0").select("k", F.lit(None).cast("string").alias("content"))
    broken = first.withColumn("content", F.lit("def (\n"))
    parts = [
        change(first.filter("k % 4 <> 3"), 0, 2, "added"),
        change(broken.filter("k % 4 <> 3 AND k % 7 = 0"), 0, 1, "added"),
        change(first.filter("k % 8 = 0"), 0, 1, "added", "node_modules"),
        change(first.filter("k % 4 = 3"), 1, 3, "added"),
        change(_file(rows.filter("k % 5 = 1 AND doc_id % 3 <> 0"), True), 1, 4, "modified"),
        change(emptied, 1, 4, "removed"),
        change(removed.filter("k % 6 = 2"), 2, 5, "removed"),
        change(broken.filter("k % 6 <> 2 AND k % 9 = 4"), 2, 6, "modified"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _watched(spark: SparkSession, sf_dir: str) -> Index:
    roots = spark.createDataFrame([(f"/w/r{i}", f"r{i}") for i in range(3)] + [("/w", "all")], "root string, repo_id string")
    index = Index(spark, new_path(spark, "index"), roots, buckets=16)
    _in_batches(spark, _changes(spark, sf_dir), 3, lambda stream: rolling.drain(stream, index.write, f"{index.place}/state"))
    return index


@query("WITH " + FINAL + " SELECT unit_id, kind, qualified_name, sha256(content) AS source_sha FROM found")
def watched_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units after three batches of changed files: as a whole ingest of the files that are left would have them."""
    return _watched(spark, sf_dir).units.read().select("unit_id", "kind", "qualified_name", "source_sha")


@query("WITH " + FINAL + " SELECT src_id, kind, dst_id FROM edges")
def watched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the same batches; those of untouched files lead to what came and no longer to what went."""
    return _watched(spark, sf_dir).edges.read().select("src_id", "kind", "dst_id")


COUNTED = """failed AS (SELECT DISTINCT file_path FROM d WHERE k % 11 = 3 AND k % 6 <> 2), good AS (SELECT * FROM found WHERE file_path NOT IN (SELECT file_path FROM failed)),
  refs AS (SELECT a.unit_id, a.ref, coalesce(x.unit_id, y.unit_id, 'external:' || ref) AS dst FROM asked a JOIN good g ON g.unit_id = a.unit_id LEFT JOIN good x ON x.kind = 'function' AND x.repo_id = a.repo_id AND x.qualified_name = ref LEFT JOIN good y ON y.kind = 'function' AND NOT contains(ref, '.') AND y.repo_id = a.repo_id AND y.qualified_name = a.module || '.' || ref),
  links AS (SELECT unit_id AS src, dst FROM refs UNION SELECT file_path, unit_id FROM good WHERE kind = 'function' UNION SELECT module, unit_id FROM good WHERE kind = 'function')
  SELECT count(DISTINCT file_path)::BIGINT AS files_walked, (count(DISTINCT file_path) - (SELECT count(*) FROM failed))::BIGINT AS files_parsed, (SELECT count(*) FROM failed)::BIGINT AS files_failed,
    (SELECT count(*) FROM good)::BIGINT AS units_emitted, (SELECT count(*) FROM good WHERE doc_id IS NULL OR doc_id % 4 <> 1)::BIGINT AS units_changed, (SELECT count(*) FROM good WHERE doc_id IS NULL OR doc_id % 4 <> 1)::BIGINT AS units_embedded, (SELECT count(*) FROM good)::BIGINT AS vector_payloads_written,
    ((SELECT count(*) FROM good) + (SELECT count(DISTINCT file_path) FROM good) + (SELECT count(DISTINCT dst) FROM refs WHERE starts_with(dst, 'external:')))::BIGINT AS nodes_written, (SELECT count(*) FROM links)::BIGINT AS edges_written FROM found"""


@query("WITH " + FINAL + ", " + COUNTED)
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of all files writes, against a store that has every fourth function already; some files do not parse."""
    files = _final(spark, sf_dir)
    number = F.regexp_extract("path", r"f(\d+)\.py$", 1).cast("long")
    files = settle(files.withColumn("content", F.when(number % 11 == 3, "def (\n").otherwise(F.col("content"))), "files")
    own = F.regexp_extract("qualified_name", r"\.d(\d+)$", 1)
    parsed = ingest.read(files)
    stored = parsed[0].filter((own != "") & (own.cast("long") % 4 == 1)).select("unit_id", "repo_id", "file_path", "source_sha")
    return ingest.ingest(files, stored, parsed=parsed).counted()
