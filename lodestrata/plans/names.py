"""Queries over names that nest and names that meet: modules at any depth, overloads and whom they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions.identity import unit_id
from ..operators import build, overloads
from ..tables import load
from .views import VIEWS, sql

#: Units of a chain: a module, and classes each within the one before.
CHAIN = 22

# The n-th document of its 22 is a class in the one before; every fourth chain has no module, every third a gap.
NESTED = f"""SELECT sha256(repo_id || chr(0) || file_path || chr(0) || qualified_name) AS unit_id, * FROM (SELECT 'r' || doc_id // {CHAIN} % 5 AS repo_id, 'f' || doc_id // {CHAIN} || '.py' AS file_path, doc_id,
    CASE WHEN doc_id % {CHAIN} = 0 THEN 'module' ELSE 'class' END AS kind, 'm' || doc_id // {CHAIN} || '.c' || doc_id % {CHAIN} AS qualified_name, doc_id % {CHAIN} AS line_start,
    CASE WHEN doc_id % {CHAIN} > 0 THEN 'm' || doc_id // {CHAIN} || '.c' || (doc_id % {CHAIN} - 1) END AS parent_qualified_name FROM documents
    WHERE NOT (doc_id // {CHAIN} % 4 = 1 AND doc_id % {CHAIN} = 0) AND NOT (doc_id // {CHAIN} % 3 = 2 AND doc_id % {CHAIN} = 7))"""


def nested_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chains of classes, up to twenty-one deep."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(f"doc_id div {CHAIN}").alias("k"), F.expr(f"doc_id % {CHAIN}").alias("p"))
    kept = d.filter("NOT (k % 4 = 1 AND p = 0) AND NOT (k % 3 = 2 AND p = 7)")
    name = lambda at: F.expr(f"'m' || k || '.c' || ({at})")
    named = kept.select(
        F.expr("'r' || k % 5").alias("repo_id"),
        F.expr("'f' || k || '.py'").alias("file_path"),
        "doc_id",
        F.when(F.col("p") == 0, "module").otherwise("class").alias("kind"),
        name("p").alias("qualified_name"),
        F.col("p").alias("line_start"),
        F.when(F.col("p") > 0, name("p - 1")).alias("parent_qualified_name"),
    )
    return named.withColumn("unit_id", unit_id(F.col("repo_id"), F.col("file_path"), F.col("qualified_name")))


@query("WITH RECURSIVE code AS (" + NESTED + "), module_of AS (" + VIEWS["module_of"] + ") SELECT repo_id, unit_id, module FROM module_of")
def nested_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module of units in chains of classes: at any depth, across names that no unit has, and without one."""
    return build.module_of(nested_units(spark, sf_dir))


# Twelve documents a file: three classes C whose lines hold methods m; C#2 and C#4 stand in some files already.
METS = """SELECT 'r' || doc_id // 12 % 3 AS repo_id, 'f' || doc_id // 12 AS file_path, doc_id AS place, doc_id % 12 AS p, doc_id // 12 AS k, doc_id % 12 * 10 + 1 AS line_start,
    doc_id % 12 * 10 + CASE WHEN doc_id % 12 IN (1, 3, 6) THEN 28 ELSE 5 END AS line_end,
    CASE WHEN doc_id % 12 = 0 THEN 'module' WHEN doc_id % 12 IN (1, 3, 6) THEN 'class' WHEN doc_id % 12 IN (2, 4, 5, 7, 8) THEN 'method' ELSE 'function' END AS kind,
    CASE WHEN doc_id % 12 = 0 THEN 'M' WHEN doc_id % 12 IN (1, 3, 6) THEN 'M.C' WHEN doc_id % 12 IN (2, 4, 5, 7, 8) THEN 'M.C.m' WHEN doc_id % 12 = 9 AND doc_id // 12 % 3 = 0 THEN 'M.C#2'
      WHEN doc_id % 12 = 10 AND doc_id // 12 % 2 = 0 THEN 'M.C#4' WHEN doc_id % 12 = 11 AND doc_id // 12 % 5 = 0 THEN 'M.C.m#3' ELSE 'M.f' || doc_id % 12 END AS qualified_name,
    CASE WHEN doc_id % 12 = 0 THEN NULL WHEN doc_id % 12 IN (2, 4, 5, 7, 8) THEN 'M.C' ELSE 'M' END AS parent_qualified_name FROM documents"""

RENAMED = """WITH RECURSIVE u AS (""" + METS + """), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, qualified_name ORDER BY line_start, line_end, place) AS nth FROM u),
  tried AS (SELECT repo_id, file_path, qualified_name AS base, place, nth, nth AS number FROM n WHERE nth = 2
    UNION ALL SELECT t.repo_id, t.file_path, t.base, coalesce(x.place, t.place), coalesce(x.nth, t.nth), t.number + 1 FROM tried t
      LEFT JOIN u taken ON taken.repo_id = t.repo_id AND taken.file_path = t.file_path AND taken.qualified_name = t.base || '#' || t.number
      LEFT JOIN n x ON taken.place IS NULL AND x.repo_id = t.repo_id AND x.file_path = t.file_path AND x.qualified_name = t.base AND x.nth = t.nth + 1
      WHERE taken.place IS NOT NULL OR x.place IS NOT NULL),
  names AS (SELECT repo_id, file_path, place, base || '#' || max(number) AS new_name FROM tried GROUP BY repo_id, file_path, place, base),
  own AS (SELECT n.*, new_name FROM n LEFT JOIN names USING (repo_id, file_path, place)),
  held AS (SELECT c.repo_id, c.file_path, c.place, arg_min(p.new_name, (p.line_start, p.line_end, p.place)) AS new_parent FROM own c JOIN own p ON p.repo_id = c.repo_id AND p.file_path = c.file_path AND p.qualified_name = c.parent_qualified_name
    AND p.new_name IS NOT NULL AND p.kind = 'class' AND p.line_start <= c.line_start AND c.line_end <= p.line_end AND p.place <> c.place GROUP BY 1, 2, 3)
  SELECT place AS doc_id, coalesce(new_name, qualified_name) AS qualified_name, coalesce(new_parent, parent_qualified_name) AS parent_qualified_name, sha256(repo_id || chr(0) || file_path || chr(0) || coalesce(new_name, qualified_name)) AS unit_id
  FROM own LEFT JOIN held USING (repo_id, file_path, place)"""


def meeting_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with three classes and five methods of one name, and in some files units that have a number already."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 12").alias("k"), F.expr("doc_id % 12").alias("p"))
    kind = F.expr("CASE WHEN p = 0 THEN 'module' WHEN p IN (1, 3, 6) THEN 'class' WHEN p IN (2, 4, 5, 7, 8) THEN 'method' ELSE 'function' END")
    taken = "WHEN p = 9 AND k % 3 = 0 THEN 'M.C#2' WHEN p = 10 AND k % 2 = 0 THEN 'M.C#4' WHEN p = 11 AND k % 5 = 0 THEN 'M.C.m#3'"
    qname = F.expr(f"CASE WHEN p = 0 THEN 'M' WHEN p IN (1, 3, 6) THEN 'M.C' WHEN p IN (2, 4, 5, 7, 8) THEN 'M.C.m' {taken} ELSE 'M.f' || p END")
    parent = F.expr("CASE WHEN p = 0 THEN NULL WHEN p IN (2, 4, 5, 7, 8) THEN 'M.C' ELSE 'M' END")
    return d.select(
        F.expr("'r' || k % 3").alias("repo_id"),
        F.expr("'f' || k").alias("file_path"),
        F.col("doc_id").alias("place"),
        kind.alias("kind"),
        qname.alias("qualified_name"),
        parent.alias("parent_qualified_name"),
        (F.col("p") * 10 + 1).alias("line_start"),
        (F.col("p") * 10 + F.when(F.col("p").isin(1, 3, 6), 28).otherwise(5)).alias("line_end"),
    )


@query(RENAMED)
def renamed_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of one name in a file as they are stored: numbers that are taken are passed over, methods follow their class."""
    found = overloads.renamed(meeting_units(spark, sf_dir))
    return found.select(F.col("place").alias("doc_id"), "qualified_name", "parent_qualified_name", "unit_id")
