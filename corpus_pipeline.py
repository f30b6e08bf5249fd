"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark items go, sources are mixed to their targets, and the rest is written as token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet and reads it
again for the next. All but the last keep the columns of ``documents``.

Defined results: rows of null or repeated ids go through every stage, each judged by itself; of rows of equal
(doc_id, text) one is left by the near-duplicate stage; null and empty texts are kept until the end, where they have
the end id alone (mixing takes a document of no words as often as its hash says); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, jaccard_join, mixing, token_files, toxicity
from lodestrata.llm.queries import TOXIC_FROM, tokenizer_path
from lodestrata.llm.shared import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC_FROM, learned from the labels and the unfiltered documents."""
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.below(docs, lexicon, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at a Jaccard of 0.8 or more, the document of least id, null last.

    Rows whose id is null or repeated are told apart by a key of their own; of equal (doc_id, text) one stays.
    """
    odd = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        found = jaccard_join.jaccard_components(docs, words=5, percent=80)
        extra = found.filter("component_id <> doc_id").select("doc_id")
        return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
    rows = settle(docs.dropDuplicates(["doc_id", "text"]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    found = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), seed=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three."""
    return mixing.repeat(docs, most=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and a row a document read back from them."""
    folder, manifest = token_files.write_tokens(docs, tokenizer_path(), end_id=1)
    return token_files.read_tokens(folder, manifest)


STAGES = [("toxicity", drop_toxic), ("n-gram jaccard join", drop_near_duplicates), ("benchmark decontamination", drop_contaminated), ("mixing", mix_sources), ("token files", encode)]

#: Learned scores, tiling and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
