"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _FALLBACK[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    The written table survives lost executors, fixes what a rerun of an upstream task could
    otherwise deliver in another order, and gives the planner true sizes.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def has_odd_ids(own: DataFrame) -> bool:
    """Whether a doc_id is null or held by several rows."""
    return not own.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with distinct ids and, where the ids of ``docs`` are not such, (row, own): the id of each made key."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not has_odd_ids(own):
        return own, None
    rows = settle(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.select(F.col("row").alias("doc_id"), "text"), rows.select("row", F.col("doc_id").alias("own"))
