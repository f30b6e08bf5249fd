"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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


#: Rows of a table that one task takes.
ROWS = 300_000


def spread(table: DataFrame) -> int:
    """How many tasks a shuffle of a stored table's rows needs, so that a task stays of one size as the table grows; not fewer than the session's.

    The count is read from the files' footers.
    """
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS))


def dealt(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """Rows by their columns in so many tasks; as Spark sees fit where no number is given."""
    return df.repartition(parts, *columns) if parts else df


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: it survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
