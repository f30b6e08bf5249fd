"""JSON lines of audit payloads: append and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Payloads as written; the chain is made anew from them, so a replay alone shows no tampering."""
    return spark.read.schema(schema).json(path)
