"""Session memory on disk: entries appended by session, bucketed by it, with a time to live that each append renews."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import record
from .keyed import KeyedTable


@dataclass
class SessionMemory:
    """Entries (session_id, at in seconds, data); an append that comes again adds nothing."""

    spark: SparkSession
    place: str
    ttl_s: int = 86_400
    buckets: int = 16
    table: KeyedTable = field(init=False)

    def __post_init__(self) -> None:
        schema = StructType.fromDDL("session_id string, at long, entry string")
        self.table = KeyedTable(self.spark, self.place, schema, ["session_id"], self.buckets)

    def append(self, entries: DataFrame, number: int) -> None:
        at = F.col("at").cast("long")
        rows = entries.select("session_id", at.alias("at"), record(ts=at, data=F.col("data")).alias("entry"))
        self.table.write(rows, number, lambda old, new: old.unionByName(new))

    def entries(self, now: int | None = None) -> DataFrame:
        """The entries of sessions that have not expired at ``now``."""
        rows = self.table.read()
        if now is None:
            return rows
        live = rows.groupBy("session_id").agg(F.max("at").alias("last")).filter(F.col("last") + self.ttl_s > now)
        return rows.join(live.select("session_id"), "session_id", "left_semi")

    def sessions(self, now: int | None = None) -> DataFrame:
        """(session_id, entries, memory, expires): each session's entries in order, a line each."""
        lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"])
        held = self.entries(now).groupBy("session_id").agg(F.count("*").alias("entries"), F.array_join(lines, "\n").alias("memory"), F.max("at").alias("last"))
        return held.select("session_id", "entries", "memory", (F.col("last") + self.ttl_s).alias("expires"))
