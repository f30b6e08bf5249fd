"""Tables that are written by key in place: buckets by hash of key, a write rewrites the buckets that it touches.

A batch writes the new state of its buckets to a folder of its own and then, as one file, the list of those buckets
to ``commits``. A reader takes each bucket as its last committed batch left it, so a batch that was cut off is as if
it had not been, and one that is delivered again starts from what was there before it and leaves the same. Work is
the batch and the buckets it touches, whatever else the table holds. ``vacuum`` deletes what no reader and no
delivery of the last batch needs.

The driver handles the numbers of buckets, at most ``buckets``; rows stay with the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "bucket int, batch int, attempt string, folder string"
#: Files that a bucket is written as, at the most.
FILES = 4
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def last_rows(key: list[str], order: str) -> Merge:
    """Keeps each key's row that is last by ``order``; of equals the one with the greatest other columns."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in key and c != order]
        last = old.unionByName(new).groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("row"))
        return last.select(*key, "row.*")

    return merge


def new_rows(key: list[str]) -> Merge:
    """The new row of a key in place of the old one."""
    return lambda old, new: old.join(new.select(*key), key, "left_anti").unionByName(new)


def without(key: list[str]) -> Merge:
    """The old rows whose key is not among the new ones."""
    return lambda old, new: old.join(new.select(*key), key, "left_anti")


@dataclass
class KeyedTable:
    """A table at ``place`` with columns ``schema``, bucketed by ``key``."""

    spark: SparkSession
    place: str
    schema: StructType
    key: list[str]
    buckets: int = 64

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def versions(self, before: int | None = None) -> dict[int, str | None]:
        """Each bucket's folder as its last committed batch, of those before ``before``, left it; None for an empty one."""
        try:
            commits = self.spark.read.schema(COMMITS).parquet(f"{self.place}/commits")
        except AnalysisException as error:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        last = F.max(F.struct("batch", "attempt", "folder")).alias("last")
        return {r.bucket: r["last"].folder for r in commits.groupBy("bucket").agg(last).collect()}

    def _read(self, versions: dict[int, str | None]) -> DataFrame:
        paths = [f"{self.place}/rows/{folder}/bucket={bucket}" for bucket, folder in sorted(versions.items()) if folder]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those that the batches before one left."""
        return self._read(self.versions(before))

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        wanted = {r.bucket for r in self._bucket(keys.select(*self.key)).select("bucket").distinct().collect()}
        own = self._read({b: n for b, n in self.versions().items() if b in wanted})
        return own.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def replace(self, keys: DataFrame, rows: DataFrame, number: int) -> list[int]:
        """Puts ``rows`` in place of all rows of ``keys``; rows have no other keys, and a key without rows is deleted."""
        marked = keys.select(*self.key).distinct().join(rows, self.key, "left")
        given = rows.select(*self.key).distinct().withColumn("_given", F.lit(True))
        marked = marked.join(given, self.key, "left").withColumn("_row", F.coalesce("_given", F.lit(False))).drop("_given")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*self.key), self.key, "left_anti").unionByName(new.filter("_row").drop("_row"))

        return self.write(marked, number, merge)

    def write(self, rows: DataFrame, number: int, merge: Merge) -> list[int]:
        """Merges a batch into the buckets of its keys; gives the buckets that it rewrote."""
        rows = self._bucket(rows).persist()
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if touched:
            old = self._read({b: n for b, n in self.versions(before=number).items() if b in touched})
            merged = self._bucket(merge(old, rows.drop("bucket"))).select(*self.schema.fieldNames(), "bucket")
            attempt = uuid.uuid4().hex
            folder = f"batch={number}-{attempt}"
            # Some tasks a bucket: one with many rows is spread over several files.
            spread = F.pmod(F.xxhash64(*self.schema.fieldNames()), F.lit(FILES))
            merged.repartition(len(touched) * FILES, "bucket", spread).write.partitionBy("bucket").parquet(f"{self.place}/rows/{folder}")
            written = self.spark.read.schema("bucket int").parquet(f"{self.place}/rows/{folder}")
            full = {r.bucket for r in written.select("bucket").distinct().collect()}
            commit = [(b, number, attempt, folder if b in full else None) for b in touched]
            self.spark.createDataFrame(commit, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.place}/commits")
        rows.unpersist()
        return touched

    def sink(self, merge: Merge) -> Callable[[DataFrame, int], None]:
        """A writer for ``foreachBatch``."""
        return lambda batch, number: self.write(batch, number, merge) and None

    def vacuum(self, last: int) -> int:
        """Deletes folders of buckets that neither the table nor a new delivery of batch ``last`` reads; gives their number."""
        needed = {f"{folder}/bucket={b}" for v in (self.versions(), self.versions(before=last)) for b, folder in v.items()}
        files, base = pafs.FileSystem.from_uri(self.place if "://" in self.place else f"file://{self.place}")
        held = files.get_file_info(pafs.FileSelector(f"{base}/rows", recursive=True, allow_not_found=True))
        old = [i.path for i in held if i.type == pafs.FileType.Directory and "/bucket=" in i.path]
        old = [p for p in old if "/".join(p.rsplit("/", 2)[1:]) not in needed]
        for path in old:
            files.delete_dir(path)
        return len(old)
