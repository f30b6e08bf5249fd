"""Units on disk by repository, in order of file and line: a tenant's reads open its own files only.

A repository's folder is a partition that its filter prunes; its files hold ranges of paths, so the statistics of
their row groups leave out what a path does not lie in. A large repository is written by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["repo_id", "file_path", "line_start", "qualified_name"]


@dataclass(frozen=True)
class UnitStore:
    spark: SparkSession
    place: str

    def write(self, units: DataFrame) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = units.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
        dealt.write.mode("overwrite").partitionBy("repo_id").parquet(self.place)

    def read(self) -> DataFrame:
        # The repository's name stays text, whatever it looks like.
        found = self.spark.read.parquet(self.place)
        return found.withColumn("repo_id", F.col("repo_id").cast("string")) if dict(found.dtypes)["repo_id"] != "string" else found

    def of_repo(self, repo_id: str) -> DataFrame:
        """One repository's units in order of file, line and name."""
        return self.read().filter(F.col("repo_id") == repo_id).orderBy("file_path", "line_start", "qualified_name")

    def of_file(self, repo_id: str, path: str) -> DataFrame:
        own = self.read().filter((F.col("repo_id") == repo_id) & (F.col("file_path") == path))
        return own.orderBy("line_start", "qualified_name")
