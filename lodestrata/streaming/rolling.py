"""Events as streams: rolling latency and throughput, counters, sessions and idempotent delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files, with event time as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def throughput(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latency(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Samples, least, mean and largest by type and window; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def pushes(stream: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, repo_id, state) of pushes (page_id, host, branch): unmatched, skipped (another branch) or triggered. The registry is one table for all batches."""
    known = registry.filter("source_type = 'managed'").select(F.col("repo_id").alias("host"), F.col("branch").alias("tracked"))
    other = F.col("tracked").isNotNull() & F.col("branch").isNotNull() & (F.col("tracked") != F.col("branch"))
    state = F.when(F.col("known").isNull(), "unmatched").when(other, "skipped").otherwise("triggered")
    met = stream.join(known.withColumn("known", F.lit(True)), "host", "left")
    return met.select("page_id", F.when(F.col("known"), F.col("host")).alias("repo_id"), state.alias("state"))


def counters(stream: DataFrame) -> DataFrame:
    """Usage and success counters by entity, in update mode."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("successes"))


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Session memory whose time to live each append renews."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Redelivered rows within the watermark go."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs what is there now to its end, batch by batch, through ``write``."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def last_access(stream: DataFrame, ttl_ms: int = 400 * 86_400_000) -> DataFrame:
    """(user_id, n, last_us) after each batch; a user's state goes when no event renews it for ``ttl_ms`` of event time."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["at_us"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_us": [last]})

    events_ = stream.withWatermark("ts", "1 hour").select("user_id", "ts", F.unix_micros("ts").alias("at_us"))
    return events_.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_us long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def changed_files(spark: SparkSession, folder: str, patterns: str = "*") -> DataFrame:
    """New or replaced files of a watched folder as (path, content), with a short trigger as the debounce."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", patterns).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
