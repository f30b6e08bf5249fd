"""Streams whose rows come late or again: rings of last samples as state, and late rows kept in a table of their own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settle

#: Parts that the samples of a key are dealt out to, so that no task holds all of a frequent one.
PARTS = 8
RING = "event_type string, shard long, part long, ats array<long>, ids array<long>, held array<double>"


def last_samples(stream: DataFrame, size: int = 256) -> DataFrame:
    """The last ``size`` samples (by at_us, then event_id) of each part of an (event_type, shard), given anew when a batch changes them.

    A ring of a part is all the state; rows that come late take their place by time, whatever batch brings them.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held += zip(frame["at_us"].tolist(), frame["event_id"].tolist(), frame["value"].tolist(), strict=True)
            held = sorted(held)[-size:]
        ring = tuple(list(c) for c in zip(*held, strict=True))
        state.update(ring)
        yield pd.DataFrame({"event_type": [key[0]], "shard": [key[1]], "part": [key[2]], "ats": [ring[0]], "ids": [ring[1]], "held": [ring[2]]})

    dealt = stream.select("event_type", "shard", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).alias("part"), "at_us", "event_id", "value")
    groups = dealt.groupBy("event_type", "shard", "part")
    return groups.applyInPandasWithState(update, RING, "ats array<long>, ids array<long>, held array<double>", "update", GroupStateTimeout.NoTimeout)


def percentiles(rings: DataFrame, size: int = 256) -> DataFrame:
    """(event_type, shard, n, p50, p95, p99, mean, most) over each key's last ``size`` samples, from the rings of its parts."""
    sample = F.explode(F.arrays_zip("ats", "ids", "held")).alias("s")
    newest = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, size)  # at most PARTS rings a key
    held = rings.select("event_type", "shard", sample).groupBy("event_type", "shard").agg(newest.alias("newest"))
    values = held.select("event_type", "shard", F.explode("newest.held").alias("value"))
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p")
    found = values.groupBy("event_type", "shard").agg(F.count("*").alias("n"), p, F.avg("value").alias("mean"), F.max("value").alias("most"))
    return found.select("event_type", "shard", "n", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))], F.round("mean", 6).alias("mean"), "most")


@dataclass
class LateRows:
    """A ``foreachBatch`` writer of two tables, ``on_time`` and ``late``, at ``place``.

    The watermark of a batch is the latest event time of the batches before it, less ``late_us``; rows before it are late. What the latest
    was is written beside each batch's rows, so a batch that comes again is divided as it was the first time and takes the place of itself.
    """

    spark: SparkSession
    place: str
    late_us: int

    def watermark(self, number: int) -> int | None:
        """Of the batches before ``number``, which are numbered from 0 without gaps."""
        if number == 0:
            return None
        latest = self.spark.read.schema("latest long").parquet(f"{self.place}/marks/batch={number - 1}").first().latest
        return None if latest is None else latest - self.late_us

    def write(self, batch: DataFrame, number: int) -> None:
        rows = settle(batch, "batch")
        mark = self.watermark(number)
        late = F.lit(False) if mark is None else F.coalesce(F.col("at_us") < mark, F.lit(False))
        for name, own in (("on_time", ~late), ("late", late)):
            rows.filter(own).write.mode("overwrite").parquet(f"{self.place}/{name}/batch={number}")
        before = F.lit(None if mark is None else mark + self.late_us).cast("long")
        rows.agg(F.greatest(F.max("at_us"), before).alias("latest")).write.mode("overwrite").parquet(f"{self.place}/marks/batch={number}")
