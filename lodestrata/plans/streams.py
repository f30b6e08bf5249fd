"""Streaming operators run over the events table's file to its end; results equal the batch's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contract import ORACLES, query
from ..functions.paths import normal_url
from ..shared import new_path, settle
from ..sources.keyed import KeyedTable, last_rows, new_rows, without
from ..streaming import arrivals, rolling
from ..streaming.arrivals import LateRows
from ..tables import code_units, usage
from . import series  # noqa: F401  its SQL is used here
from .navigation import RAW_URL, REGISTRY, normal_url_sql, raw_url, registry
from .views import sql

#: Buckets of the keyed tables below.
BUCKETS = 16
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _place(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def _table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern may name either, a plain path only a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{{{name}}}.parquet")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_stream(spark, sf_dir, "events", SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Drains the stream into a table in the shared folder and reads it back."""
    place = _place(spark)
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{place}/rows")  # a stream without rows runs no batch
    rolling.drain(stream, lambda df, _: df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{place}/rows"), f"{place}/state", mode)
    return spark.read.schema(schema).parquet(f"{place}/rows")


@query("SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'purchase')::BIGINT AS successes FROM events GROUP BY user_id")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, rolling.counters(_stream(spark, sf_dir)), "complete")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, rolling.throughput(_stream(spark, sf_dir), late="40 days"), "complete")
    return found.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT event_id, user_id FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    return _run(spark, rolling.once(stream.union(stream), "event_id").select("event_id", "user_id"), "append")


@query("SELECT user_id, count(*)::BIGINT AS n_sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, k, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k) GROUP BY user_id")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session memory as a stream, its sessions counted by user."""
    found = _run(spark, rolling.sessions(_stream(spark, sf_dir), late="40 days"), "complete")
    return found.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


@query("SELECT user_id, count(*)::BIGINT AS n, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id")
def stream_last_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and last access kept as state by user, with a time to live that each event renews."""
    found = _run(spark, rolling.last_access(_stream(spark, sf_dir)), "append")
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_us").alias("last_us"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*)::BIGINT AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each day and type, as a stream."""
    found = _run(spark, rolling.latency(_stream(spark, sf_dir), late="40 days"), "complete")
    return found.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "least", "most")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, merged by key batch by batch into the buckets a batch touches; every event is delivered twice."""
    stream = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    held = KeyedTable(spark, _place(spark), stream.schema, ["user_id"], BUCKETS)
    rolling.drain(stream.union(stream), held.sink(last_rows(["user_id"], "event_id")), f"{held.place}/state")
    return held.read()


def _in_batches(spark: SparkSession, rows: DataFrame, batches: int, run: Callable[[DataFrame], None]) -> None:
    """Lets ``rows`` arrive by their column ``batch``: each one's files are written, and ``run`` drains the stream of the folder."""
    rows, place = settle(rows, "arrivals"), _place(spark)
    schema = rows.drop("batch").schema
    for k in range(batches):
        rows.filter(F.col("batch") == k).drop("batch").write.mode("append").parquet(place)
        run(spark.readStream.schema(schema).parquet(place))


#: Days of events that arrive together.
DAYS = 6
FIRST_US = 1704067200000000
# Every tenth event comes one batch after its time, every hundredth two.
BATCH = f"(greatest(at_us - {FIRST_US}, 0) // {DAYS * 86_400_000_000} + CASE WHEN event_id % 100 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
BATCHES = 8


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("event_id") % 100 == 0, 2).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    own = F.floor(F.greatest(F.col("at_us") - FIRST_US, F.lit(0)) / (DAYS * 86_400_000_000))
    return usage(spark, sf_dir).select("event_id", "event_type", "shard", "value", "at_us", (own + late).alias("batch"))


@query(
    sql(f"""b AS (SELECT *, {BATCH} AS batch FROM usage), m AS (SELECT batch, max(max(at_us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS mark FROM b GROUP BY batch)
      SELECT batch::BIGINT AS batch, event_type, count(*) FILTER (mark IS NULL OR at_us >= mark)::BIGINT AS on_time, count(*) FILTER (at_us < mark)::BIGINT AS late FROM b JOIN m USING (batch) GROUP BY 1, 2""", "usage")
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive out of order, against a watermark of an hour: those on time and those late by batch, in tables of their own."""
    writer = LateRows(spark, _place(spark), 3_600_000_000)
    _in_batches(spark, _arriving(spark, sf_dir), BATCHES, lambda stream: rolling.drain(stream, writer.write, f"{writer.place}/state"))
    read = lambda name: spark.read.parquet(f"{writer.place}/{name}").withColumn("late", F.lit(name == "late"))
    both = read("on_time").unionByName(read("late"))
    return both.groupBy(F.col("batch").cast("long").alias("batch"), "event_type").agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))


@query(ORACLES["latency_percentiles"])
def stream_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each type's and shard's last 256 samples as events arrive out of order: rings as state, merged by key."""
    held = KeyedTable(spark, _place(spark), StructType.fromDDL(arrivals.RING), ["event_type", "shard", "part"], BUCKETS)
    run = lambda stream: rolling.drain(arrivals.last_samples(stream), held.sink(new_rows(held.key)), f"{held.place}/state", "update")
    _in_batches(spark, _arriving(spark, sf_dir), BATCHES, run)
    return arrivals.percentiles(held.read())


# Units come in three batches: all, then those of every fifth file with other texts, then the first batch again.
UPSERTED = "SELECT unit_id, repo_id, source_sha, CASE WHEN doc_id // 12 % 5 = 0 THEN 'changed' ELSE 'first' END AS state FROM code WHERE doc_id // 12 % 7 <> 3"


@query(sql(UPSERTED, "code"))
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units written by key in batches: all, those of some files anew, and a deletion of others; the first batch comes twice."""
    units = code_units(spark, sf_dir).select("doc_id", "unit_id", "repo_id", "file_path", "source_sha")
    file = F.floor(F.col("doc_id") / 12)
    rows = lambda state: units.select("unit_id", "repo_id", "file_path", "source_sha", F.lit(state).alias("state"))
    held = KeyedTable(spark, _place(spark), rows("").schema, ["repo_id", "file_path"], BUCKETS)
    anew = settle(rows("changed").join(units.filter(file % 5 == 0).select("unit_id"), "unit_id", "left_semi").select(rows("").columns), "anew")
    gone = rows("gone").join(units.filter(file % 7 == 3).select("unit_id"), "unit_id", "left_semi").select(rows("").columns)
    by_file = new_rows(held.key)
    for number, batch, merge in ((0, rows("first"), by_file), (0, rows("first"), by_file), (1, anew, by_file), (2, gone, without(held.key))):
        held.write(batch, number, merge)
    return held.read().select("unit_id", "repo_id", "source_sha", "state")


@query(
    "WITH " + REGISTRY + f""", p AS (SELECT page_id, split_part({normal_url_sql(RAW_URL)}, '/', 1) AS host, 'b' || (page_id % 4) AS branch FROM pages)
      SELECT page_id, CASE WHEN source_type = 'managed' THEN host END AS repo_id, CASE WHEN source_type IS NULL OR source_type <> 'managed' THEN 'unmatched' WHEN r.branch <> p.branch THEN 'skipped' ELSE 'triggered' END AS state FROM p LEFT JOIN registry r ON r.repo_id = p.host AND r.source_type = 'managed'"""
)
def stream_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes (pages) as a stream against the registry: which start a sync."""
    pages = _table_stream(spark, sf_dir, "pages", "page_id long, url string, html string")
    host = F.split_part(normal_url(raw_url()), F.lit("/"), F.lit(1))
    pushed = pages.select("page_id", host.alias("host"), F.concat(F.lit("b"), (F.col("page_id") % 4).cast("string")).alias("branch"))
    return _run(spark, rolling.pushes(pushed, settle(registry(spark, sf_dir), "registry")), "append")
