"""Latency, throughput, anomalies, sessions, limits and other sequential queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import query
from ..functions import scoring
from ..operators import sequential
from ..tables import load, usage
from .views import sql

LAST_N = 256
LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY event_type, shard ORDER BY at_us DESC, event_id DESC) AS n FROM usage)"


def last_n(events: DataFrame, n: int = LAST_N) -> DataFrame:
    order = Window.partitionBy("event_type", "shard").orderBy(F.desc("at_us"), F.desc("event_id"))
    return events.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


@query(sql(LAST + f" SELECT event_id, event_type, shard, value FROM l WHERE n <= {LAST_N}", "usage"))
def latency_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_n(usage(spark, sf_dir)).select("event_id", "event_type", "shard", "value")


@query(
    sql(LAST + f""" SELECT event_type, shard, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, max(value) AS most
      FROM l WHERE n <= {LAST_N} GROUP BY 1, 2""", "usage")
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    held = last_n(usage(spark, sf_dir)).groupBy("event_type", "shard").agg(F.count("*").alias("n"), p.alias("p"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return held.select("event_type", "shard", "n", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), F.round(F.col("p")[2], 6).alias("p99"), "mean", "most")


@query(sql("SELECT event_id, count(*) OVER (PARTITION BY event_type, shard ORDER BY at_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM usage", "usage"))
def throughput_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the 60 seconds up to each event, the first instant included.

    Each event stands in its own minute and in the next, so a minute's window needs no other minute's rows and no type gathers in one task.
    """
    own = F.floor(F.col("at_us") / 60_000_000)
    spread = usage(spark, sf_dir).select("event_id", "event_type", "shard", "at_us", own.alias("own"), F.explode(F.array(own, own + 1)).alias("minute"))
    window = Window.partitionBy("event_type", "shard", "minute").orderBy("at_us").rangeBetween(-60_000_000, 0)
    return spread.withColumn("n", F.count("*").over(window)).filter("own = minute").select("event_id", "n")


@query(sql("m AS (SELECT max(at_us) AS now_us FROM usage) SELECT event_type, shard, count(*)::BIGINT AS n, round(count(*) / 3600.0, 6) AS per_second FROM usage, m WHERE at_us >= now_us - 3600000000 GROUP BY 1, 2", "usage"))
def throughput_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hour up to the newest, and their rate."""
    e = usage(spark, sf_dir)
    newest = F.broadcast(e.agg(F.max("at_us").alias("now_us")))  # one row
    return e.join(newest, F.col("at_us") >= F.col("now_us") - 3_600_000_000).groupBy("event_type", "shard").agg(F.count("*").alias("n"), F.round(F.count("*") / 3600.0, 6).alias("per_second"))


@query(
    sql("""s AS (SELECT event_type, shard, avg(value) AS m, stddev_samp(value) AS d, count(*) AS n FROM usage GROUP BY 1, 2),
      z AS (SELECT event_type, shard, s.n, CASE WHEN s.n < 2 OR d = 0 THEN 0 ELSE abs((value - m) / d) END AS z FROM usage JOIN s USING (event_type, shard))
      SELECT event_type, shard, count(*) FILTER (z >= 2 AND z < 3)::BIGINT AS n_watch, count(*) FILTER (z >= 3)::BIGINT AS n_anomaly, CASE WHEN max(z) >= 3 THEN 'ANOMALY' WHEN max(z) >= 2 THEN 'WATCH' ELSE 'NORMAL' END AS state FROM z GROUP BY 1, 2""", "usage")
)
def zscore_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usage(spark, sf_dir)
    stats = e.groupBy("event_type", "shard").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"), F.count("*").alias("n"))
    z = F.when((F.col("n") < 2) | (F.col("d") == 0), 0.0).otherwise(F.abs((F.col("value") - F.col("m")) / F.col("d")))
    held = e.join(stats, ["event_type", "shard"]).withColumn("z", z)
    state = F.when(F.max("z") >= 3, "ANOMALY").when(F.max("z") >= 2, "WATCH").otherwise("NORMAL")
    return held.groupBy("event_type", "shard").agg(F.count_if((F.col("z") >= 2) & (F.col("z") < 3)).alias("n_watch"), F.count_if(F.col("z") >= 3).alias("n_anomaly"), state.alias("state"))


@query(
    sql(LAST + """, h AS (SELECT shard, max(p99) AS p99, bool_or(down) AS down FROM (SELECT shard, quantile_cont(value, 0.99) AS p99, count(*) FILTER (event_type = 'error') * 2 > count(*) AS down FROM l WHERE n <= 256 GROUP BY shard, event_type) GROUP BY shard)
      SELECT shard, CASE WHEN down THEN 'FAILED' WHEN p99 > 1500 THEN 'DEGRADED' ELSE 'OK' END AS health FROM h""", "usage")
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAILED if any part is down (here: mostly errors), DEGRADED if any p99 is over 1,500, else OK."""
    parts = last_n(usage(spark, sf_dir)).groupBy("shard", "event_type").agg(F.percentile("value", F.lit(0.99)).alias("p99"), (F.count_if(F.col("event_type") == "error") * 2 > F.count("*")).alias("down"))
    return parts.groupBy("shard").agg(F.when(F.bool_or("down"), "FAILED").when(F.max("p99") > 1500, "DEGRADED").otherwise("OK").alias("health"))


@query(
    sql("""g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM usage),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(at_us)::BIGINT AS start_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""", "usage")
)
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends within an hour of the one before share a session, whose time to live each append renews."""
    held = usage(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min("at_us").alias("start_us"), F.count("*").alias("n"))
    return held.select("user_id", "start_us", "n")


@query(sql("SELECT event_id, row_number() OVER (PARTITION BY shard ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END DESC, at_us, event_id)::BIGINT AS place, (row_number() OVER (PARTITION BY shard ORDER BY at_us, event_id) - 1) % 3 AS replica FROM usage", "usage"))
def dispatch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by priority, then arrival; and their replica in turn."""
    priority = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    by_shard = Window.partitionBy("shard")
    return usage(spark, sf_dir).select("event_id", F.row_number().over(by_shard.orderBy(priority.desc(), "at_us", "event_id")).cast("long").alias("place"), ((F.row_number().over(by_shard.orderBy("at_us", "event_id")) - 1) % 3).cast("long").alias("replica"))


@query(sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM usage", "usage"))
def state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("version"))


@query(
    sql("""p AS (SELECT event_id, greatest((value % 100) / 100.0 / 0.8, (event_id % 100) / 100.0 / 0.9) AS o, event_id % 4 AS attempt FROM usage)
      SELECT event_id, CASE WHEN o >= 2 THEN 3 WHEN o >= 1.5 THEN 2 WHEN o >= 1 THEN 1 ELSE 0 END AS level, (50 * pow(2, attempt))::DOUBLE AS wait_ms FROM p""", "usage")
)
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usage(spark, sf_dir)
    return e.select("event_id", scoring.pressure((F.col("value") % 100) / 100.0, (F.col("event_id") % 100) / 100.0).alias("level"), scoring.backoff_ms(F.col("event_id") % 4).alias("wait_ms"))


@query(
    sql("""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS n FROM usage),
      w AS (SELECT user_id, n, event_id, at_us, 4.0::DOUBLE AS tokens, true AS ok FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.n, o.event_id, o.at_us, least(5.0, w.tokens + (o.at_us - w.at_us) / 1000000.0 / 3600.0)::DOUBLE - CASE WHEN least(5.0, w.tokens + (o.at_us - w.at_us) / 1000000.0 / 3600.0) >= 1 THEN 1 ELSE 0 END,
          least(5.0, w.tokens + (o.at_us - w.at_us) / 1000000.0 / 3600.0) >= 1 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
      SELECT event_id, ok FROM w""", "usage", recursive=True)
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a user's bucket (five tokens, one more an hour) lets pass, in order of arrival."""
    return sequential.token_bucket(usage(spark, sf_dir), "user_id", per_second=1 / 3600.0, burst=5.0)


@query()
def cache_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of an LRU cache with a time to live, by shard."""
    return sequential.cache_trace(usage(spark, sf_dir), "shard", F.col("user_id"), capacity=16, ttl_s=6 * 3600)


@query()
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a chain in which each entry's hash covers the one before."""
    return sequential.audit_chain(usage(spark, sf_dir))


def tampered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with some payloads altered and some links cut after it was made."""
    event = F.get_json_object("payload", "$.event").cast("long")
    chain = sequential.audit_chain(usage(spark, sf_dir)).withColumn("event", event)
    cut = F.when(F.col("event") % 89 == 7, F.lit(sequential.ZERO[:-1] + "1")).otherwise(F.col("prev_hash"))
    return chain.withColumn("payload", F.when(F.col("event") % 97 == 5, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).withColumn("prev_hash", cut).drop("event")


@query(sql("SELECT user_id, count(*)::BIGINT AS n_entries, count(*) FILTER (event_id % 97 = 5 OR event_id % 89 = 7)::BIGINT AS n_broken FROM usage GROUP BY user_id", "usage"))
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each user's chain, and those that were tampered with."""
    return sequential.verify_chain(tampered_chain(spark, sf_dir))


@query(sql("t AS (SELECT event_id, user_id, at_us FROM usage ORDER BY at_us DESC, event_id DESC LIMIT 50) SELECT row_number() OVER (ORDER BY at_us, event_id)::BIGINT AS seq, event_id, user_id FROM t", "usage"))
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty entries, oldest first."""
    last = usage(spark, sf_dir).orderBy(F.desc("at_us"), F.desc("event_id")).limit(50)
    return last.select(F.row_number().over(Window.orderBy("at_us", "event_id")).cast("long").alias("seq"), "event_id", "user_id")


@query("SELECT conv_id, count(*)::BIGINT AS n_turns, count(*) FILTER (role = 'user')::BIGINT AS n_user, sum(length(text))::BIGINT AS n_chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's ordered memory in figures."""
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role"))

