"""Operators whose next state needs the last: rate limits, cache traces and hash chains, by key."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = "0" * 64


def token_bucket(requests: DataFrame, key: str, per_second: float, burst: float) -> DataFrame:
    """(event_id, ok): a key's bucket starts full at its first request; a request takes one token or is refused.

    Rows of a key arrive in order within a partition (a sort that spills), and only one state
    is held at a time, so a hot key needs no more memory than a cold one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, tokens, last = None, 0.0, 0
        for frame in frames:
            passed = []
            for k, at in zip(frame[key].tolist(), frame["at_us"].tolist(), strict=True):
                tokens = burst if k != owner else min(burst, tokens + (at - last) / 1_000_000.0 * per_second)
                owner, last = k, at
                passed.append(tokens >= 1)
                tokens -= 1 if passed[-1] else 0
            yield pd.DataFrame({"event_id": frame["event_id"], "ok": passed})

    ordered = requests.select(key, "at_us", "event_id").repartition(key).sortWithinPartitions(key, "at_us", "event_id")
    return ordered.mapInPandas(run, "event_id long, ok boolean")


def cache_trace(requests: DataFrame, key: str, item: Column, capacity: int, ttl_s: float) -> DataFrame:
    """(key, hits, misses) of an LRU cache a key, whose entries also end after ``ttl_s``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cache, hits, misses = None, OrderedDict(), 0, 0
        out = []
        for frame in frames:
            for k, at, x in zip(frame[key].tolist(), frame["at_us"].tolist(), frame["item"].tolist(), strict=True):
                if k != owner:
                    if owner is not None:
                        out.append((owner, hits, misses))
                    owner, cache, hits, misses = k, OrderedDict(), 0, 0
                if x in cache and at - cache[x] <= ttl_s * 1_000_000:
                    hits += 1
                    cache.move_to_end(x)
                    continue
                misses += 1
                cache.pop(x, None)
                cache[x] = at
                if len(cache) > capacity:
                    cache.popitem(last=False)
        if owner is not None:
            out.append((owner, hits, misses))
        yield pd.DataFrame(out, columns=[key, "hits", "misses"])

    ordered = requests.select(key, "at_us", "event_id", item.alias("item")).repartition(key).sortWithinPartitions(key, "at_us", "event_id")
    return ordered.mapInPandas(run, f"{key} long, hits long, misses long")


def _link(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


def audit_chain(events: DataFrame) -> DataFrame:
    """(user_id, seq, payload, prev_hash, hash): one append-only chain a tenant."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, seq, last = None, 0, ZERO
        for frame in frames:
            rows = []
            for user, payload in zip(frame["user_id"].tolist(), frame["payload"].tolist(), strict=True):
                if user != owner:
                    owner, seq, last = user, 0, ZERO
                own = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
                rows.append((user, seq, payload, last, own))
                seq, last = seq + 1, own
            yield pd.DataFrame(rows, columns=["user_id", "seq", "payload", "prev_hash", "hash"])

    payload = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"), F.col("at_us").alias("ts")))
    ordered = events.select("user_id", "at_us", "event_id", payload.alias("payload")).repartition("user_id").sortWithinPartitions("user_id", "at_us", "event_id")
    return ordered.mapInPandas(run, "user_id long, seq long, payload string, prev_hash string, hash string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Entries of each chain whose link or hash is wrong; each is checked by itself, from the entry before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("user_id").orderBy("seq")), F.lit(ZERO))
    wrong = (F.col("prev_hash") != F.col("before")) | (F.col("hash") != _link(F.col("prev_hash"), F.col("payload")))
    return chain.withColumn("before", before).groupBy("user_id").agg(F.count("*").alias("n_entries"), F.count_if(wrong).alias("n_broken"))
