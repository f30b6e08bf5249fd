"""Parents, roots, suggestions and address matches, as equal-key joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normal_url


def parent_chain(units: DataFrame, parents: DataFrame, hops: int = 5) -> DataFrame:
    """(unit_id, hop, name, kind) innermost first; a parent that is no unit is ``unknown`` and ends the chain."""
    known = parents.select(F.col("qualified_name").alias("_q"), F.col("kind").alias("_kind"), F.col("parent_qualified_name").alias("_up"))
    here = units.filter("parent_qualified_name is not null").select("unit_id", F.col("parent_qualified_name").alias("name"))
    out = None
    for hop in range(1, hops + 1):
        met = here.join(known, F.col("name") == F.col("_q"), "left")
        rows = met.select("unit_id", F.lit(hop).cast("long").alias("hop"), "name", F.coalesce("_kind", F.lit("unknown")).alias("kind"))
        out = rows if out is None else out.union(rows)
        here = met.filter("_up is not null").select("unit_id", F.col("_up").alias("name"))
    return out


def folders(path: Column) -> Column:
    """All leading folders of a path, the path itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, repo_id): the root that is the longest leading folder of each path, by equality on its folders."""
    met = paths.select("path", F.explode(folders(F.col("path"))).alias("root")).join(roots, "root")
    return met.groupBy("path").agg(F.max_by("repo_id", F.struct(F.length("root"), "repo_id")).alias("repo_id"))


def suggestions(units: DataFrame, asked: list[str], k: int = 5) -> DataFrame:
    """(asked, qualified_name): names that hold a stated name's whole text, whatever its case; if none does, its last dotted part.

    Each name is held against the stated few as it is read: no join, and nothing is made of names that fit none.
    """
    names = F.array(*map(F.lit, asked)).cast("array<string>")
    part = lambda a: F.substring_index(a, ".", -1)
    fits = lambda a: F.contains(F.lower("qualified_name"), F.lower(a))
    near = F.filter(names, lambda a: (part(a) != "") & fits(part(a)))  # the whole text fits only where its last part does
    met = units.select("qualified_name", F.explode(near).alias("asked")).withColumn("whole", fits(F.col("asked")))
    order = Window.partitionBy("asked").orderBy(F.desc("whole"), F.length("qualified_name"), "qualified_name")
    first = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    best = first.filter("n = 1").select("asked", F.col("whole").alias("any_whole"))
    return first.join(best, "asked").filter("whole = any_whole").select("asked", "qualified_name")


def best_by_id(entries: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Of rows with one id, that of the highest score; the first of equals."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("row")).select(key, "row.*")


def match_urls(pushed: DataFrame, registry: DataFrame) -> DataFrame:
    """(url, repo_id): the first registered repository whose address equals the pushed one or ends in it, or the reverse."""
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    a = pushed.select("url", normal_url(F.col("url")).alias("whole"))
    b = registry.select("repo_id", normal_url(F.col("remote_url")).alias("known"))
    forward = a.select("url", F.explode(tails(F.col("whole"))).alias("known")).join(b, "known").select("url", "repo_id")
    back = b.select("repo_id", F.explode(tails(F.col("known"))).alias("whole")).join(a, "whole").select("url", "repo_id")
    return forward.union(back).groupBy("url").agg(F.min("repo_id").alias("repo_id"))


def sorted_digests(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, snapshot, n): SHA-256 over each key's records, in order and a line each, and its number of rows.

    Rows come sorted, by Spark's sort that spills, and run through the hash, so no key's records are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], [key, "snapshot", "n"])

        now, state, n, held = None, None, 0, 0
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, run_of_key in groupby(pairs, key=itemgetter(0)):
                if state is None or k != now:
                    if state is not None:
                        yield result()
                    now, state, n, held = k, hashlib.sha256(), 0, 0
                every = [line for _, line in run_of_key]
                n += len(every)
                if lines := [line for line in every if line is not None]:
                    state.update(("\n" * (held > 0) + "\n".join(lines)).encode())
                    held += len(lines)
        if state is not None:
            yield result()

    own = df.select(F.col(key).cast("string").alias(key), record)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that few rows are not joined into one task
    return own.repartition(n, key).sortWithinPartitions(key, record).mapInArrow(run, f"{key} string, snapshot string, n long")
