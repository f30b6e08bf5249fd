"""Snapshots of a whole state: a digest of each component, and where two states differ.

A component's records are dealt out by the first hex digits of their keys' MD5, the same ranges in every state; a
range's sorted records run through one hash in a task, and the component's hash is over its ranges' digests in
order. So a component may be of any size, no task holds more than a batch of it, and of two states that differ the
ranges say where. The snapshot's id is over the hashes of all components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .navigation import sorted_digests

#: Hex digits that name a range: 256 ranges, whatever the state's size; more for larger ones.
DIGITS = 2


def ranges(records: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(part, digest, n) of ``records`` (key, record): a row a range that has records."""
    part = F.substring(F.md5("key"), 1, digits)
    return sorted_digests(records.select(part.alias("part"), "record"), "part", "record").withColumnRenamed("snapshot", "digest")


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by id, with kind and name; edges by source."""
    line = lambda mark, *names: F.concat_ws("\t", F.lit(mark), *[F.coalesce(n, F.lit("")) for n in names])
    own = nodes.select(F.col("node_id").alias("key"), line("node", "node_id", "kind", "qualified_name").alias("record"))
    return own.union(edges.select(F.col("src_id").alias("key"), line("edge", "src_id", "kind", "dst_id").alias("record")))


@F.pandas_udf(StringType())
def _digest(vectors: pd.Series) -> pd.Series:
    def one(vector: Iterable[float] | None) -> str | None:
        return None if vector is None else hashlib.sha256(",".join(["%.6f" % x for x in vector]).encode()).hexdigest()

    return vectors.map(one, na_action=None)


def vector_digest(vector: Column) -> Column:
    """SHA-256 of the components with six decimals, joined by commas; nulls are left out.

    What lies half-way between two decimals goes to the even one, as C prints it; ``format_string`` would round it up.
    """
    return _digest(F.filter(vector.cast("array<double>"), lambda x: x.isNotNull()))


def vector_records(vectors: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    own = F.col(key).cast("string")
    return vectors.select(own.alias("key"), F.concat_ws("\t", own, vector_digest(F.col(vector))).alias("record"), *more)


def _listed(pairs: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(pairs), "\n"), 256)


def settings_hash(settings: Mapping[str, object]) -> Column:
    """Of a few named values."""
    return _listed(F.array(*[F.lit(f"{name}={value}") for name, value in settings.items()]))


def rows_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(hash) over the rows of a small table, such as a list of tools or states."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.agg(_listed(F.collect_list(line)).alias("hash"))


def snapshot(parts: Mapping[str, DataFrame], fixed: Mapping[str, Column], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(component, hash): a row a component and one ``snapshot_id`` over them.

    ``parts`` are ranges of large components, ``fixed`` hashes of settings, ``tables`` one-row hashes.
    """
    spark = next(iter(parts.values())).sparkSession
    one = spark.range(1)
    rows = [one.select(F.lit(name).alias("component"), value.alias("hash")) for name, value in fixed.items()]
    rows += [table.select(F.lit(name).alias("component"), "hash") for name, table in tables.items()]
    for name, found in parts.items():
        digests = F.collect_list(F.concat_ws(":", "part", "digest"))  # a line a range, as many as DIGITS allow
        rows.append(found.agg(_listed(digests).alias("hash")).select(F.lit(name).alias("component"), "hash"))
    every = rows[0]
    for row in rows[1:]:
        every = every.union(row)
    whole = every.agg(_listed(F.collect_list(F.concat_ws("=", "component", "hash"))).alias("hash"))
    return every.union(whole.select(F.lit("snapshot_id").alias("component"), "hash"))


def replayed(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(component, expected, actual, matches) of two snapshots; a component that one lacks does not match."""
    named = [df.select("component", F.col("hash").alias(name)) for df, name in ((expected, "expected"), (actual, "actual"))]
    both = named[0].join(named[1], "component", "full_outer")
    return both.withColumn("matches", F.col("expected").eqNullSafe(F.col("actual")))


def differing(records: DataFrame) -> DataFrame:
    """(part, before, after): the ranges of a component that two states do not share, with their numbers of records.

    ``records`` has key, record and the booleans before and after: which states hold the record; one that both hold may
    be a row or two. Whether a range is the same needs no order, so nothing is sorted or dealt out: the records of each
    state are summed as two 64-bit hashes, halves apart, and only a row a range and task is shuffled.
    """
    hashes = {f"h{i}{half}": piece for i in (0, 1) for half, piece in (("low", F.col(f"h{i}").bitwiseAND(0xFFFFFFFF)), ("high", F.shiftrightunsigned(f"h{i}", 32)))}
    own = records.select(F.substring(F.md5("key"), 1, DIGITS).alias("part"), "before", "after", F.xxhash64("record").alias("h0"), F.xxhash64(F.lit("second"), "record").alias("h1"))
    sums = [F.coalesce(F.sum(F.when(F.col(state), piece)), F.lit(0)).alias(f"{state}_{name}") for state in ("before", "after") for name, piece in hashes.items()]
    summed = own.groupBy("part").agg(*[F.count_if(state).alias(state) for state in ("before", "after")], *sums)
    state = lambda name: F.struct(F.col(name).alias("n"), *[F.col(f"{name}_{h}").alias(h) for h in hashes])
    return summed.filter(state("before") != state("after")).select("part", "before", "after")
