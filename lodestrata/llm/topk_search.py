"""Exact top-k inner-product search in three phases with a uniform threshold.

A vector's components are dealt into ``LISTS`` lists, which are kept apart: a row of the index is one list of
one block of vectors. A score is the sum of a part from each list. Queries travel in blocks too.

1. Every list gives the ``LOCAL * k`` best parts of each query and its least part, its floor. The candidates so
   found are scored whole; the k-th best of their scores is a score that k candidates reach: the cutoff.
2. Cutoffs go out. If a score reaches the cutoff, at least one of its parts is no less than its list's floor
   plus an equal share of (cutoff - sum of the floors). Every list sends its entries from there on, and no others.
3. Entries of a block of vectors and a block of queries meet; the parts that other lists did not send are looked up
   for these candidates alone, and sums that reach the cutoff go to the final ranking.

Parts are integers: products of floor(scale * x). They are exact in doubles while they stay under 2**53, which
each block checks by its largest numbers; else integer arithmetic is used.

Defined results: vectors that are null, hold nulls or non-finite numbers, or have another length than most (the
least of the most frequent lengths) take no part; null ids take no part; equal scores go to the smaller id; a query
with fewer candidates than k gets them all; of rows that share an id each is a query and a candidate of its own; a
score that 64 bits cannot hold raises an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, settle

LISTS = 2
LOCAL = 2
BLOCK, ASKED = 4096, 512
LOCAL_PARTS = "q_key long, list int, key long, part long, floor long"
ENTRIES = "q_block long, block long, list int, n long, cell binary"
SCORES = "q_key long, query_id long, key long, vec_id long, score long"


def usable(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(key, vec_id, vector) with whole-number components of vectors that can take part; keys are distinct."""
    vector = F.col("embedding").cast("array<double>")
    # From 2**53 on doubles are whole numbers, which a 64-bit floor may not hold.
    whole = F.transform(vector, lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), whole.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good & (F.size("embedding") > 0)).select("vec_id", "vector")
    usual = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    kept = kept.join(usual, F.size("vector") == F.col("d"), "left_semi")
    if kept.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return kept.select(F.col("vec_id").alias("key"), "vec_id", "vector")
    return settle(kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "vector"), "vectors")


# Blocks


def _cells(vectors: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, after two letters that say which."""
    largest = np.abs(vectors).max(initial=0)
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"
    return kind[1:].encode() + vectors.astype(kind).tobytes()


def _matrix(cell: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cell, "<" + cell[:2].decode(), offset=2).reshape(rows, -1)


def _block(count: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(count))


def lists(vectors: DataFrame, count: int, side: str) -> DataFrame:
    """(block, list, keys, ids, cells): the lists of ``count`` blocks of vectors, each in ascending id and key."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("key", "ascending")])
        keys, ids = (np.asarray(table.column(c), dtype="<i8") for c in ("key", "vec_id"))
        whole = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(ids.size, -1)
        cuts = np.linspace(0, whole.shape[1], LISTS + 1).astype(int)
        cells = [_cells(whole[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        block = [table.column("block")[0].as_py()] * LISTS
        columns = {"block": pa.array(block, pa.int64()), "list": pa.array(range(LISTS), pa.int32()), "keys": pa.array([keys.tobytes()] * LISTS), "ids": pa.array([ids.tobytes()] * LISTS), "cells": pa.array(cells, pa.binary())}
        return pa.table(columns)

    found = vectors.withColumn("block", _block(count)).groupBy("block").applyInArrow(run, "block long, list int, keys binary, ids binary, cells binary")
    return found.withColumnsRenamed({c: side + c for c in ("block", "keys", "ids", "cells")})


def _ids(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<i8")


def _parts(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The inner products of all queries with all rows, exact."""
    return _exact(queries, rows, lambda q, x: q @ x.T)


def _exact(left: np.ndarray, right: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    a, b = left.astype(np.float64), right.astype(np.float64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**53:
        return product(a, b).astype(np.int64)
    if most >= 2**62 and float(np.abs(product(a, b)).max(initial=0)) >= 2**62:
        raise OverflowError("an inner product is too large for 64 bits")
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) >= 2**63:
        raise OverflowError("a component is too large for 64 bits")
    return product(left.astype(np.int64), right.astype(np.int64))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in descending order; equal scores by place."""
    if scores.size > k:
        edge = np.partition(scores, scores.size - k)[scores.size - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        keep = np.concatenate([above, level[: k - above.size]])
    else:
        keep = np.arange(scores.size)
    return keep[np.lexsort((keep, -scores[keep]))]


# Phase 1


def _local(most: int) -> Callable:
    """Rows of one list of a query block and a vector block in; the best parts of each query and the least one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_keys, keys = _ids(row["q_keys"]), _ids(row["keys"])
                parts = _parts(_matrix(row["q_cells"], q_keys.size), _matrix(row["cells"], keys.size))
                out = []
                for i in range(q_keys.size):
                    own = np.flatnonzero(keys != q_keys[i])
                    if own.size:
                        part = parts[i, own]
                        pick = _best(part, most)
                        out.append(np.stack([np.full(pick.size, q_keys[i]), keys[own[pick]], part[pick], np.full(pick.size, part.min())]))
                q, key, part, floor = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(q.size, row["list"]), pa.int32()), pa.array(key), pa.array(part), pa.array(floor)], ["q_key", "list", "key", "part", "floor"])

    return run


def cutoffs(spread: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q_key, list, cutoff, least): the score to reach, and the part from which a list's entries are sufficient."""
    local = settle(spread.mapInArrow(_local(LOCAL * k), LOCAL_PARTS), "local")
    order = Window.partitionBy("q_key", "list").orderBy(F.desc("part"), "key")
    heads = local.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= LOCAL * k).select("q_key", "key").distinct()
    score = F.aggregate(F.zip_with("vector", "q_vector", lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = heads.join(vectors.select("key", "vector"), "key").join(asked.select(F.col("key").alias("q_key"), F.col("vector").alias("q_vector")), "q_key").select("q_key", score.alias("score"))
    best = Window.partitionBy("q_key").orderBy(F.desc("score"))
    kth = whole.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("q_key", F.col("score").alias("cutoff"))
    floors = local.groupBy("q_key", "list").agg(F.min("floor").alias("floor"))
    everything = floors.groupBy("q_key").agg(F.sum("floor").alias("floors"))
    # With fewer than k candidates the cutoff is the least that a score can be.
    goal = everything.join(kth, "q_key", "left").withColumn("cutoff", F.coalesce("cutoff", "floors"))
    least = F.expr(f"floor + (cutoff - floors) div {LISTS}")  # no score is under the sum of the floors
    return floors.join(goal, "q_key").select("q_key", "list", "cutoff", least.alias("least"))


def _attach(left: pa.Table, right: pa.Table) -> pa.Table:
    """A list of a query block with the cutoffs and least parts of its queries, in their order. Queries without candidates get none."""
    keys = _ids(left.column("q_keys")[0].as_py())
    order = np.argsort(keys)
    at = order[np.searchsorted(keys[order], np.asarray(right.column("q_key")))]
    for name in ("cutoff", "least"):
        line = np.full(keys.size, np.iinfo(np.int64).max, "<i8")
        line[at] = np.asarray(right.column(name))
        left = left.append_column(name, pa.array([line.tobytes()], pa.binary()))
    return left


# Phases 2 and 3


def _sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one list in; its entries from the least part on, as one cell of (query, row, part) arrays."""
    for batch in batches:
        for row in batch.to_pylist():
            q_keys, keys = _ids(row["q_keys"]), _ids(row["keys"])
            parts = _parts(_matrix(row["q_cells"], q_keys.size), _matrix(row["cells"], keys.size))
            q, x = np.nonzero((parts >= _ids(row["least"])[:, None]) & (q_keys[:, None] != keys[None, :]))
            cell = q.astype("<u4").tobytes() + x.astype("<u4").tobytes() + parts[q, x].astype("<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{"q_block": row["q_block"], "block": row["block"], "list": row["list"], "n": q.size, "cell": cell}], schema=_ENTRIES)


_ENTRIES = pa.schema([("q_block", pa.int64()), ("block", pa.int64()), ("list", pa.int32()), ("n", pa.int64()), ("cell", pa.binary())])


def _resolve(k: int) -> Callable:
    """The entries of a query block and a vector block in, and their lists; the k best whole scores of each query out."""

    def run(entries: pa.Table, both: pa.Table) -> pa.Table:
        rows = sorted(both.to_pylist(), key=lambda r: r["list"])
        sent = {r["list"]: (r["n"], r["cell"]) for r in entries.to_pylist()}
        head = rows[0]
        q_keys, q_ids, keys, ids, cutoff = (_ids(head[c]) for c in ("q_keys", "q_ids", "keys", "ids", "cutoff"))
        known = []
        for r in rows:
            n, cell = sent[r["list"]]
            q, x = np.frombuffer(cell, "<u4", 2 * n).reshape(2, n).astype(np.int64)
            known.append((q * keys.size + x, np.frombuffer(cell, "<i8", n, 8 * n)))
        pairs = np.unique(np.concatenate([p for p, _ in known]))
        q, x = np.divmod(pairs, keys.size)
        score = np.zeros(pairs.size, np.int64)
        for r, (own, part) in zip(rows, known, strict=True):  # entries ascend by query and row
            at = np.minimum(np.searchsorted(own, pairs), max(own.size - 1, 0))
            has = own[at] == pairs if own.size else np.zeros(pairs.size, bool)
            score[has] += part[at[has]]
            left, right = _matrix(r["q_cells"], q_keys.size), _matrix(r["cells"], keys.size)
            need = np.flatnonzero(~has)
            for cut in range(0, need.size, 1 << 16):
                some = need[cut : cut + (1 << 16)]
                score[some] += _exact(left[q[some]], right[x[some]], lambda a, b: (a * b).sum(axis=1))
        keep = score >= cutoff[q]
        q, x, score = q[keep], x[keep], score[keep]
        ends = np.searchsorted(q, np.arange(q_keys.size + 1))
        pick = np.concatenate([np.zeros(0, np.int64), *(a + _best(score[a:b], k) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))])
        q, x, score = q[pick], x[pick], score[pick]
        return pa.table({"q_key": pa.array(q_keys[q]), "query_id": pa.array(q_ids[q]), "key": pa.array(keys[x]), "vec_id": pa.array(ids[x]), "score": pa.array(score)})

    return run


def phases(embeddings: DataFrame, k: int, every: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """The entries of phase 2 (a row for each list and two blocks, n of them), and the scores of phase 3."""
    vectors = usable(embeddings, scale)
    asked = vectors.filter(F.col("vec_id") % every == 0)
    count, q_count = (max(1, round(df.count() / size)) for df, size in ((vectors, BLOCK), (asked, ASKED)))
    rows = settle(lists(vectors, count, ""), "lists").repartition(partitions(embeddings.sparkSession), "block", "list")
    asks = settle(lists(asked, q_count, "q_"), "queries")
    # The stated query set against all rows, block by block.
    spread = rows.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_count - 1).cast("long"))))
    goals = settle(cutoffs(spread.join(asks, ["q_block", "list"]), vectors, asked, k), "cutoffs")
    placed = goals.withColumn("q_block", F.pmod(F.xxhash64("q_key"), F.lit(q_count)))
    ready = asks.groupBy("q_block", "list").cogroup(placed.groupBy("q_block", "list")).applyInArrow(_attach, "q_block long, list int, q_keys binary, q_ids binary, q_cells binary, cutoff binary, least binary")
    both = spread.join(settle(ready, "queries"), ["q_block", "list"])
    entries = settle(both.mapInArrow(_sufficient, ENTRIES), "entries")
    keys = ["q_block", "block"]
    return entries, entries.groupBy(*keys).cogroup(both.groupBy(*keys)).applyInArrow(_resolve(k), SCORES)


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row whose id is a multiple of ``every``."""
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id", "key")
    ranked = phases(embeddings, k, every, scale)[1].withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
