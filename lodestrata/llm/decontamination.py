"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, in lower case. Every run of ``seed`` words of a benchmark item is
a seed (an item of fewer words is one seed by itself); documents' rolling seeds are looked up among them. An
item is a document's candidate if shared seeds cover enough of it, which bounds what tiles can cover. For
candidates, the words under shared seeds are tiled: the longest match is found by Karp-Rabin hashes of all
free runs of a length, with bisection over lengths; matches of that length are marked where they do not overlap
what is marked, and the search goes on with shorter ones down to ``seed``. The share of the item's words under
tiles is its coverage, whatever the order of the passages. A document is contaminated if an item's coverage
reaches ``threshold``.

The benchmark goes to the tasks in slices of at most ``SLICE_WORDS`` words, each slice a pass over the documents,
so what the driver holds and sends stays bounded however large the benchmark is. Items of equal words are tiled once.

Defined results: null or empty texts have no words and are clean; items without words match nothing; an item of fewer
words than ``seed`` matches where all of it occurs; equal coverages go to the smaller item_id, null last; items that
share an id or have none are judged each by itself, and so is every row of ``docs``; an empty benchmark leaves
every document clean; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import MULTIPLIERS, inside, mix, slices, text_words, windows
from .shared import settle

SLICE_WORDS = 2_000_000
RESULT = "doc_id long, n_words long, n_items long, item_id long, coverage double"


class Running:
    """Karp-Rabin hashes of all runs of any length, from running sums."""

    def __init__(self, words: np.ndarray):
        n, m = words.size, MULTIPLIERS[0]
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), m, np.uint64)]), dtype=np.uint64)[:n]
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), pow(m, -1, 2**64), np.uint64)]), dtype=np.uint64)[:n]
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)])
        self.free = np.ones(n, bool)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of k words that are free."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[k:] == taken[:-k])
        return at, mix((self.total[at + k] - self.total[at]) * self.back[at])


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of non-overlapping matches, longest first, then by place."""
    own, other, found = Running(doc), Running(item), []

    def common(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (at_d, key_d), (at_i, key_i) = own.runs(k), other.runs(k)
        both = np.isin(key_d, key_i)
        return at_d[both], key_d[both], at_i, key_i

    length = min(doc.size, item.size)
    while length >= least:
        low, high = least - 1, length
        while low < high:  # the longest length with a common free run
            mid = (low + high + 1) // 2
            if common(mid)[0].size:
                low = mid
            else:
                high = mid - 1
        length = low
        if length < least:
            break
        at_d, key_d, at_i, key_i = common(length)
        order = np.argsort(key_i, kind="stable")
        places, ordered = at_i[order], key_i[order]
        first, last = np.searchsorted(ordered, key_d), np.searchsorted(ordered, key_d, "right")
        nexts: dict[int, int] = {}  # for each run of the item, the first place that may be free still
        end = 0
        for p, lo, hi in zip(at_d.tolist(), first.tolist(), last.tolist(), strict=True):
            if p < end:
                continue
            at = nexts.get(lo, lo)
            while at < hi and not (other.free[places[at]] and other.free[places[at] + length - 1]):
                at += 1
            nexts[lo] = at
            if at < hi and np.array_equal(doc[p : p + length], item[places[at] : places[at] + length]):
                q = int(places[at])
                own.free[p : p + length] = other.free[q : q + length] = False
                found.append((p, q, length))
                end = p + length
        length -= 1
    return found


class Seeds:
    """A slice of the benchmark: its distinct items, and for each length of seed the seeds in hash order."""

    def __init__(self, ids: list[int | None], items: list[np.ndarray], seed: int):
        equal: dict[bytes, list[int]] = {}
        for i, words in enumerate(items):
            if words.size:
                equal.setdefault(words.tobytes(), []).append(i)
        groups = list(equal.values())
        self.items = [items[g[0]] for g in groups]
        self.count = np.array([len(g) for g in groups], np.int64)
        self.ids = [min((ids[i] for i in g), key=_null_last) for g in groups]
        self.sizes = np.array([x.size for x in self.items], np.int64)
        self.by_length = []
        for length in np.unique(np.minimum(self.sizes, seed)).tolist():
            own = np.flatnonzero(np.minimum(self.sizes, seed) == length)
            keys = [windows(self.items[i], length) for i in own.tolist()]
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            place = np.concatenate([np.arange(k.size) for k in keys])
            self.by_length.append((length, flat[order], np.repeat(own, [k.size for k in keys])[order], place[order]))

    def candidates(self, keys: np.ndarray, seeds: tuple, threshold: float) -> np.ndarray:
        """Items of which shared seeds cover enough; ``keys`` are a document's distinct ones that are seeds."""
        length, known, item, place = seeds
        lo, hi = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
        own, where = item[at], place[at]
        order = np.lexsort((where, own))
        own, where = own[order], where[order]
        step = np.full(own.size, length)
        step[:-1] = np.where(own[1:] == own[:-1], np.minimum(where[1:] - where[:-1], length), length)
        covered = np.bincount(own, step, minlength=self.sizes.size)
        return np.flatnonzero((covered > 0) & (covered >= threshold * self.sizes - 1e-9))

    def coverage(self, words: np.ndarray, threshold: float, at: np.ndarray, keys: np.ndarray, seeds: tuple) -> list[tuple[float, int]]:
        """(coverage, item) of the items that reach the threshold; the runs of ``words`` at ``at`` are seeds, with ``keys``."""
        length, known, item, _ = seeds
        out = []
        for i in self.candidates(np.unique(keys), seeds, threshold).tolist():
            starts = at[np.isin(keys, windows(self.items[i], length))]
            under = np.zeros(words.size + 1, np.int64)
            under[starts] += 1
            under[starts + length] -= 1
            # Each run of words under seeds, with a word between that is in no item.
            runs = np.flatnonzero(np.cumsum(under)[:-1] > 0)
            gaps = np.flatnonzero(np.diff(runs) > 1) + 1
            text = np.insert(words[runs], gaps, np.arange(gaps.size, dtype=np.uint64))
            share = sum(k for _, _, k in tiles(text, self.items[i], length)) / self.items[i].size
            if share >= threshold - 1e-12:
                out.append((share, i))
        return out


def _null_last(x: int | None) -> tuple[bool, int]:
    return x is None, x or 0


def _found(seeds: Seeds, texts: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, list[int | None], np.ndarray]:
    """(words, items that reach the threshold, the best one, its coverage) of each text."""
    bounds, words = text_words(texts, lower=True, loose=True)
    found: dict[int, list[tuple[float, int]]] = {}
    for own in seeds.by_length:
        length, known = own[0], own[1]
        keys = windows(words, length)
        if not keys.size:
            continue
        hit = inside(bounds, length) & (known[np.minimum(np.searchsorted(known, keys), known.size - 1)] == keys)
        at = np.flatnonzero(hit)
        cuts = np.searchsorted(at, bounds)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            mine = at[cuts[d] : cuts[d + 1]]
            found.setdefault(d, []).extend(seeds.coverage(words[bounds[d] : bounds[d + 1]], threshold, mine - bounds[d], keys[mine], own))
    items, best, share = np.zeros(len(texts), np.int64), [None] * len(texts), np.zeros(len(texts))
    for d, reached in found.items():
        if reached:
            items[d] = seeds.count[[i for _, i in reached]].sum()
            share[d], best[d] = min(((s, seeds.ids[i]) for s, i in reached), key=lambda x: (-x[0], _null_last(x[1])))
    return np.diff(bounds), items, best, share


def _scan(seeds: Seeds, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, items, best, share = _found(seeds, batch.column(1), threshold)
            columns = [batch.column(0), pa.array(n_words), pa.array(items), pa.array(best, pa.int64()), pa.array(share)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], ["doc_id", "n_words", "n_items", "item_id", "coverage", *batch.schema.names[2:]])

    return run


def _clean(seeds: Seeds, threshold: float) -> Callable:
    """The rows of a batch, with all their columns, that no item of the slice covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items = _found(seeds, batch.column(batch.schema.get_field_index("text")), threshold)[1]
            yield batch.filter(pa.array(items == 0))

    return run


def benchmark_slices(benchmark: DataFrame, seed: int) -> Iterator[Seeds]:
    """The benchmark, read row by row on the driver, in slices of bounded size; one at least."""
    ids, items, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        _, words = text_words(pa.array([row["text"]], pa.string()), lower=True, loose=True)
        if size and size + words.size > SLICE_WORDS:
            yield Seeds(ids, items, seed)
            ids, items, size = [], [], 0
        ids.append(row["item_id"])
        items.append(words)
        size += words.size
    yield Seeds(ids, items, seed)


def _by_slice(docs: DataFrame, benchmark: DataFrame, seed: int, one: Callable, each: Callable) -> tuple[DataFrame | None, DataFrame | None]:
    """With a single slice, (``one`` of it, None); else (rows of ``docs`` with a key _row, the union of ``each`` of them and a slice).

    Each slice's result is written before the next slice is read.
    """
    parts = benchmark_slices(benchmark, seed)
    first, second = next(parts), next(parts, None)
    if second is None:
        return one(first), None
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = [settle(each(rows, first), "slice")]
    while second is not None:
        found.append(settle(each(rows, second), "slice"))
        second = next(parts, None)
    return rows, reduce(DataFrame.union, found)


def coverage(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_items, item_id, coverage (0 below the threshold) and contaminated, a row a document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = lambda s: texts.mapInArrow(_scan(s, threshold), RESULT)
    each = lambda rows, s: rows.mapInArrow(_scan(s, threshold), RESULT + ", _row long")
    found, parts = _by_slice(texts, benchmark, seed, one, each)
    if parts is not None:
        best = F.max(F.struct("coverage", -F.col("item_id"))).alias("best")
        found = parts.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n_items").alias("n_items"), best).select("doc_id", "n_words", "n_items", (-F.col("best.col2")).alias("item_id"), F.col("best.coverage").alias("coverage"))
    return found.withColumn("contaminated", F.col("n_items") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that no item covers, with all their columns; each row by itself, whatever its id."""

    def each(rows: DataFrame, part: Seeds) -> DataFrame:
        texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_row")
        return texts.mapInArrow(_scan(part, threshold), RESULT + ", _row long").filter("n_items > 0").select("_row")

    rows, dirty = _by_slice(docs, benchmark, seed, lambda s: docs.mapInArrow(_clean(s, threshold), docs.schema), each)
    return rows if dirty is None else rows.join(dirty, "_row", "left_anti").select(*docs.columns)
