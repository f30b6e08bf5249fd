"""Exact Jaccard self-join over word n-grams: size-banded tiles with hashed bitmap signatures.

A document is the sorted set of 64-bit hashes of its distinct n-grams. Equal sets are one class, known
by a 128-bit digest; only its representative, the row of least key, goes on.

Tiles. Sets whose sizes lie in one band differ in at most ``d`` values if they link. Within a band the values
are dealt by hash into ``m`` segments, about a third more than ``d + 1``; each value that differs touches one
segment, so linked sets have at least ``m - d`` equal segments. A segment's digest with its number and band is a
key. With keys ordered by how many documents hold them, linked sets share one of the first ``d + 1`` of each, the
rarest. Most documents have that many keys that nobody else holds and are done; the rest meet in tiles, one for
each key that several still hold. A set that leaves so many segments empty that they would count among its first
keys goes by the first ``n - ceil(t * n) + 1`` values in hash order too, in that band.

Bounds. A bitmap holds, for each bit, the parity of the values that hash to it: bits that differ between two
bitmaps count values that only one set has, so bit counts bound the overlap from above. Pairs that
the bound leaves are held against each other by exact sorted-array intersection of their sets.

What is asked for are the classes that links join, so a pair already joined needs no look:

1. Each member of a tile is held against the tile's middle, the member with most shared keys.
2. Tiles whose members are still in several components are gone through by bitmaps, and each component's nearest
   pair with another is verified.
3. What is still apart goes through bitmaps again, now for every pair whose bound passes, each in the first tile that it shares.
   The rows that have such pairs meet with their sets, and the pairs are made, tested and dropped within the
   task; only links that join components leave it.

A link between two documents is thus verified in step 3, or its ends are joined by verified links before. What is
written grows with the members of tiles, also where many sets are near each other and none link.

In steps 2 and 3 members of the component with most rows in a tile never meet each other, and larger tiles are cut
into blocks of ``BLOCK`` rows or ``BLOCK_WORDS`` words, each two of them a task's share, so no group gathers whole. Keys travel packed, one
posting a batch for a key that a batch holds often. The numbers of buckets and cells follow those of words and rows.

Defined results: null, empty and blank texts have no set (size 0) and link with nothing; with fewer words
than ``n`` the whole sequence is the one n-gram; copies link; rows of null or repeated ids are linked each by itself,
and a component's id is the least id in it, null if it has none; extra columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, slices, text_words, windows
from .postings import distinct, meeting, pack, pack_places, unpack, unpack_places
from .shared import keyed, partitions, settle

BLOCK, BLOCK_WORDS = 2048, 2_000_000
BUCKET_WORDS, CELL_ROWS = 4_000_000, 20_000
SIGNATURE = "doc_id long, n long, d1 long, d2 long"
SETS = "doc_id long, n long, bits binary, hashes binary"
#: In the place of a posting, the band has eight bits; the upper half of them are for values in hash order.
BY_VALUE = 128


def _least_overlap(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)"""
    return -(-percent * n // 100)


def sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    bounds, hashes = text_words(texts, lower=True)
    grams = windows(hashes, words)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(grams[a : b - words + 1])
            keep = np.ones(x.size, bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:  # the whole sequence; its length keeps it apart from longer grams
            x = hashes[a:b]
            out.append(mix(np.array([np.sum(mix(x * np.uint64(2) + np.arange(b - a, dtype=np.uint64)), dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digests(own: list[np.ndarray], mixed: int) -> np.ndarray:
    """A 64-bit sum over each set; ``mixed`` times mixed values."""
    flat = np.concatenate([np.zeros(0, np.uint64), *own])
    for _ in range(mixed):
        flat = mix(flat)
    total = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
    ends = np.cumsum([x.size for x in own], dtype=np.int64)
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if own else np.zeros(0, np.uint64)


# Bands and segments


def _ladder() -> np.ndarray:
    """The d of each band: in how many values its linked sets differ at most."""
    steps = [0]
    while steps[-1] < 2**40:
        steps.append(max(steps[-1] + 1, steps[-1] * 3 // 2))
    return np.array(steps, np.int64)


LADDER = _ladder()
SEGMENTS = (4 * (LADDER + 1) + 2) // 3


def most_differ(n: np.ndarray | int, percent: int):
    """In how many values a set of size n and one as large or larger differ at most if they link."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def bands(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last band of a set: those of all sizes from percent * n to n, the smaller one's of a pair."""
    return tuple(np.searchsorted(LADDER, most_differ(k, percent)) for k in (_least_overlap(n, percent), n))


def segment_keys(own: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, index of its set, place) of all segments; place is the band and, above it, how many keys may be held by no other set."""
    n = np.array([x.size for x in own], np.int64)
    lo, hi = bands(n, percent)
    for step in range(int((hi - lo).max(initial=0)) + 1):
        level = lo + step
        at = np.flatnonzero((level <= hi) & (level > 0) & (n > 0))  # in band 0 only equal sets link
        if not at.size:
            continue
        level, segments = level[at], SEGMENTS[level[at]]
        flat = np.concatenate([own[i] for i in at.tolist()])
        owner = np.repeat(np.arange(at.size), n[at])
        wide = segments[owner].astype(np.uint64)
        # The high 32 bits times the number of segments; sets are sorted, so segments ascend.
        segment = ((flat >> np.uint64(32)) * wide) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])]))
        of = owner[first]
        key = mix(np.add.reduceat(mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), first) + mix(segment[first] * np.uint64(BY_VALUE) + level[of].astype(np.uint64)))
        spare = np.bincount(of, minlength=at.size) - (LADDER[level] + 1)
        yield key, at[of], level[of] + (np.maximum(spare, 0)[of] << 8)
        for i in np.flatnonzero(spare < 0).tolist():
            x = own[at[i]]
            x = x[: x.size - int(_least_overlap(x.size, percent)) + 1]
            yield mix(x + np.uint64(level[i])), np.full(x.size, at[i]), np.full(x.size, level[i] + BY_VALUE)


# Signatures and postings


def _signatures(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = sets(batch.column(1), words)
            n = pa.array([x.size for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *(pa.array(_digests(own, k).view(np.int64)) for k in (0, 1))], ["doc_id", "n", "d1", "d2"])

    return run


def _postings(words: int, percent: int, buckets: int) -> Callable:
    """A cell for each bucket of keys, and one with what a batch knows to repeat. Equal sets of a batch are sent once, by the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, ids = sets(batch.column(1), words), np.asarray(batch.column(0))
            digests = _digests(own, 1)
            order = np.lexsort((ids, digests))
            _, first = np.unique(digests[order], return_index=True)
            pick = np.sort(order[first])
            ids, found = ids[pick], list(segment_keys([own[i] for i in pick.tolist()], percent))
            if not found:
                continue
            keys, doc, place = (np.concatenate([x[k] for x in found]) for k in range(3))
            order = np.argsort(doc, kind="stable")
            keys, doc, place = keys[order], doc[order], place[order]
            # In a bucket, 32 more bits of a key are told apart; longer keys would only spare some rows that turn out to be alone.
            bucket, short = (keys >> np.uint64(32)) % np.uint64(buckets), keys & np.uint64(0xFFFFFFFF)
            keys = bucket << np.uint64(32) | short
            at, _, again = distinct(keys, np.ones(keys.size, bool))
            rows = []
            if again.size:
                rows.append((int(ids[doc[again[0]]] % buckets), True, pack(*pack_places(ids, doc[again], place[again]), keys[again])))
            at = np.sort(at)
            at = at[np.argsort(bucket[at], kind="stable")]
            cuts = np.searchsorted(bucket[at], np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                x = at[cuts[k] : cuts[k + 1]]
                rows.append((k, False, pack(*pack_places(ids, doc[x], place[x]), short[x].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "known", "cell"])

    return run


def _held_twice(group: pa.Table) -> pa.Table:
    """Postings of a bucket in; those of keys that repeat out."""
    out, keys, docs, places = [], [], [], []
    bucket = int(group.column("bucket")[0].as_py()) << 32
    for known, cell in zip(group.column("known").to_pylist(), group.column("cell"), strict=True):
        columns = unpack(cell.as_py())
        doc, place = unpack_places(*columns[:3])
        if known:
            out.append((doc, place, columns[3].view(np.int64)))
        else:
            docs.append(doc)
            places.append(place)
            keys.append(columns[3])
    if keys:
        doc, place, key = (np.concatenate(x) for x in (docs, places, keys))
        hit = meeting(key, np.ones(key.size, bool))
        out.append((doc[hit], place[hit], key[hit].astype(np.int64) + bucket))
    doc, place, key = (np.concatenate([x[k] for x in out]) for k in range(3))
    pa.default_memory_pool().release_unused()
    return pa.table({"doc_id": pa.array(doc), "place": pa.array(place.astype(np.int64)), "key": pa.array(key)})


def tiles(docs: DataFrame, copies: DataFrame, n_words: int, words: int, percent: int) -> DataFrame:
    """(tile, doc_id, shared): the members of every tile of two or more; shared counts a member's keys that others hold."""
    buckets = max(partitions(docs.sparkSession), -(-n_words // BUCKET_WORDS))
    cells = docs.mapInArrow(_postings(words, percent, buckets), "bucket int, known boolean, cell binary")
    found = cells.groupBy("bucket").applyInArrow(_held_twice, "doc_id long, place long, key long")
    spare = F.shiftright("place", 8)
    # Sets with enough keys that are theirs alone are done: first by what buckets say, then without copies.
    # A posting may come twice, from its batch and its bucket.
    found = settle(found, "postings").join(copies.select("doc_id"), "doc_id", "left_anti")
    entry = ["doc_id", "place"]
    counted = found.groupBy(*entry).agg(F.collect_set("key").alias("keys")).filter(F.size("keys") > spare)
    rows = settle(counted.select(*entry, F.explode("keys").alias("key")), "keys")
    held = rows.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    ranked = rows.join(held, "key").groupBy(*entry).agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("keys"))
    shared = F.size("keys")
    first = ranked.filter(shared > spare).select("doc_id", shared.alias("shared"), F.explode(F.slice("keys", F.lit(1), (shared - spare).cast("int"))).alias("at"))
    members = settle(first.select(F.col("at.key").alias("tile"), "doc_id", "shared"), "members")
    several = members.groupBy("tile").agg(F.count("*").alias("members")).filter("members > 1").select("tile")
    return members.join(several, "tile")


# Bitmaps


def width(n: int, percent: int) -> int:
    """Bits of a signature: a power of two of at least eight times the values in which linked sets can differ."""
    differ = 2 * n * (100 - percent) // (100 + percent) + 1
    return max(128, 1 << (8 * differ - 1).bit_length())


def bitmap(values: np.ndarray, percent: int) -> bytes:
    """The parity of the number of values at each bit."""
    size = width(values.size, percent)
    at = (mix(values ^ np.uint64(0x5BD1E995)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(cell: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller power of two of bytes, as 64-bit words."""
    raw = np.frombuffer(cell, np.uint64)
    return np.bitwise_xor.reduce(raw.reshape(-1, size // 8), axis=0) if raw.nbytes > size else raw


def may_link(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether |A & B| <= (|A| + |B| - bits that differ) / 2 leaves J >= percent / 100 possible."""
    most = np.minimum((n1 + n2 - differ) // 2, np.minimum(n1, n2))
    return 100 * most >= percent * (n1 + n2 - most)


def _full_sets(words: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 21):
            own = sets(batch.column(1), words)
            cells = [pa.array([x.size for x in own], pa.int64()), pa.array([bitmap(x, percent) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "n", "bits", "hashes"])

    return run


# Pairs


def _bounded(percent: int) -> Callable:
    """Rows a, b, n_a, n_b, bits_a, bits_b in; the pairs whose bound passes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            differ = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = x.as_py(), y.as_py()
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(may_link(n1, n2, differ, percent)))

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets link, by intersection of their sorted arrays."""
    small, large = (x, y) if x.size <= y.size else (y, x)
    at = np.minimum(np.searchsorted(large, small), large.size - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (x.size + y.size - both)


def _exact(percent: int) -> Callable:
    """Rows a, b, hashes_a, hashes_b in; the pairs that link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            keep = np.array([_linked(*(np.frombuffer(c.as_buffer(), np.uint64) for c in pair), percent) for pair in sides], bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _with_both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs a, b with the columns of both: those of ``sides`` are doc_id and others."""
    names = sides.columns[1:]
    for side in "ab":
        pairs = pairs.join(sides.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in names for side in "ab"])


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by intersection of their whole sets."""
    return _with_both(pairs, full.select("doc_id", "hashes")).mapInArrow(_exact(percent), "a long, b long")


def middle_pairs(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Each member of a tile with the tile's middle, where the bound passes."""
    middles = members.groupBy("tile").agg(F.max(F.struct("shared", -F.col("doc_id"))).alias("top")).select("tile", (-F.col("top.col2")).alias("middle"))
    met = members.join(middles, "tile").filter("doc_id <> middle")
    pairs = met.select(F.least("doc_id", "middle").alias("a"), F.greatest("doc_id", "middle").alias("b")).distinct()
    return _with_both(pairs, full.select("doc_id", "n", "bits")).mapInArrow(_bounded(percent), "a long, b long")


def _within(n: np.ndarray, comp: np.ndarray, side: np.ndarray, narrow: np.ndarray, maps: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits that differ) of one tile whose sizes, sides and components allow a link and whose bound passes; sizes ascend.

    One of a pair must be of the width of ``maps`` (``narrow``).
    """
    m = n.size
    ends = np.searchsorted(n, n * 100 // percent, "right")
    # Small tiles at once, large ones in strips of rows of bounded size.
    strip = max(1, min(m, (1 << 18) // m))
    for at in range(0, m - 1, strip):
        i = np.arange(at, min(at + strip, m))
        count = np.maximum(ends[i] - i - 1, 0)
        if not count.sum():
            continue
        first = np.repeat(i, count)
        second = first + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        keep = (comp[first] != comp[second]) & (narrow[first] | narrow[second])
        keep &= (side[first] < 0) | (side[first] != side[second])
        first, second = first[keep], second[keep]
        if first.size:
            differ = np.bitwise_count(maps[first] ^ maps[second]).sum(axis=1, dtype=np.int64)
            keep = may_link(n[first], n[second], differ, percent)
            yield first[keep], second[keep], differ[keep]


def _pairs(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, i, j, bits that differ) of each part: its pairs across components whose bound passes, as rows of ``table``.

    ``table`` is sorted by part, n and doc_id.
    """
    part, n, comp, side = (np.asarray(table.column(c)) for c in ("part", "n", "comp", "side"))
    bits = table.column("bits").combine_chunks()
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if part.size else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        cells = [x.as_py() for x in bits.slice(lo, hi - lo)]
        widths = np.array([len(x) for x in cells])
        # Sizes that can link have the same width or neighbouring ones; each is folded to the narrower only.
        for size in np.unique(widths).tolist():
            at = np.flatnonzero((widths == size) | (widths == 2 * size))
            if at.size < 2:
                continue
            maps = np.stack([fold(cells[i], size) for i in at])
            own = at + lo
            for i, j, differ in _within(n[own], comp[own], side[own], widths[at] == size, maps, percent):
                yield int(part[lo]), own[i], own[j], differ


_ROW = ["part", "doc_id", "n", "comp", "tile", "side"]
_ORDER = [("part", "ascending"), ("n", "ascending"), ("doc_id", "ascending")]


def _nearest(percent: int) -> Callable:
    """A cell of parts in; each component's nearest pair in its part out, so at most a pair a component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        doc, comp = np.asarray(table.column("doc_id")), np.asarray(table.column("comp"))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part, i, j, differ in _pairs(table, percent):
            for of in (comp[i], comp[j]):
                order = np.lexsort((differ, of))
                order = order[np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))] if order.size else order
                for c, d, x, y in zip(of[order].tolist(), differ[order].tolist(), i[order].tolist(), j[order].tolist(), strict=True):
                    if (part, c) not in best or d < best[part, c][0]:
                        best[part, c] = d, x, y
        pairs = np.array([v[1:] for v in best.values()], np.int64).reshape(-1, 2)
        a, b = doc[pairs[:, 0]], doc[pairs[:, 1]]
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _before(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    """For rows of one part, a bit for each tile before theirs that two of them are in."""
    own = table.take(pa.array(rows))
    tile = own.column("tile")[0].as_py()
    lists = own.column("tiles").combine_chunks()
    flat = np.asarray(lists.flatten())
    of = np.repeat(np.arange(rows.size), np.asarray(lists.value_lengths()))
    of, flat = of[flat < tile], flat[flat < tile]
    used, index, held = np.unique(flat, return_inverse=True, return_counts=True)
    several = held > 1
    bit = np.cumsum(several) - 1
    keep = several[index]
    out = np.zeros((rows.size, 8 * max(1, -(-int(several.sum()) // 64))), np.uint8)
    at = bit[index[keep]]
    np.bitwise_or.at(out, (of[keep], at // 8), (1 << (at % 8)).astype(np.uint8))
    return out.view(np.uint64)


def _own_pairs(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_pairs``, without those that share a tile before the part's own: a pair is looked at in one tile only."""
    part = np.asarray(table.column("part"))
    place = np.zeros(part.size, np.int64)
    masks: dict[int, np.ndarray] = {}
    for p, i, j, differ in _pairs(table, percent):
        if p not in masks:
            masks.clear()
            lo, hi = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
            place[lo:hi] = np.arange(hi - lo)
            masks[p] = _before(table, np.arange(lo, hi))
        keep = ~np.any(masks[p][place[i]] & masks[p][place[j]], axis=1)
        yield p, i[keep], j[keep], differ[keep]


def _asked(percent: int) -> Callable:
    """A cell of parts in; the rows that have a pair to be looked at in their part out, a row each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        doc = np.asarray(table.column("doc_id"))
        wanted = np.zeros(doc.size, bool)
        for _, i, j, _ in _own_pairs(table, percent):
            wanted[i] = True
            wanted[j] = True
        at = pa.array(np.flatnonzero(wanted))
        pa.default_memory_pool().release_unused()
        return table.select(_ROW).take(at)

    return run


def _wide(own: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmaps of ``bits`` bits, by another hash."""
    out = np.zeros((len(own), bits // 8), np.uint8)
    for k, values in enumerate(own):
        at = (mix(values ^ np.uint64(0x6C8E9CF570932BD5)) & np.uint64(bits - 1)).astype(np.int64)
        out[k] = np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little")
    return out.view(np.uint64)


def _find(up: dict[int, int], x: int) -> int:
    while up.setdefault(x, x) != x:
        up[x] = x = up[up[x]]
    return x


def _links(percent: int) -> Callable:
    """The asked rows of a part with their sets in; links that join its components out, fewer than the rows.

    Pairs that the bound leaves meet wider bitmaps, eight times the first ones, and then each other's sets.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        doc, n, comp = (np.asarray(table.column(c)) for c in ("doc_id", "n", "comp"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes").combine_chunks()]
        maps = _wide(own, 8 * width(int(n.max(initial=1)), percent))
        up: dict[int, int] = {}
        a, b = [], []
        for _, i, j, _ in _own_pairs(table, percent):
            strip = max(1, (1 << 22) // maps.shape[1])
            for at in range(0, i.size, strip):
                x, y = i[at : at + strip], j[at : at + strip]
                keep = may_link(n[x], n[y], np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64), percent)
                for k, m in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                    one, other = _find(up, int(comp[k])), _find(up, int(comp[m]))
                    if one != other and _linked(own[k], own[m], percent):
                        up[one] = other
                        a.append(min(doc[k], doc[m]))
                        b.append(max(doc[k], doc[m]))
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pa.array(np.array(a, np.int64)), "b": pa.array(np.array(b, np.int64))})

    return run


def _block(doc: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc), blocks).cast("int")


def parts(members: DataFrame, full: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n, comp, bits, tile, part, side): the members of tiles whose components are several, by the parts in which they meet.

    A tile of many rows or long sets is cut into blocks; a part is two of them, and pairs of one side are no pairs of it.
    """
    placed = members.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").join(full.select("doc_id", "n"), "doc_id")
    placed = placed.select("tile", "doc_id", "n", F.coalesce("root", "doc_id").alias("comp"))
    sizes = placed.groupBy("tile", "comp").agg(F.count("*").alias("held"), F.sum("n").alias("words"))
    whole = F.sum("held").alias("held"), F.sum("words").alias("words"), F.count("*").alias("comps"), F.max(F.struct("held", "comp", "words")).alias("top")
    apart = sizes.groupBy("tile").agg(*whole).filter("comps > 1")
    # The component with most rows is the base: its members meet the others only.
    count_of = lambda rows, words: F.ceil(F.greatest(rows / F.lit(BLOCK), words / F.lit(BLOCK_WORDS))).cast("int")
    of_base = count_of(F.col("top.held"), F.col("top.words"))
    of_rest = count_of(F.col("held") - F.col("top.held"), F.col("words") - F.col("top.words"))
    small = (F.col("held") <= BLOCK) & (F.col("words") <= BLOCK_WORDS)
    apart = apart.select("tile", F.col("top.comp").alias("base"), of_base.alias("of_base"), of_rest.alias("of_rest"), small.alias("small"))
    rows = placed.join(apart, "tile").join(full.select("doc_id", "bits"), "doc_id").withColumn("in_base", F.col("comp") == F.col("base"))
    keep = ["doc_id", "n", "comp", "bits", "tile"]
    alone = rows.filter("small").select(*keep, F.col("tile").alias("part"), F.lit(-1).alias("side"))
    large = rows.filter("not small").withColumn("mine", F.when(F.col("in_base"), _block(F.col("doc_id"), F.col("of_base"))).otherwise(_block(F.col("doc_id"), F.col("of_rest"))))
    count = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    with_base = large.withColumn("other", F.explode(F.when(F.col("in_base"), count("of_rest")).otherwise(count("of_base"))))
    block = F.when(F.col("in_base"), F.struct("other", "mine")).otherwise(F.struct(F.col("mine").alias("other"), F.col("other").alias("mine")))
    with_base = with_base.select(*keep, F.xxhash64("tile", F.lit("base"), block).alias("part"), F.col("in_base").cast("int").alias("side"))
    rest = large.filter("not in_base").withColumn("other", F.explode(count("of_rest")))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    rest = rest.select(*keep, F.xxhash64("tile", F.lit("rest"), F.least("mine", "other"), F.greatest("mine", "other")).alias("part"), side.alias("side"))
    return alone.union(with_base).union(rest)


def _cells(rows: DataFrame, count: int) -> DataFrame:
    cells = max(4 * partitions(rows.sparkSession), -(-count // CELL_ROWS))
    return rows.withColumn("cell", F.pmod("part", F.lit(cells)))


def nearest_pairs(members: DataFrame, full: DataFrame, roots: DataFrame, percent: int, count: int) -> DataFrame:
    """Of each component in a tile the nearest pair with another one whose bound passes."""
    cells = _cells(parts(members, full, roots), count)
    return cells.groupBy("cell").applyInArrow(_nearest(percent), "a long, b long").distinct()


def exact_links(members: DataFrame, full: DataFrame, roots: DataFrame, percent: int, count: int) -> DataFrame:
    """(a, b): links between components that share a tile, enough to join all that are linked.

    First by bitmaps alone: which rows of a part have a pair there that passes. Those rows meet again with their
    sets, and pairs are made and tested within the task; what is written are rows of parts, not pairs.
    """
    lists = members.groupBy("doc_id").agg(F.collect_list("tile").alias("tiles"))
    rows = parts(members, full, roots).join(lists, "doc_id")
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(_ROW).dtypes)
    asked = settle(_cells(rows, count).groupBy("cell").applyInArrow(_asked(percent), schema), "asked")
    held = asked.join(full.select("doc_id", "bits", "hashes"), "doc_id").join(lists, "doc_id")
    return held.groupBy("part").applyInArrow(_links(percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of every row."""
    own, ids = keyed(docs)
    signs = settle(own.mapInArrow(_signatures(words), SIGNATURE), "signatures")
    sized = signs.filter("n > 0")
    classes = sized.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")).filter("held > 1")
    classes = settle(classes, "classes")  # so that the join can split a class that many rows belong to
    copies = settle(sized.join(classes, ["d1", "d2", "n"]).filter("doc_id <> rep").select("doc_id", "rep"), "copies")
    n_words = signs.agg(F.sum("n")).first()[0] or 0
    members = settle(tiles(own, copies, n_words, words, percent), "tiles")
    asked = members.select("doc_id").distinct()
    full = settle(own.join(asked, "doc_id", "left_semi").mapInArrow(_full_sets(words, percent), SETS), "sets")
    tested = settle(middle_pairs(members, full, percent), "pairs")
    links = settle(verified(tested, full, percent), "links")
    roots = components(links)
    count = members.count()
    pairs = settle(nearest_pairs(members, full, roots, percent, count).join(tested, ["a", "b"], "left_anti"), "pairs")
    for more in (lambda: verified(pairs, full, percent), lambda: exact_links(members, full, roots, percent, count)):
        found = settle(more(), "links")
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links)
    # A representative has the least key of its class, so copies change no root.
    of = roots.withColumnsRenamed({"u": "rep", "root": "top"})
    of_copies = copies.join(of, "rep", "left").select("doc_id", F.coalesce("top", "rep").alias("root"))
    joined = signs.select("doc_id", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("u", "doc_id").union(of_copies), "doc_id", "left")
    out = joined.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    if ids is None:
        return out
    rows = out.join(ids.withColumnRenamed("row", "doc_id"), "doc_id")
    least = rows.groupBy("component_id").agg(F.min("own").alias("least"))
    return rows.join(least, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
