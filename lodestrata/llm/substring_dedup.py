"""Substring de-duplication by fixed-block anchors.

Any window of ``window`` words holds a whole block of ``block = (window + 1) // 2`` words that starts
at a multiple of ``block`` in its document. Those non-overlapping blocks are the index. Every rolling
run of ``block`` words of every document probes it; a hit is a run that equals an indexed block and
occurs at two places or more. If a window repeats, each of its copies therefore holds a hit. Hits are
then extended: the windows around them are compared over all their words' hashes (64 bits of key and
the bucket from a second function), and the union of the windows that repeat is what is removed,
which is every maximal exact repeat of ``window`` words or more.

Postings travel packed, bucketed by hash, with as many buckets as the texts' bytes ask for; a key that is
frequent costs one posting a batch, so neither a hot passage nor a group of copies gathers in one task.

Defined results: a null or empty text has no words; a text shorter than ``window`` keeps all its
words; copies of a text lose every word they have in repeated windows, the first copy included;
other columns of the input take no part, whatever their names; rows of null or repeated ids are
judged each by itself, under a key that is made and settled where there are any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import inside, mix, slices, text_words, windows
from .postings import distinct, meeting, pack, pack_places, unpack, unpack_places
from .shared import keyed, partitions

#: Bytes of text whose postings a bucket gets, about.
BUCKET_BYTES = 32_000_000
POSTINGS = "bucket int, known boolean, cell binary"
PLACES = "doc_id long, places binary"


def _cells(keys: np.ndarray, route: np.ndarray, flags: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, buckets: int, width: type) -> Iterator[tuple[int, bool, bytes]]:
    """One cell for each bucket with postings, and one with what this batch knows to repeat."""
    first, flagged, again = distinct(keys, flags)
    if again.size:
        yield int(ids[doc[again[0]]] % buckets), True, pack(*pack_places(ids, doc[again], place[again]))
    order = np.argsort(first)
    first, flagged = first[order], flagged[order]
    bucket = (route[first] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        own = first[order[cuts[k] : cuts[k + 1]]]
        flag = flagged[order[cuts[k] : cuts[k + 1]]]
        yield int(k), False, pack(*pack_places(ids, doc[own], place[own]), keys[own].astype(width), np.packbits(flag))


def _batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "known", "cell"])


def _places(bounds: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))[:count]
    return doc, np.arange(count) - bounds[doc]


def _probes(block: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = np.asarray(batch.column(0))
            bounds, words = text_words(batch.column(1))
            good = np.flatnonzero(inside(bounds, block))
            if not good.size:
                continue
            keys, route = windows(words, block)[good], windows(words, block, 1)[good]
            doc, place = _places(bounds, words.size)
            doc, place = doc[good], place[good]
            yield _batch(list(_cells(keys, route, place % block == 0, doc, place, ids, buckets, np.uint32)))

    return run


def _meet(shares: int) -> Callable:
    """Postings of a bucket in; the places whose key is flagged and repeats out, in a cell for each share of the documents."""

    def run(group: pa.Table) -> pa.Table:
        ids, places, keys, flags, found = [], [], [], [], [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for known, cell in zip(group.column("known").to_pylist(), group.column("cell"), strict=True):
            columns = unpack(cell.as_py())
            doc, place = unpack_places(*columns[:3])
            if known:
                found.append((doc, place))
                continue
            ids.append(doc)
            places.append(place)
            keys.append(columns[3])
            flags.append(np.unpackbits(columns[4], count=place.size).astype(bool))
        if keys:
            hit = meeting(np.concatenate(keys), np.concatenate(flags))
            found.append((np.concatenate(ids)[hit], np.concatenate(places)[hit]))
        doc, place = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        share = (mix(doc.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
        order = np.lexsort((place, doc, share))
        doc, place, share = doc[order], place[order], share[order]
        cuts = np.searchsorted(share, np.arange(shares + 1))
        full = np.flatnonzero(np.diff(cuts))
        cells = []
        for k in full:
            used, index = np.unique(doc[cuts[k] : cuts[k + 1]], return_inverse=True)
            cells.append(pack(*pack_places(used, index, place[cuts[k] : cuts[k + 1]])))
        return pa.table({"share": pa.array(full, pa.int32()), "cell": pa.array(cells, pa.binary())})

    return run


def _by_document(group: pa.Table) -> pa.Table:
    """Cells of a share of the documents in, a row a document out."""
    found = [unpack_places(*unpack(cell.as_py())) for cell in group.column("cell")]
    doc, place = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(at[1:], doc.size)
    return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})


def _found(postings: DataFrame, buckets: int) -> DataFrame:
    """doc_id and its packed places, a row a document."""
    met = postings.groupBy("bucket").applyInArrow(_meet(buckets), "share int, cell binary")
    return met.groupBy("share").applyInArrow(_by_document, PLACES)


def _joined(cells: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """A mark over the words of a batch at each place in its documents' lists."""
    marks = np.zeros(int(bounds[-1]) + 1, bool)
    for i, places in enumerate(cells):
        if places.is_valid:
            marks[bounds[i] + np.frombuffer(places.as_py(), np.uint32)] = True
    return marks[:-1]


def _extensions(window: int, block: int, buckets: int) -> Callable:
    reach = window - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(b.filter(b.column(2).is_valid()) for b in batches):
            ids = np.asarray(batch.column(0))
            bounds, words = text_words(batch.column(1))
            good = inside(bounds, window)
            if not good.size:
                continue
            hits = np.concatenate([[0], np.cumsum(_joined(batch.column(2), bounds))])
            at = np.arange(good.size)
            good &= hits[at + reach + 1] > hits[at]
            good = np.flatnonzero(good)
            if not good.size:
                continue
            keys, route = windows(words, window)[good], windows(words, window, 1)[good]
            doc, place = _places(bounds, words.size)
            yield _batch(list(_cells(keys, route, np.ones(good.size, bool), doc[good], place[good], ids, buckets, np.uint64)))

    return run


def _results(window: int, texts: bool) -> Callable:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, digests, kept = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if places.is_valid:
                    edge = np.zeros(len(words) + window, np.int64)
                    starts = np.unique(np.frombuffer(places.as_py(), np.uint32)).astype(np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    keep = np.cumsum(edge)[: len(words)] == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in kept], pa.string())] * texts, names)

    return run


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, places): packed starts of every window of ``docs``, whose ids are distinct, that also starts elsewhere."""
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = _found(texts.mapInArrow(_probes(block, buckets), POSTINGS), buckets)
    # A left join here and in remove_repeats: both then read one exchange of the texts.
    around = texts.join(hits, "doc_id", "left").select("doc_id", "text", "places")
    return _found(around.mapInArrow(_extensions(window, block, buckets), POSTINGS), buckets)


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = True) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the kept text."""
    own, ids = keyed(docs)
    out = own.join(repeated_windows(own, window), "doc_id", "left").select("doc_id", "text", "places").mapInArrow(
        _results(window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    )
    if ids is None:
        return out
    return out.withColumnRenamed("doc_id", "row").join(ids, "row").select(F.col("own").alias("doc_id"), *out.columns[1:])
