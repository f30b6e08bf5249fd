"""Suffix-array de-duplication: bytes in strings of ``length`` that stand anywhere else are removed.

Equal strings meet in one shard. The anchor of a string is its least ``GRAM``-byte hash (the leftmost of equal
ones), so equal strings have equal anchors at equal places; the strings of one anchor occurrence make a segment
of less than twice their length. Anchors are counted first, as packed postings by bucket; segments whose anchor
occurs once are never sent. The others go to the shard of their anchor, equal ones of a batch of texts once.

A shard joins its different segments to one text and sorts its suffixes by external induced sorting
(``induced_sort``): queues on disk carry the tuples and their common prefixes through the induction, and suffixes
side by side with ``length`` bytes in common are strings that repeat. A segment that occurs twice repeats as a
whole; it stands in the text once, for what others share with it. Runs of such strings go back to their
documents by id, and are merged to the spans that are removed.

An anchor with very many different segments (more than ``HOT`` and a millionth of all) would make one shard of
a share of the corpus; its strings are told apart by 64-bit hashes of their own, each dealt out by itself. The list of such anchors
is at most a million numbers, whatever the corpus.

Texts of a batch are about ``BATCH_BYTES``, a longer one is a batch of its own. Queues over ``MEMORY`` go to
files in the shared folder, which are deleted when the shard is done.

Defined results: a null or empty text has no bytes; a text shorter than ``length`` keeps all; copies lose
everything, the first one too; matches never cross texts; rows of null or repeated ids are judged each by itself;
columns besides doc_id and text take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import MULTIPLIERS, inside, mix, slices, windows
from .induced_sort import Spool, repeated
from .postings import distinct, meeting, pack, pack_places, unpack, unpack_places
from .shared import keyed, partitions, settle, shared_dir

GRAM, BATCH_BYTES, SHARD_BYTES, MEMORY, HOT = 64, 1 << 21, 6_000_000, 1 << 26, 4096
#: Share of all anchors' segments from which an anchor is hot.
HOT_SHARE = 1_000_000
#: Bytes between anchors, at the least on average.
STEP = 50
_VALUES = np.random.Generator(np.random.PCG64(20241103)).integers(0, 2**64, size=256, dtype=np.uint64)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SENT = "kind int, bucket int, known boolean, cell binary"
SEGMENTS, STRINGS = 0, 1


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of texts; null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bounds - bounds[0], raw[bounds[0] : bounds[-1]]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: values.size - (width - span)], values[width - span :])


def _digests(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values from each start to each end."""
    m = np.uint64(MULTIPLIERS[0])
    inverse = np.uint64(pow(int(m), -1, 2**64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(values.size, m)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1], dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(values.size, inverse)]), dtype=np.uint64)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


class _Segments:
    """The segments of a batch: doc, start (of the first string), count (of strings), at (the anchor), key and digest."""

    def __init__(self, texts: pa.Array, length: int):
        self.bounds, self.raw = _bytes(texts)
        good = np.flatnonzero(inside(self.bounds, length))
        self.size = good.size
        if not good.size:
            return
        gram = min(GRAM, length)
        self.values = _VALUES[self.raw]
        hashes = windows(self.values, gram)
        at = (_least((hashes & _HIGH) | np.arange(hashes.size, dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)[good]
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)))
        self.start, self.at, self.size = good[head], at[head], head.size
        self.count = np.diff(np.append(head, good.size))
        self.key = hashes[self.at]
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self.end = self.start + self.count + (length - 1)

    def digests(self) -> np.ndarray:
        return mix(_digests(self.values, self.start, self.end) + self.key)

    def places(self, which: np.ndarray) -> np.ndarray:
        return which - self.bounds[self.doc]


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), np.sort(order[cuts[k] : cuts[k + 1]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "bucket", "known", "cell"])


def _anchors(length: int, buckets: int) -> Callable:
    """A posting for each anchor of a batch with the number of its different segments; the places of anchors that repeat in it are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=BATCH_BYTES):
            ids, found = np.asarray(batch.column(0)), _Segments(batch.column(1), length)
            if not found.size:
                continue
            place = found.places(found.at)
            first, _, again = distinct(found.key, np.zeros(found.size, bool))
            contents = np.unique(found.key[np.unique(found.digests(), return_index=True)[1]], return_counts=True)[1]
            rows = []
            if again.size:
                rows.append((SEGMENTS, int(ids[found.doc[again[0]]] % buckets), True, pack(*pack_places(ids, found.doc[again], place[again]))))
            for k, own in _by_bucket((found.key[first] % np.uint64(buckets)).astype(np.int64), buckets):
                key, n = (found.key[first[own]] >> np.uint64(32)).astype(np.uint32), np.minimum(contents[own], 0xFFFF).astype(np.uint16)
                order = np.argsort(first[own])
                at = first[own][order]
                rows.append((SEGMENTS, k, False, pack(*pack_places(ids, found.doc[at], place[at]), key[order], n[order])))
            yield _batch(rows)

    return run


def _shares(doc: np.ndarray, place: np.ndarray, count: np.ndarray | None, shares: int) -> pa.Table:
    """A cell for each share of the documents, of places or, with ``count``, of runs."""
    share = (mix(doc.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
    order = np.lexsort((place, doc, share))
    doc, place, share = doc[order], place[order], share[order]
    cuts = np.searchsorted(share, np.arange(shares + 1))
    full = np.flatnonzero(np.diff(cuts))
    cells = []
    for k in full:
        used, index = np.unique(doc[cuts[k] : cuts[k + 1]], return_inverse=True)
        more = () if count is None else (count[order[cuts[k] : cuts[k + 1]]].astype(np.uint32),)
        cells.append(pack(*pack_places(used, index, place[cuts[k] : cuts[k + 1]]), *more))
    return pa.table({"share": pa.array(full, pa.int32()), "cell": pa.array(cells, pa.binary())})


def _met(shares: int, hot: int) -> Callable:
    """A bucket's postings in; the places of anchors that repeat out, and as share -1 the anchors with over ``hot`` segments."""

    def run(group: pa.Table) -> pa.Table:
        docs, places, keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [], []
        own_docs, own_places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for known, cell in zip(group.column("known").to_pylist(), group.column("cell"), strict=True):
            columns = unpack(cell.as_py())
            doc, place = unpack_places(*columns[:3])
            if known:
                docs.append(doc)
                places.append(place)
                continue
            own_docs.append(doc)
            own_places.append(place)
            keys.append(columns[3])
            counts.append(columns[4])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint32)
        hit = meeting(key, np.ones(key.size, bool))
        out = _shares(np.concatenate([*docs, np.concatenate(own_docs)[hit]]), np.concatenate([*places, np.concatenate(own_places)[hit]]), None, shares)
        if not key.size:
            return out
        used, index = np.unique(key, return_inverse=True)
        many = used[np.bincount(index, np.concatenate(counts)) > hot]
        if not many.size:
            return out
        bucket = np.uint64(group.column("bucket")[0].as_py())
        cell = pack((bucket << np.uint64(32)) | many.astype(np.uint64))
        return pa.concat_tables([out, pa.table({"share": pa.array([-1], pa.int32()), "cell": pa.array([cell], pa.binary())})])

    return run


def _marks(cells: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """A mark over the bytes of a batch at each place in its documents' lists."""
    marks = np.zeros(int(bounds[-1]) + 1, bool)
    for i, places in enumerate(cells):
        if places.is_valid:
            marks[bounds[i] + np.frombuffer(places.as_py(), np.uint32)] = True
    return marks


def _segments(length: int, buckets: int, hot: np.ndarray) -> Callable:
    """Segments of anchors that repeat, and the hashed strings of those that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((b.filter(b.column(2).is_valid()) for b in batches), most=BATCH_BYTES):
            ids, found = np.asarray(batch.column(0)), _Segments(batch.column(1), length)
            if not found.size:
                continue
            wanted = _marks(batch.column(2), found.bounds)[found.at]
            bucket = (found.key % np.uint64(buckets)).astype(np.int64)
            place = found.places(found.start)
            rows = []
            if hot.size:
                much = wanted & np.isin((bucket.astype(np.uint64) << np.uint64(32)) | (found.key >> np.uint64(32)), hot)
                wanted &= ~much
                rows += _strings(found, np.flatnonzero(much), ids, length, buckets)
            own = np.flatnonzero(wanted)
            first, _, again = distinct(found.digests()[own], np.zeros(own.size, bool))
            if again.size:
                at = own[again]
                rows.append((SEGMENTS, int(ids[found.doc[at[0]]] % buckets), True, pack(*pack_places(ids, found.doc[at], place[at]), found.count[at].astype(np.uint32))))
            raw, repeats = found.raw.tobytes(), np.zeros(own.size, bool)
            repeats[again] = True
            for k, part in _by_bucket(bucket[own[first]], buckets):
                at = np.sort(first[part])
                flags, at = np.packbits(repeats[at]), own[at]
                text = b"".join([raw[a:b] for a, b in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)])
                columns = *pack_places(ids, found.doc[at], place[at]), found.count[at].astype(np.uint32), flags, np.frombuffer(text, np.uint8)
                rows.append((SEGMENTS, k, False, pack(*columns)))
            if rows:
                yield _batch(rows)

    return run


def _strings(found: _Segments, which: np.ndarray, ids: np.ndarray, length: int, buckets: int) -> list[tuple]:
    """Postings of each string of some segments; those that repeat within the batch are known."""
    if not which.size:
        return []
    count = found.count[which]
    at = np.repeat(found.start[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
    doc = np.repeat(found.doc[which], count)
    place = at - found.bounds[doc]
    key, route = windows(found.values, length)[at], windows(found.values, length, 1)[at]
    first, _, again = distinct(key, np.zeros(key.size, bool))
    rows = []
    if again.size:
        rows.append((STRINGS, int(ids[doc[again[0]]] % buckets), True, pack(*pack_places(ids, doc[again], place[again]))))
    for k, own in _by_bucket((route[first] % np.uint64(buckets)).astype(np.int64), buckets):
        one = np.sort(first[own])
        rows.append((STRINGS, k, False, pack(*pack_places(ids, doc[one], place[one]), key[one])))
    return rows


def _met_strings(group: pa.Table, shares: int) -> pa.Table:
    docs, places, keys, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)], []
    for known, cell in zip(group.column("known").to_pylist(), group.column("cell"), strict=True):
        columns = unpack(cell.as_py())
        doc, place = unpack_places(*columns[:3])
        if known:
            found.append((doc, place))
        else:
            docs.append(doc)
            places.append(place)
            keys.append(columns[3])
    key = np.concatenate(keys)
    hit = meeting(key, np.ones(key.size, bool))
    found.append((np.concatenate(docs)[hit], np.concatenate(places)[hit]))
    doc, place = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return _shares(doc, place, np.ones(doc.size, np.uint32), shares)


def _runs_of(contents: list[bytes], whole: np.ndarray, length: int, spool: Spool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, start, count) of the runs of repeated strings in different segments; ``whole`` ones repeat as they are."""
    sizes = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    chars = np.frombuffer(b"\xff".join(contents) + b"\xff\xfe", np.uint8) + np.uint8(2)  # UTF-8 has neither byte: 1 parts segments, 0 ends
    edge = np.zeros(chars.size + 1, np.int8)
    edge[begin] = 1
    edge[begin + sizes - length + 1] -= 1
    found = repeated(chars, length, spool) & (np.cumsum(edge[:-1]) > 0)
    edge[:] = 0
    edge[begin[whole]] = 1
    edge[(begin + sizes - length + 1)[whole]] -= 1
    found |= np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0))
    start, end = change[::2], change[1::2]
    content = np.searchsorted(begin, start, "right") - 1
    return content, start - begin[content], end - start


def _sorted(shares: int, length: int, uri: str, memory: int) -> Callable:
    """A shard's segments in; the runs of strings that repeat out, by share of the documents."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() == STRINGS:
            return _met_strings(group, shares)
        known: dict[bytes, int] = {}
        doc, place, content, twice = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [], []
        found = []
        for ready, cell in zip(group.column("known").to_pylist(), group.column("cell"), strict=True):
            columns = unpack(cell.as_py())
            own_doc, own_place = unpack_places(*columns[:3])
            if ready:
                found.append((own_doc, own_place, columns[3]))
                continue
            ends = np.cumsum(columns[3].astype(np.int64) + (length - 1)).tolist()
            text = columns[5].tobytes()
            doc.append(own_doc)
            place.append(own_place)
            content += [known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            twice.append(np.unpackbits(columns[4], count=len(ends)))
        if known:
            each = np.array(content, np.int64)
            total = np.bincount(each, 1 + np.concatenate(twice))
            spool = Spool(uri, memory)
            try:
                which, start, count = _runs_of(list(known), total > 1, length, spool)
            finally:
                spool.close()
            # Every occurrence of a segment has its runs.
            runs = np.bincount(which, minlength=len(known))
            n = runs[each]
            nth = np.repeat((np.cumsum(runs) - runs)[each] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append((np.repeat(np.concatenate(doc), n), np.repeat(np.concatenate(place), n) + start[nth].astype(np.uint32), count[nth].astype(np.uint32)))
        return _shares(*(np.concatenate([f[k] for f in found]) for k in range(3)), shares)

    return run


def _by_document(group: pa.Table) -> pa.Table:
    """Cells of a share of the documents in; a row a document out, with its places, or starts and then counts of its runs."""
    columns = [unpack(cell.as_py()) for cell in group.column("cell")]
    found = [(*unpack_places(*c[:3]), *c[3:]) for c in columns]
    doc, place, *count = (np.concatenate([f[k] for f in found]) for k in range(len(found[0])))
    order = np.lexsort((place, doc))
    doc, parts = doc[order], [x[order].astype(np.uint32) for x in (place, *count)]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(at[1:], doc.size)
    cells = [b"".join(x[a:b].tobytes() for x in parts) for a, b in zip(at, ends, strict=True)]
    return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "places": pa.array(cells, pa.binary())})


def _listed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("share").applyInArrow(_by_document, "doc_id long, places binary")


def _results(length: int, texts: bool) -> Callable:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * texts
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans = (text.as_py() or "").encode(), []
                if runs.is_valid:
                    start, count = np.frombuffer(runs.as_py(), np.uint32).astype(np.int64).reshape(2, -1)
                    end = np.maximum.accumulate(start + count + (length - 1))
                    head = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                    spans = list(zip(start[head].tolist(), end[np.append(head[1:], start.size) - 1].tolist(), strict=True))
                kept = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
            total, gone, number, digest, spans, kept = zip(*rows, strict=True)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (total, gone, number)], pa.array(digest, pa.string())]
            more = [pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(kept, pa.binary())] if texts else []
            yield pa.RecordBatch.from_arrays(columns + more, names)

    return run


def repeated_runs(docs: DataFrame, length: int = 200, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """(doc_id, places): for each text with such, packed starts and counts of the runs of strings that stand elsewhere too.

    ``docs`` has distinct ids and their texts.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // SHARD_BYTES))
    sent = docs.mapInArrow(_anchors(length, buckets), SENT).drop("kind")
    met = settle(sent.groupBy("bucket").applyInArrow(_met(buckets, max(hot, size // STEP // HOT_SHARE)), "share int, cell binary"), "anchors")
    many = [unpack(bytes(r.cell))[0] for r in met.filter("share = -1").select("cell").collect()]  # at most HOT_SHARE numbers
    many = np.unique(np.concatenate(many)) if many else np.zeros(0, np.uint64)
    # A left join here and in remove_repeated_bytes: both then read one exchange of the texts.
    around = docs.join(_listed(met.filter("share >= 0")), "doc_id", "left").select("doc_id", "text", "places")
    segments = around.mapInArrow(_segments(length, buckets, many), SENT)
    return _listed(segments.groupBy("kind", "bucket").applyInArrow(_sorted(buckets, length, shared_dir(spark), memory), "share int, cell binary"))


def remove_repeated_bytes(docs: DataFrame, length: int = 200, texts: bool = True, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the removed spans and the kept bytes."""
    own, ids = keyed(docs)
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    runs = repeated_runs(own, length, memory, hot)
    out = own.join(runs, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(
        _results(length, texts), names + ", spans array<struct<start:long,end:long>>, kept binary" * texts
    )
    if ids is None:
        return out
    return out.withColumnRenamed("doc_id", "row").join(ids, "row").select(F.col("own").alias("doc_id"), *out.columns[1:])
