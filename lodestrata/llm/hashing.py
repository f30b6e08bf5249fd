"""Vectorised word and window hashes over Arrow string buffers.

Words are maximal runs of bytes outside space and \\x09-\\x0D. A word's hash adds one random
64-bit number for each (byte, place) pair, so it is drawn from a universal family; window hashes
are polynomials over word hashes. All arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PLACES = 64
_rng = np.random.Generator(np.random.PCG64(20240131))
_TABLE = _rng.integers(0, 2**64, size=256 * PLACES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE.reshape(256, PLACES)[_SPACE] = 0
_AS_IS = np.arange(256, dtype=np.int32) * PLACES
_LOWER = _AS_IS.copy()
_LOWER[65:91] = _AS_IS[97:123]
# Loose words: runs of letters, digits and bytes beyond ASCII.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_bytes(data: np.ndarray, breaks: np.ndarray, lower: bool, loose: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word; a word never spans an offset in ``breaks``."""
    solid = ~(_BREAK if loose else _SPACE)[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = breaks[breaks < data.size]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    if not starts.size:
        return starts, np.zeros(0, np.uint64)
    word = np.cumsum(first, dtype=np.int32) - 1
    place = np.arange(data.size, dtype=np.int32)
    place -= starts.astype(np.int32)[word]
    code = (_LOWER if lower else _AS_IS)[data]
    code += place & (PLACES - 1)
    value = _TABLE[code]
    if data.size > PLACES and int(np.max(place[solid])) >= PLACES:
        value *= (2 * (place // PLACES) + 1).astype(np.uint64)
    value[: starts[0]] = 0
    if loose:
        value[~solid] = 0
    return starts, mix(np.add.reduceat(value, starts))


def text_words(texts: pa.Array, lower: bool = False, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): document i has hashes[bounds[i]:bounds[i + 1]]. Null texts have no words.

    ``lower`` lowers A-Z; ``loose`` breaks words at all ASCII characters but letters and digits.
    """
    n = len(texts)
    if texts.type not in (pa.string(), pa.binary()):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if texts.type == pa.string() else b"")
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(n, np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        local = off[i : j + 1] - off[i]
        starts, found = _hash_bytes(raw[off[i] : off[j]], local[:-1], lower, loose)
        counts[i:j] = np.diff(np.searchsorted(starts, local))
        hashes.append(found)
        i = j
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(hashes)


MULTIPLIERS = (0x9E3779B97F4A7C17, 0xD1B54A32D192ED03 | 3)


def windows(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k values from each index on; the last k - 1 indexes have none."""
    n = hashes.size
    if n < k:
        return np.zeros(0, np.uint64)
    m = np.uint64(MULTIPLIERS[which])
    with np.errstate(over="ignore"):
        if k <= 8:
            out = hashes[: n - k + 1].copy()
            for i in range(1, k):
                out = out * m + hashes[i : n - k + 1 + i]
            return mix(out)
        inverse = np.uint64(pow(int(m), -1, 2**64))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, m)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power, dtype=np.uint64)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - k, inverse)]), dtype=np.uint64)
        return mix((total[k:] - total[:-k]) * back)


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each window over concatenated documents, whether it lies within one document."""
    n = int(bounds[-1])
    if n < k:
        return np.zeros(0, bool)
    good = np.ones(n - k + 1, bool)
    for cut in bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]:
        good[max(0, cut - k + 1) : cut] = False
    return good


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        i, n = 0, batch.num_rows
        if not n:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        off = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
