"""Compact postings: (key, flag, document, place) lists, and where equal keys meet.

A map task turns a batch of documents into one binary cell for each bucket of keys. Within a
batch each key is sent once: when it occurs more often, its places are known to repeat already and
leave as found, whatever other batches hold. So a frequent key costs at most one posting a batch.
Cells carry their own document ids; a task that runs again may cut its batches differently.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes under one zstandard frame."""
    head = np.array([len(columns)] + [x for c in columns for x in (c.size, c.itemsize)], np.uint32)
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return head.tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(cell: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(cell, np.uint32, 1)[0])
    head = np.frombuffer(cell, np.uint32, 2 * count, 4).reshape(-1, 2)
    planes = zstandard.ZstdDecompressor().decompress(cell[4 + 8 * count :])
    out, at = [], 0
    for size, width in head.tolist():
        raw = np.frombuffer(planes, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(raw.T).view(f"u{width}").reshape(-1) if size else np.zeros(0, f"u{width}"))
        at += size * width
    return out


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def pack_places(ids: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document ids in use, steps between documents, places); ``doc`` ascends and indexes ``ids``."""
    used, index = np.unique(doc, return_inverse=True)
    return delta(ids[used].astype(np.int64)).view(np.uint64), delta(index.astype(np.uint32)), place.astype(np.uint32)


def unpack_places(used: np.ndarray, step: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.cumsum(used.view(np.int64))
    return ids[np.cumsum(step, dtype=np.int64)] if step.size else np.zeros(0, np.int64), place


def distinct(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first posting of each key, whether any of its postings is flagged, and all places of keys that repeat."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(keys.size, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, keys.size))
    flagged = np.logical_or.reduceat(flags[order], at) if at.size else np.zeros(0, bool)
    return order[at], flagged, np.sort(order[np.repeat(size, size) > 1])


def meeting(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which postings have a key that occurs twice or more and is flagged once or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(keys.size, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, keys.size))
    good = (size > 1) & np.logical_or.reduceat(flags[order], at) if at.size else np.zeros(0, bool)
    out = np.zeros(keys.size, bool)
    out[order[np.repeat(good, size)]] = True
    return out
