"""External induced sorting: the order of a text's suffixes and their common prefixes, from bounded queues.

Suffixes are of type S if they are smaller than the next one, of type L otherwise; an S suffix after an L one is
a seed. The pieces from seed to seed are sorted and named, and the names are a shorter text. Where names
repeat it is sorted in the same way, the recursion, or by doubling once it fits into the memory given. Once the seeds are in order, a scan of all suffixes in ascending
order gives the L suffixes, each at the turn of the one it stands before, and a scan in descending order gives
the S suffixes from those.

What a scan has found and not yet reached waits in a priority queue of tuples (character and type, position,
common prefix with the one before of its character). The queue is cut into ranges of characters; the range at
hand is sorted in memory, and the others go to files once all queues of the sort hold more than the memory they
are given. Found suffixes leave in blocks that are kept in the same way. The scan takes as many tuples at once
as come before all that they give rise to, so each step is a few array operations.

Common prefixes pass through the induction: where two suffixes stand before scanned ones, theirs is one more
than the least of those between, found by a sparse table within a step and by running minima across steps.
Between levels names become characters. They are exact up to ``most`` and stop there.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs

Block = tuple[np.ndarray, ...]
#: Ranges of characters that a queue of names is cut into; bytes have a range each.
RANGES = 256
NONE = np.uint16(0xFFFF)
#: What a name costs where names are sorted in memory.
BYTES_A_NAME = 64


class Spool:
    """Files of one task in the shared folder, and the memory that its queues share."""

    def __init__(self, uri: str, memory: int):
        self.files, base = pafs.FileSystem.from_uri(uri)
        self.path, self.room, self.memory, self.written = f"{base}/sort-{uuid.uuid4().hex}", memory, memory, 0
        self.lists: list[Blocks] = []

    def write(self, block: Block) -> str:
        if not self.written:
            self.files.create_dir(self.path, recursive=True)
        self.written += 1
        name, held = f"{self.path}/{self.written}", io.BytesIO()
        np.savez(held, *block)
        with self.files.open_output_stream(name) as out:
            out.write(held.getbuffer())
        return name

    def read(self, name: str) -> Block:
        with self.files.open_input_stream(name) as source, np.load(io.BytesIO(source.read())) as held:
            return tuple(held[k] for k in held.files)

    def spill(self) -> None:
        """Frees half of the memory, the largest lists first."""
        for blocks in sorted(self.lists, key=lambda b: -b.bytes):
            if self.room * 2 >= self.memory:
                break
            blocks.spill()

    def close(self) -> None:
        if self.written:
            self.files.delete_dir(self.path)


class Blocks:
    """Blocks of equal columns in order of arrival, in memory or in files."""

    def __init__(self, spool: Spool):
        self.spool, self.parts, self.bytes = spool, [], 0
        self.first_held = 0
        spool.lists.append(self)

    def add(self, block: Block) -> None:
        size = sum(c.nbytes for c in block)
        self.parts.append(block)
        self.bytes += size
        self.spool.room -= size
        if self.spool.room < 0:
            self.spool.spill()

    def spill(self) -> None:
        held = self.parts[self.first_held :]
        if held:
            self.parts[self.first_held :] = [self.spool.write(tuple(np.concatenate(c) for c in zip(*held, strict=True)))]
            self._freed()

    def _freed(self) -> None:
        self.first_held = len(self.parts)
        self.spool.room += self.bytes
        self.bytes = 0

    def all(self, backwards: bool = False) -> Iterator[Block]:
        if self.spool.written:  # what is read while others grow should not stay in memory
            self.spill()
        for part in self.parts[::-1] if backwards else self.parts[:]:
            yield self.spool.read(part) if isinstance(part, str) else part

    def take(self) -> Block | None:
        """All columns at once; nothing is left."""
        found = list(self.all())
        self.drop()
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else None

    def drop(self) -> None:
        self.parts = []
        self._freed()
        if self in self.spool.lists:
            self.spool.lists.remove(self)


class Queue:
    """Tuples by key, those of one key in order of arrival; taken range by range, upwards."""

    def __init__(self, top: int, spool: Spool):
        self.shift = max(1, (2 * top + 1).bit_length() - RANGES.bit_length() + 1)
        self.ranges = [Blocks(spool) for _ in range(((2 * top + 1) >> self.shift) + 1)]

    def push(self, key: np.ndarray, *columns: np.ndarray) -> None:
        if not key.size:
            return
        into = key >> self.shift
        order = np.argsort(into.astype(np.uint16), kind="stable")
        ordered = into[order]
        cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).tolist() + [key.size]
        sent = [c[order] for c in (key, *columns)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.ranges[int(ordered[a])].add(tuple(c[a:b] for c in sent))

    def take(self, index: int) -> Block | None:
        found = self.ranges[index].take()
        if found is None:
            return None
        order = np.argsort(found[0], kind="stable")
        return tuple(c[order] for c in found)


class _Prefixes:
    """The common prefix of each new suffix with the one of its character before it."""

    def __init__(self, top: int, most: int):
        self.most, self.steps = most, 0
        self.tail, self.last = np.full(top + 1, NONE), np.full(top + 1, -1, np.int32)
        self.since = np.full(1024, NONE)

    def step(self, lcp: np.ndarray, at: np.ndarray, char: np.ndarray) -> np.ndarray:
        """``lcp`` of scanned suffixes with the ones before; those at ``at`` give rise to one with ``char`` each."""
        table = [lcp]
        while 2 << len(table) - 1 <= lcp.size:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        least = table[-1][0] if lcp.size == 1 << len(table) - 1 else min(table[-1][0], table[-1][-1])
        out = np.zeros(at.size, np.uint16)
        if at.size:
            order = np.argsort(char, kind="stable")
            place, own = at[order], char[order]
            head = np.append(True, own[1:] != own[:-1])
            span = np.empty(place.size, np.int64)
            span[1:] = place[1:] - place[:-1]
            span[head] = place[head] + 1
            level = np.frexp(span.astype(np.float32))[1] - 1
            width = np.left_shift(1, level)
            starts = np.cumsum([0] + [t.size for t in table[:-1]])[level]
            flat = np.concatenate(table)
            found = np.minimum(flat[starts + place - span + 1], flat[starts + place - width + 1])
            first, chars = np.flatnonzero(head), own[head]
            last = self.last[chars]
            between = np.append(self.since[: self.steps], NONE)[np.minimum(last + 1, self.steps)]
            found[first] = np.minimum(found[first], np.minimum(self.tail[chars], between))
            found = np.minimum(found, self.most - 1) + np.uint16(1)
            found[first[last < 0]] = 0
            out[order] = found
            end = np.append(first[1:], own.size) - 1
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], NONE)
            self.tail[chars], self.last[chars] = after[place[end] + 1], self.steps
        if self.steps == self.since.size:
            self.since = np.append(self.since, np.full(self.steps, NONE))
        self.since[self.steps] = NONE
        self.steps += 1
        np.minimum(self.since[: self.steps], least, out=self.since[: self.steps])
        return out


def _induce(chars: np.ndarray, runs: np.ndarray, top: int, seeds: Iterator[Block], most: int, spool: Spool) -> Blocks:
    """Blocks (position, prefix) of the suffixes that the seeds give rise to, in order."""
    queue, prefixes, out = Queue(top, spool), _Prefixes(top, most), Blocks(spool)
    out.add((np.zeros(0, np.uint32), np.zeros(0, np.uint16)))
    for pos, lcp in seeds:
        queue.push(2 * chars[pos].astype(np.uint32) + np.uint32(1), pos, lcp)
    end_key, end_run, look = -2, 0, 1 << 12
    far = np.uint32(0xFFFFFFFF)
    for index in range(len(queue.ranges)):
        held = queue.take(index)
        while held is not None and held[0].size:
            # Within a range of one character what arises comes after all that is held; else a part of it is looked at.
            part = held[0].size if queue.shift == 1 else look
            key, pos, lcp = (c[:part] for c in held)
            before = chars[pos - (pos > 0)].astype(np.uint32)
            own = key >> 1
            gives = (pos > 0) & ((before > own) | ((before == own) & (key & 1 == 0)))
            new = np.where(gives, 2 * before, far)
            late = np.flatnonzero(key[1:] > np.minimum.accumulate(new)[:-1])
            count = int(late[0]) + 1 if late.size else key.size
            look = max(1 << 12, 4 * count) if count < key.size else 2 * look
            key, pos, lcp, gives, new = key[:count], pos[:count], lcp[:count].copy(), gives[:count], new[:count]
            # A seed next to one that arose of its character: both are runs of it, and part where the shorter ends.
            former = np.append(np.int64(end_key), key[:-1].astype(np.int64))
            run = np.minimum(runs[pos], most)
            meets = key == former + 1
            meets &= key & 1 == 1
            lcp[(key >> 1).astype(np.int64) != former >> 1] = 0
            lcp[meets] = np.minimum(run, np.append(np.uint16(end_run), run[:-1]))[meets]
            end_key, end_run = int(key[-1]), int(run[-1])
            arose = key & 1 == 0
            out.add((pos[arose], lcp[arose]))
            at = np.flatnonzero(gives)
            new, more = new[at], prefixes.step(lcp, at, new[at] >> 1)
            here = new >> queue.shift == index
            away = ~here
            queue.push(new[away], pos[at[away]] - 1, more[away])
            held = tuple(c[count:] for c in held)
            if here.any():
                added = (new[here], pos[at[here]] - 1, more[here])
                held = tuple(np.concatenate(c) for c in zip(held, added, strict=True))
                if queue.shift > 1 or held[0][0] & 1 or held[0][-1] & 1:
                    order = np.argsort(held[0], kind="stable")
                    held = tuple(c[order] for c in held)
    return out


def _types(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and how often its first character stands in a row from it."""
    n = chars.size
    change = np.flatnonzero(chars[1:] != chars[:-1])
    runs = np.diff(change, prepend=-1)
    small = np.append(np.repeat(chars[change] < chars[change + 1], runs), True)
    ends = np.append(np.repeat(change, runs), n - 1)
    return small, np.minimum(ends - np.arange(n) + 1, 0xFFFE).astype(np.uint16)


def _words(chars: np.ndarray, padded: np.ndarray, pos: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next 8 bytes or 2 names from each position as one number; from ``left`` of them on all ones."""
    if chars.dtype == np.uint8:
        word = np.ndarray(padded.size - 7, ">u8", padded, strides=(1,))[pos].astype(np.uint64)
        return word | (~np.uint64(0) >> np.uint64(8) * np.clip(left, 0, 7).astype(np.uint64)) * (left < 8)
    first, second = (np.where(left > k, padded[pos + k], np.uint32(0xFFFFFFFF)) for k in (0, 1))
    return first.astype(np.uint64) << np.uint64(32) | second


def _named(chars: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the pieces from seed to seed in their order; a piece that begins another comes after it."""
    width = 8 if chars.dtype == np.uint8 else 2
    padded = np.append(chars, np.zeros(width + 8, chars.dtype))
    size = np.append(np.diff(seeds).astype(np.int64) + 1, 1)
    name = np.zeros(seeds.size, np.int64)
    act, done = np.arange(seeds.size), 0
    while act.size:
        word = _words(chars, padded, seeds[act].astype(np.int64) + done, size[act] - done)
        order = np.lexsort((word, name[act])) if done else np.argsort(word, kind="stable")
        act, word = act[order], word[order]
        own = name[act]
        outer = np.append(True, own[1:] != own[:-1])
        inner = outer | np.append(True, word[1:] != word[:-1])
        at = np.flatnonzero(inner)
        counts = np.diff(np.append(at, act.size))
        base = np.flatnonzero(outer)
        name[act] = own + np.repeat(at, counts) - np.repeat(base, np.diff(np.append(base, act.size)))
        done += width
        act = act[(np.repeat(counts, counts) > 1) & (size[act] >= done)]  # one that ends here comes after those that go on
    used, dense = np.unique(name, return_inverse=True)
    return dense.astype(np.uint32), used.size


def _lifted(chars: np.ndarray, seeds: np.ndarray, order: np.ndarray, names_lcp: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the sorted seeds in characters, from those in names."""
    out = np.zeros(order.size, np.int64)
    a, b, skip = order[:-1].astype(np.int64), order[1:].astype(np.int64), names_lcp[1:].astype(np.int64)
    last = seeds.size - 1
    far = np.where(skip >= most, most, seeds[np.minimum(b + skip, last)].astype(np.int64) - seeds[b])
    out[1:] = np.minimum(far, most)
    act = np.flatnonzero(out[1:] < most)
    x, y = (seeds[np.minimum(k[act] + skip[act], last)].astype(np.int64) for k in (a, b))
    while act.size:
        same = chars[x] == chars[y]
        act, x, y = act[same], x[same] + 1, y[same] + 1
        out[act + 1] += 1
        more = out[act + 1] < most
        act, x, y = act[more], x[more], y[more]
    return out.astype(np.uint16)


def _doubled(names: np.ndarray, most: int) -> Block:
    """As ``ordered``, of names that fit into memory: ranks of prefixes of doubled length until all differ."""
    rank, width = np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]
    held = [rank.astype(np.uint32)]
    act = np.flatnonzero(np.bincount(rank, minlength=rank.size)[rank] > 1)
    while act.size:
        after = np.append(rank, np.zeros(1, np.int64))[np.minimum(act + width, rank.size)]  # the only 0 ends the text
        order = np.argsort((rank[act] << 32) | after, kind="stable")
        act, after = act[order], after[order]
        own = rank[act]
        outer = np.append(True, own[1:] != own[:-1])
        at = np.flatnonzero(outer | np.append(True, after[1:] != after[:-1]))
        counts, base = np.diff(np.append(at, act.size)), np.flatnonzero(outer)
        rank[act] = own + np.repeat(at, counts) - np.repeat(base, np.diff(np.append(base, act.size)))
        act, width = act[np.repeat(counts, counts) > 1], 2 * width
        if width <= most:
            held.append(rank.astype(np.uint32))
    order = np.empty(rank.size, np.uint32)
    order[rank] = np.arange(rank.size, dtype=np.uint32)
    lcp = np.zeros(rank.size, np.int64)
    for k in reversed(range(len(held))):
        a, b = (np.minimum(x.astype(np.int64) + lcp[1:], rank.size - 1) for x in (order[:-1], order[1:]))
        while True:  # the widest may fit in more than once
            same = (held[k][a] == held[k][b]) & (lcp[1:] < most)
            lcp[1:] += same.astype(np.int64) << k
            a, b = (np.minimum(x + (same.astype(np.int64) << k), rank.size - 1) for x in (a, b))
            if k < len(held) - 1 or not same.any():
                break
    return order, np.minimum(lcp, most).astype(np.uint16)


def _downwards(found: Blocks, chars: np.ndarray) -> Iterator[Block]:
    """The found suffixes that stand after a smaller one, in descending order, with what each shares with the one before."""
    link, least = np.uint16(0), NONE
    for pos, lcp in found.all(backwards=True):
        if not pos.size:
            continue
        pos, lcp = pos[::-1], lcp[::-1]
        shared = np.append(link, lcp[:-1])
        link = lcp[-1]
        kept = np.flatnonzero((pos > 0) & (chars[pos - (pos > 0)] < chars[pos]))
        if not kept.size:
            least = min(least, shared.min())
            continue
        parts = np.minimum.reduceat(shared[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
        parts[0] = min(parts[0], least)
        least = shared[kept[-1] + 1 :].min() if kept[-1] + 1 < shared.size else NONE
        yield pos[kept], parts


def _sorted(chars: np.ndarray, top: int, most: int, spool: Spool) -> tuple[Blocks, Blocks, np.ndarray]:
    """The L suffixes in ascending and the S suffixes in descending order, and the lengths of runs."""
    small, runs = _types(chars)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.uint32) + np.uint32(1)
    names, count = _named(chars, seeds)
    if count == seeds.size:
        order = np.empty(count, np.uint32)
        order[names] = np.arange(count, dtype=np.uint32)
        shared = np.zeros(count, np.uint16)
    elif names.size <= spool.memory // BYTES_A_NAME:
        order, shared = _doubled(names, most)
    else:
        order, shared = ordered(names, count - 1, most, spool)
    lcp = _lifted(chars, seeds, order, shared, most)
    large = _induce(chars, runs, top, iter([(seeds[order], lcp)]), most, spool)
    del small, names, order, shared, lcp
    mirrored = (top - chars).astype(chars.dtype)
    return large, _induce(mirrored, runs, top, _downwards(large, chars), most, spool), runs


def _upwards(small: Blocks) -> Block:
    pos, lcp = (np.concatenate(c)[::-1] for c in zip(*small.all(), strict=True))
    return pos, np.append(np.uint16(0), lcp[:-1])


def ordered(chars: np.ndarray, top: int, most: int, spool: Spool) -> Block:
    """Positions of all suffixes in order, and the common prefix of each with the one before.

    ``chars`` (bytes or 32-bit names up to ``top``) ends with its only 0.
    """
    if chars.size == 1:
        return np.zeros(1, np.uint32), np.zeros(1, np.uint16)
    large, small, runs = _sorted(chars, top, most, spool)
    l_pos, l_lcp = (np.concatenate(c) for c in zip(*large.all(), strict=True))
    s_pos, s_lcp = _upwards(small)
    large.drop()
    small.drop()
    pos, lcp = np.concatenate([l_pos, s_pos]), np.concatenate([l_lcp, s_lcp])
    key = 2 * chars[pos].astype(np.int64)
    key[l_pos.size :] += 1
    order = np.argsort(key, kind="stable")
    pos, lcp, key = pos[order], lcp[order], key[order]
    former = np.append(np.int64(-2), key[:-1])
    lcp[key >> 1 != former >> 1] = 0
    meet = np.flatnonzero((key & 1 == 1) & (key == former + 1))
    lcp[meet] = np.minimum(np.minimum(runs[pos[meet]], runs[pos[meet - 1]]), most)
    # The last position is the least suffix; it arises from nothing and is no part of what the scans give.
    return np.append(np.uint32(chars.size - 1), pos), np.append(np.uint16(0), lcp)


def repeated(chars: np.ndarray, length: int, spool: Spool) -> np.ndarray:
    """Whether the ``length`` characters from each position on stand anywhere else; ``chars`` are bytes that end with their only 0."""
    found = np.zeros(chars.size, bool)
    if chars.size < 2:
        return found
    large, small, runs = _sorted(chars, int(chars.max()), length, spool)
    edges: list[dict[int, int]] = []
    for blocks in (large, small):
        former, last = None, {}
        for pos, lcp in blocks.all():
            if not pos.size:
                continue
            at = np.flatnonzero(lcp >= length)
            found[pos[at]] = True
            found[pos[at[at > 0] - 1]] = True
            if former is not None and lcp[0] >= length:
                found[former] = True
            former = pos[-1]
            end = np.flatnonzero(np.append(chars[pos[1:]] != chars[pos[:-1]], True))
            last.update(zip(chars[pos[end]].tolist(), pos[end].tolist(), strict=True))
        edges.append(last)
        blocks.drop()
    for char, pos in edges[0].items():  # the greatest L suffix of a character beside its least S suffix
        other = edges[1].get(char)
        if other is not None and min(runs[pos], runs[other]) >= length:
            found[[pos, other]] = True
    return found
